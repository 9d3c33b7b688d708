"""Quality rules as a short-circuit cascade, cheapest rejections first.

Every rule looks at one text. On a bounded sample each rule's cost (seconds a text) and
selectivity (share rejected) are measured; the cascade then runs the rules by rejection per
cost and stops at the first that rejects. The order changes only the time: a text is kept
exactly if no rule rejects it, so the verdict doesn't depend on the sample.

A null or empty text has no words and is rejected by ``short``. Repeated rows get equal
verdicts. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from presslens.llm.common import WORD, text_struct, text_value

SYMBOLS = "#*$%&|<>"
CAPITALS = re.compile("[A-Z]+")
WINDOW = 5
LONG_TEXT_WORDS = 100_000


def repeat_words(words: Sequence[str]) -> int:
    """Words inside windows of five that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n > LONG_TEXT_WORDS:
        repeated = _repeated_windows(words)
    else:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        repeated = [i for i, w in enumerate(windows) if counts[w] > 1]
    covered = end = 0
    for i in repeated:
        covered += i + WINDOW - max(end, i)
        end = i + WINDOW
    return covered


def _repeated_windows(words: Sequence[str]) -> list[int]:
    """Starts of repeated windows through dense ranks, without a tuple for each window."""
    ids: dict[str, int] = {}
    code = word_ids = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    for k in range(1, WINDOW):
        pairs = code[:-1] * len(ids) + word_ids[k:]
        code = np.unique(pairs, return_inverse=True)[1]
    return np.flatnonzero(np.bincount(code)[code] > 1).tolist()


class Facts:
    """What the rules ask about a text; each fact is worked out once, when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_capitals(self) -> int:
        return sum(map(len, CAPITALS.findall(self.text)))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


BASE = (
    Rule("short", lambda f: f.n_words < 10),
    Rule("repeats", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * f.word_chars),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > 30 * len(f.lines)),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
    Rule("capitals", lambda f: 100 * f.n_capitals > 40 * f.word_chars),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejection: float


def estimate(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 2000, seed: int = 7
) -> list[Estimate]:
    """Cost and selectivity of every rule on about ``sample_rows`` texts, best rule first.

    The sample is timed where it lies; only two sums for each rule and task come back.
    """
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = docs.select(F.col(text).alias("text")).sample(share, seed).limit(2 * sample_rows)

    def timed(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            spent, rejected = [], []
            for rule in rules:
                start = time.perf_counter()
                rejected.append(sum(rule.rejects(Facts(t)) for t in texts))
                spent.append(time.perf_counter() - start)
            yield pa.RecordBatch.from_pydict(
                {"rule": list(range(len(rules))), "spent": spent, "rejected": rejected, "n": [len(texts)] * len(rules)}
            )

    found = sample.mapInArrow(timed, "rule long, spent double, rejected long, n long")
    sums = found.groupBy("rule").agg(F.sum("spent").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n"))
    by_rule = {x.rule: x for x in sums.collect()}
    out = []
    for k, rule in enumerate(rules):
        x = by_rule.get(k)
        out.append(Estimate(rule, x.s / x.n, x.r / x.n) if x and x.n else Estimate(rule, 0.0, 0.0))
    return sorted(out, key=lambda e: -e.rejection / max(e.seconds, 1e-9))


def ordered_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, **options) -> list[Rule]:
    return [e.rule for e in estimate(docs, text, rules, **options)]


def passes(order: Sequence[Rule], text: Column | str = "text") -> Column:
    """True if no rule rejects the text; stops at the first rejection."""
    keep = text_value(lambda t: _passes(order, Facts(t)), "boolean")
    return keep(text)


def _passes(order: Sequence[Rule], facts: Facts) -> bool:
    return not any(rule.rejects(facts) for rule in order)


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, **options) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they are."""
    return docs.where(passes(ordered_rules(docs, text, rules, **options), F.col(text)))


def judged(order: Sequence[Rule], text: Column | str = "text") -> Column:
    """Base counts, the base verdict and the cascade's verdict of a text, as a struct."""
    rest = [rule for rule in order if rule not in BASE]

    def one(t: str):
        f = Facts(t)
        failed = any(rule.rejects(f) for rule in BASE)
        kept = not failed and _passes(rest, f)
        return f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, kept

    schema = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, kept boolean"
    )
    return text_struct(one, schema)(text)
