"""Personal data by base patterns plus a linear-chain conditional random field.

The base patterns of the four kinds are fixed; the field adds spans they don't cover, such as
telephone numbers without a country prefix, spelt-out addresses and secret keys. It is
trained by gradient ascent on a small labelled table of tokens and decodes lines in numpy
batches by Viterbi; its features are the shapes of a word and of its neighbours.

A span needs a digit or an at sign in its line, so lines without either are left out of the
decoding; a run of words of one kind that overlaps a base span or fails its kind's plain test
(digit counts, checksum) is split into its shortest pieces that pass, and the rest is dropped. The work is linear in the
text, also for one very long line of marks, digits or addresses. Offsets are code points. Null texts count as empty: no spans.
"""

from __future__ import annotations

import re
import random
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presslens.llm.common import WORD

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)
MAX_TRAINING_TOKENS = 50_000
WORDS_AT_ONCE = 100_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: the run's start would have matched first.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
CUE = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Each at sign with the longest run of local characters before it and a domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and is_card(m[0])]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


# ---- features ----


@lru_cache(maxsize=200_000)
def own_features(word: str) -> tuple[str, ...]:
    """The word's exact and collapsed shapes and a few marks; junk around the word is ignored."""
    core = word.strip("\"'`,;:!?()[]{}<>*#$%&|=") or word
    shape = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in core[:80])
    short = re.sub(r"(.)\1+", r"\1\1", shape)
    n = sum(c.isdigit() for c in core)
    marks = [f"digits:{min(n, 20)}", f"length:{min(len(core) // 4, 10)}"]
    if 13 <= n <= 19:
        marks.append(f"luhn:{luhn(digits_of(core))}")
    if n >= 4 and len(core) >= 16 and n < len(core):
        marks.append("mixed-key")
    return (f"shape:{shape[:24]}", f"short:{short[:16]}", f"word:{core.lower()[:16]}", *marks)


def near_features(word: str) -> tuple[str, ...]:
    shape, short, lower, *_ = own_features(word)
    return short, lower


# ---- training ----


@dataclass(frozen=True)
class Field:
    """Weights by feature for the word itself, the word before and the word after, and between labels."""

    own: dict[str, np.ndarray]
    before: dict[str, np.ndarray]
    after: dict[str, np.ndarray]
    start: np.ndarray
    step: np.ndarray


def labelled_table(spark: SparkSession, sentences: int = 600, seed: int = 3) -> DataFrame:
    """A small labelled table (sentence, pos, word, label) of invented prose with planted items."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def name(lo: int = 2, hi: int = 9) -> str:
        return "".join(rng.choice("abcdefghilmnoprstuväéßñ" if rng.random() < 0.1 else "aeinrst") for _ in range(rng.randint(lo, hi)))

    def card() -> str:
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def item() -> tuple[str, str]:
        kind = rng.choice([*KINDS, "none", "none", "none"])
        ascii_name = re.sub("[^a-z]", "x", name())
        if kind == "email":
            return kind, rng.choice([f"{ascii_name}.{digits(2)}@mail{digits(1)}.example.com", f"{ascii_name}@{ascii_name}.org", f"{ascii_name}{digits(2)} @ {ascii_name} . com"])
        if kind == "ip":
            return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            c = card()
            return kind, rng.choice([c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"])
        if kind == "phone":
            return kind, rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)}/{digits(7)}"])
        if kind == "secret":
            hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))
            mixed = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
            return kind, rng.choice([f'"{hexes}"', hexes, mixed, f'"{mixed}"'])
        return kind, rng.choice([
            digits(1), digits(2), digits(4), f"{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)},{digits(3)}",
            f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(3)}%", f"{name()}{digits(1)}", f"({digits(4)})", f"{digits(2)}:{digits(2)}", digits(6),
        ])

    rows = []
    for s in range(sentences):
        tokens: list[tuple[str, str]] = []
        for _ in range(rng.randint(1, 3)):
            tokens += [(name(), "none") for _ in range(rng.randint(0, 6))]
            kind, text = item()
            cue = {"secret": ["token =", "key:", "password =", "secret"], "phone": ["call", "tel:", ""], "email": ["mail", ""]}.get(kind, [""])
            tokens += [(w, "none") for w in rng.choice(cue).split()]
            junk = rng.choice(["", "", "", ",", ".", "###", "$$$", "!!"])
            parts = text.split()
            tokens += [(w + junk * (k == len(parts) - 1), kind) for k, w in enumerate(parts)]
        tokens += [(name(), "none") for _ in range(rng.randint(0, 4))]
        rows += [(s, k, w, label) for k, (w, label) in enumerate(tokens)]
    return spark.createDataFrame(rows, "sentence long, pos long, word string, label string")


def _padded(sentences: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every token when sentences become rows of one padded grid."""
    lengths = np.asarray(sentences)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    cols = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return rows, cols


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(labelled: DataFrame, rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood on a labelled table of at most ``MAX_TRAINING_TOKENS`` tokens."""
    rows = labelled.orderBy("sentence", "pos").limit(MAX_TRAINING_TOKENS + 1).collect()
    if len(rows) > MAX_TRAINING_TOKENS:
        raise ValueError(f"the labelled table has over {MAX_TRAINING_TOKENS} tokens; pass a sample of whole sentences")
    sentences: dict[int, list] = {}
    for r in rows:
        sentences.setdefault(r.sentence, []).append(r)
    groups = list(sentences.values())
    index: dict[tuple[str, str], int] = {}
    tokens, features = [], []
    t = 0
    for g in groups:
        for k, r in enumerate(g):
            found = [("own", f) for f in own_features(r.word)]
            found += [("before", f) for f in near_features(g[k - 1].word)] if k else []
            found += [("after", f) for f in near_features(g[k + 1].word)] if k + 1 < len(g) else []
            for f in found:
                tokens.append(t)
                features.append(index.setdefault(f, len(index)))
            t += 1
    tokens, features = np.array(tokens, np.int64), np.array(features, np.int64)
    truth = np.array([LABELS.index(r.label) for g in groups for r in g])
    n = len(LABELS)
    w, start, step = np.zeros((len(index), n)), np.zeros(n), np.zeros((n, n))
    at = _padded([len(g) for g in groups])
    width = max(map(len, groups), default=1)
    inside = np.zeros((len(groups), width), bool)
    inside[at] = True
    steps = np.zeros_like(step)
    same = at[1][1:] > 0
    np.add.at(steps, (truth[:-1][same], truth[1:][same]), 1)
    starts = np.bincount(truth[at[1] == 0], minlength=n)
    one_hot = np.eye(n)[truth]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, start, step)]
    for i in range(1, rounds + 1):
        emission = np.zeros((t, n))
        np.add.at(emission, tokens, w[features])
        grid = np.zeros((len(groups), width, n))
        grid[at] = emission
        forward, backward = np.zeros_like(grid), np.zeros_like(grid)
        forward[:, 0] = grid[:, 0] + start
        for k in range(1, width):
            ahead = grid[:, k] + _log_sum(forward[:, k - 1, :, None] + step, 1)
            forward[:, k] = np.where(inside[:, k, None], ahead, forward[:, k - 1])
        for k in range(width - 2, -1, -1):
            behind = _log_sum(step + (grid[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(inside[:, k + 1, None], behind, 0)
        whole = _log_sum(forward[:, -1], 1)
        single = np.exp(forward + backward - whole[:, None, None])[at]
        pair = np.zeros_like(step)
        for k in range(1, width):
            on = inside[:, k]
            joint = forward[on, k - 1, :, None] + step + (grid[on, k] + backward[on, k])[:, None, :]
            pair += np.exp(joint - whole[on, None, None]).sum(0)
        slope_w = np.zeros_like(w)
        np.add.at(slope_w, features, (one_hot - single)[tokens])
        slopes = (slope_w, starts - single[at[1] == 0].sum(0), steps - pair)
        for x, slope, m in zip((w, start, step), slopes, moments):
            g = slope / max(len(groups), 1) - decay * x
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**i)) / (np.sqrt(m[1] / (1 - 0.99**i)) + 1e-8)
    part = {p: {f: w[k] for (q, f), k in index.items() if q == p} for p in ("own", "before", "after")}
    return Field(part["own"], part["before"], part["after"], start, step)


# ---- decoding ----


def viterbi(emission: np.ndarray, lengths: Sequence[int], start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best label of every token; sentences of like length run together as rows of a grid."""
    out = np.zeros(len(emission), np.int8)
    lengths = np.asarray(lengths, np.int64)
    offsets = np.cumsum(lengths) - lengths
    by_length = np.argsort(lengths, kind="stable")
    first = 0
    while first < len(by_length):
        low = max(lengths[by_length[first]], 8)
        last = np.searchsorted(lengths[by_length], 2 * low, "right")
        for part in range(first, last, 4096):
            _viterbi_rows(emission, by_length[part : min(part + 4096, last)], lengths, offsets, start, step, out)
        first = last
    return out


def _viterbi_rows(emission, rows, lengths, offsets, start, step, out) -> None:
    """``rows`` come by rising length, so those still running are a shrinking tail."""
    size = lengths[rows]
    at = offsets[rows]
    width = int(size.max(initial=0))
    back = np.zeros((width, len(rows), len(start)), np.int8)
    score = np.zeros((len(rows), len(start)))
    for k in range(width):
        tail = np.searchsorted(size, k, "right")
        seen = emission[at[tail:] + k]
        if k == 0:
            score[tail:] = seen + start
            continue
        paths = score[tail:, :, None] + step
        back[k, tail:] = paths.argmax(1)
        score[tail:] = paths.max(1) + seen
    label = score.argmax(1)
    every = np.arange(len(rows))
    for k in range(width - 1, -1, -1):
        tail = np.searchsorted(size, k, "right")
        out[at[tail:] + k] = label[tail:]
        if k:
            label[tail:] = back[k, every[tail:], label[tail:]]


class Decoder:
    """Labels the words of many lines at once; weights of a word are looked up once for each batch."""

    def __init__(self, field: Field):
        self.field = field

    def labels(self, lines: Sequence[Sequence[str]]) -> np.ndarray:
        parts, held, words = [], [], 0
        for line in lines:
            held.append(line)
            words += len(line)
            if words >= WORDS_AT_ONCE:
                parts.append(self._labels(held))
                held, words = [], 0
        return np.concatenate([*parts, *([self._labels(held)] if held else [])])

    def _labels(self, lines: Sequence[Sequence[str]]) -> np.ndarray:
        ids: dict[str, int] = {}
        flat = np.fromiter((ids.setdefault(w, len(ids)) for line in lines for w in line), np.int64)
        n = len(LABELS)
        zero = np.zeros(n)
        weights = np.zeros((3, len(ids) + 1, n))
        for w, k in ids.items():
            own, near = own_features(w), near_features(w)
            weights[0, k] = sum((self.field.own.get(f, zero) for f in own), zero)
            weights[1, k] = sum((self.field.before.get(f, zero) for f in near), zero)
            weights[2, k] = sum((self.field.after.get(f, zero) for f in near), zero)
        lengths = np.array([len(x) for x in lines], np.int64)
        starts = np.cumsum(lengths) - lengths
        before, after = np.full(len(flat), len(ids)), np.full(len(flat), len(ids))
        before[1:], after[:-1] = flat[:-1], flat[1:]
        before[starts], after[starts + lengths - 1] = len(ids), len(ids)
        emission = weights[0, flat] + weights[1, before] + weights[2, after]
        return viterbi(emission, lengths, self.field.start, self.field.step)


def plausible(kind: str, text: str) -> bool:
    """The plain test a span of the field must stand."""
    digits = len(digits_of(text))
    if kind == "email":
        return "@" in text and any(c.isalnum() for c in text.partition("@")[0]) and "." in text.partition("@")[2]
    if kind == "ip":
        return len(text.split(".")) == 4 and bool(re.fullmatch("[0-9.]+", text)) and ".." not in text and is_ip(text)
    if kind == "card":
        return is_card(text)
    if kind == "phone":
        return 7 <= digits <= 15 and 2 * digits > len(text.replace(" ", ""))
    return len(text) >= 16 and digits >= 4 and " " not in text and any(c.isalpha() for c in text)


PART = re.compile(r"[^\x20\x09-\x0D,;]+")
TRIM = "\"'`,;:!?[]{}<>*#$%&|=. "


def spans_of(texts: Sequence[str], decoder: Decoder) -> list[tuple[list, list]]:
    """For each text its base spans and the spans the field adds, each by kind and start."""
    base = [base_spans(t) for t in texts]
    lines, places = [], []
    for d, text in enumerate(texts):
        if not CUE.search(text):
            continue
        at = 0
        for line in text.split("\n"):
            if CUE.search(line):
                found = [(m.start() + at, m.end() + at) for m in WORD.finditer(line)]
                lines.append([text[a:b] for a, b in found])
                places.append((d, found))
            at += len(line) + 1
    added: list[list] = [[] for _ in texts]
    if lines:
        labels = decoder.labels(lines)
        k = 0
        for d, found in places:
            own = labels[k : k + len(found)]
            k += len(found)
            hits = np.flatnonzero(own)
            if len(hits):
                for run in np.split(hits, np.flatnonzero((np.diff(hits) != 1) | (np.diff(own[hits]) != 0)) + 1):
                    added[d].append((LABELS[own[run[0]]], found[run[0]][0], found[run[-1]][1]))
    return [(b, _kept(text, b, more)) for text, b, more in zip(texts, base, added)]


def _kept(text: str, base: Sequence[tuple], added: Iterable[tuple]) -> list[tuple[str, int, int]]:
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # how far the base spans up to each one go
    out = []

    def free(kind: str, a: int, b: int) -> bool:
        before = bisect_left(starts, b)
        return a < b and not (before and reach[before - 1] > a) and plausible(kind, text[a:b])

    for kind, a, b in added:
        a, b = _trimmed(text, a, b)
        if free(kind, a, b):
            out.append((kind, a, b))
        else:
            out += [(kind, x, y) for x, y in _pieces(kind, text, a, b, free)]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in TRIM:
        a += 1
    while a < b and text[b - 1] in TRIM:
        b -= 1
    return a, b


#: What a piece of a kind holds at least: digits, at signs, letters.
NEEDS = {"email": (0, 1, 0), "ip": (4, 0, 0), "card": (13, 0, 0), "phone": (7, 0, 0), "secret": (4, 0, 1)}
#: Characters a piece has at most, blanks not counted; a phone with 15 digits has more digits than other characters.
MOST = {"email": 320, "ip": 60, "card": 40, "phone": 29, "secret": 4096}


def _pieces(kind: str, text: str, a: int, b: int, free) -> Iterable[tuple[int, int]]:
    """The shortest pieces of a run that are free, from left to right; words end at commas and semicolons too.

    Running counts say where a piece holds enough digits, letters and at signs, and when it has
    too many characters, so a start costs a few steps however long the run is.
    """
    words = [_trimmed(text, m.start(), m.end()) for m in PART.finditer(text, a, b)]
    words = [w for w in words if w[0] < w[1]]  # words of marks alone begin or end no piece
    sums = [[0], [0], [0], [0]]
    for x, y in words:
        word = text[x:y]
        found = (len(DIGIT.findall(word)), word.count("@"), sum(c.isalpha() for c in word), y - x)
        for upto, n in zip(sums, found):
            upto.append(upto[-1] + n)
    digits, size = sums[0], sums[3]
    check = _luhn_sums("".join(DIGIT.findall(text[x:y])) for x, y in words) if kind == "card" else ([], [])

    def hopeful(last: int) -> bool:
        """What the running counts alone say of a piece."""
        n = digits[last + 1] - digits[first]
        if kind == "card":
            doubled = check[digits[last + 1] % 2]
            return 13 <= n <= 19 and (doubled[digits[last + 1]] - doubled[digits[first]]) % 10 == 0
        return kind != "phone" or n <= 15 and 2 * n > size[last + 1] - size[first]

    first = 0
    while first < len(words):
        last = max([first, *(bisect_left(upto, upto[first] + n) - 1 for upto, n in zip(sums, NEEDS[kind]) if n)])
        after = first + 1
        while last < len(words) and size[last + 1] - size[first] <= MOST[kind]:
            x, y = words[first][0], words[last][1]
            if hopeful(last) and free(kind, x, y):
                yield x, y
                after = last + 1
                break
            if kind == "email" and sums[1][last + 1] - sums[1][first] > 1 or kind in ("card", "phone") and digits[last + 1] - digits[first] > (19 if kind == "card" else 15):
                break
            if kind == "ip" or kind == "secret" and " " in text[x:y]:
                break
            last += 1
        if last >= len(words) and after == first + 1 and len(words) - first > 1 and not _enough(sums, first, NEEDS[kind]):
            return
        first = after


def _luhn_sums(parts: Iterable[str]) -> tuple[list[int], list[int]]:
    """Running sums of all digits as Luhn takes them, for numbers that end after an even and after an odd count of digits."""
    even, odd = [0], [0]
    for k, d in enumerate("".join(parts)):
        once, twice = int(d), int(d) * 2 - 9 * (int(d) > 4)
        even.append(even[-1] + (once if k % 2 else twice))
        odd.append(odd[-1] + (twice if k % 2 else once))
    return even, odd


def _enough(sums: Sequence[Sequence[int]], first: int, needs: Sequence[int]) -> bool:
    return all(upto[-1] - upto[first] >= n for upto, n in zip(sums, needs))


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(field: Field, text: Column | str = "text") -> Column:
    """Struct of ``base`` and ``added`` spans: arrays of (kind, start, finish)."""
    decoder = Decoder(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("finish", pa.int64())])

    def run(texts: pa.Array) -> pa.Array:
        found = spans_of([t or "" for t in texts.to_pylist()], decoder)
        rows = [[[dict(zip(("kind", "start", "finish"), s)) for s in part] for part in pair] for pair in found]
        sides = [pa.array([r[k] for r in rows], pa.list_(span)) for k in (0, 1)]
        return pa.StructArray.from_arrays(sides, names=["base", "added"])

    one = "array<struct<kind: string, start: bigint, finish: bigint>>"
    return F.arrow_udf(run, f"base {one}, added {one}")(text)


def redacted(field: Field, text: Column | str = "text") -> Column:
    """The text with every span, base or added, replaced by ``[KIND]``; null stays null."""
    decoder = Decoder(field)

    def run(texts: pa.Array) -> pa.Array:
        raw = texts.to_pylist()
        found = spans_of([t or "" for t in raw], decoder)
        return pa.array([None if t is None else mask(t, [*b, *m]) for t, (b, m) in zip(raw, found)], pa.string())

    return F.arrow_udf(run, "string")(text)


def mask(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """Overlapping spans become one, named after the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]
