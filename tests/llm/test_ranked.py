import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from presslens.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, queries, k=10):
    counted = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := plain_terms(t))]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in queries:
        scored = []
        for d, c, n in counted:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if no_id else d, -s) for r, (s, no_id, d) in enumerate(sorted(scored)[:k], 1)]
    return out


ODD = ["", None, "  \n", "É é Straße-straße_x İi", "a" * 500, "tab\tnew\nline\x0bx\x1cy\x85z nbsp", "1a2B3c 4_5~6", "\x00nul\x7fdel", "한국어 漢字，かな"]


def test_terms_are_those_of_the_pattern():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("aZ09 _-.~@[`{\x7f\x80é한\n", k=40)) for _ in range(500)]
    words, counts = ranked.terms(pa.array(texts).slice(1))
    want = [plain_terms(t) for t in texts[1:]]
    assert words.to_pylist() == [t for ts in want for t in ts] and counts.tolist() == [len(t) for t in want]
    assert ranked.terms(pa.array([], pa.string()))[1].tolist() == []


def test_numbers_come_back_from_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5])
    raw, ends = ranked.packed(values)
    assert ranked.unpacked(np.frombuffer(raw, np.uint8)).tolist() == values.tolist() and ends[-1] == len(raw)


def rows(n, seed):
    """Frequent and rare words, copies with equal scores, some long texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.choice([3, 20, 60, 900] if i % 50 == 0 else [3, 20, 60])))) for i in range(n)]
    return out + [(10_000 + i, "w1 w7 W7 copy rare") for i in range(40)] + [(None, "w1 w7 w7 copy rare"), (5, "w2 again")] + [(20_000 + i, t) for i, t in enumerate(ODD)]


@pytest.mark.parametrize("shard", [300, 10**9])
def test_ranking_equals_brute_force(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(ranked, "ROWS_AT_ONCE", 20)
    monkeypatch.setattr(ranked, "QUERIES", 9)
    rng = random.Random(4)
    docs = rows(700, 1)
    queries = [(i, " ".join(f"w{rng.randrange(int(400 ** rng.random()))}" for _ in range(rng.randint(1, 12)))) for i in range(25)]
    queries += [(90, "copy rare w1 W1"), (91, None), (92, "nothing known"), (93, ""), (90, "w2"), (94, "漢字 é STRAßE")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, rank int, query string").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, doc_id int")
    path = str(tmp_path / "index")
    scoring = ranked.write_index(df, path, shard=shard)
    got = [tuple(r) for r in ranked.search(spark, path, scoring, items).collect()]

    def order(r):
        return r[0], r[1], r[3], r[2] or -1

    assert sorted(got, key=order) == sorted(brute(docs, queries), key=order)
    assert max(Counter((i, r) for i, r, _, _ in got if i != 90).values()) == 1


def test_bounds_spare_blocks_and_lose_nothing():
    rng = random.Random(6)
    texts = [" ".join(["the"] * rng.randint(1, 9) + rng.choices(["of", "pine", "oak"], [20, 1, 1], k=rng.randint(1, 30))) for _ in range(6000)]
    for i in range(5900, 5912):
        texts[i] = "the of heron"
    words, lengths = ranked.terms(pa.array(texts))
    shard = ranked.Shard(b"".join(ranked.build(words, lengths, pa.array(range(len(texts))))))
    scoring = ranked.Scoring(len(texts), int(lengths.sum()))
    number = {t: i for i, t in enumerate(shard.terms["term"].to_pylist())}
    df = shard.terms["df"].to_pylist()
    read = []
    plain = shard.postings
    shard.postings = lambda blocks: read.append(len(blocks)) or plain(blocks)
    query = [(number[t], scoring.weight(df[number[t]])) for t in ("the", "of", "heron")]
    doc, score = ranked.search_shard(shard, scoring, query, 10)
    best = {(d, s) for _, _, d, s in brute(list(enumerate(texts)), [(0, "the of heron")])}
    assert best <= set(zip(doc.tolist(), score.tolist())) and len(doc) == 12
    assert sum(read) < 8 < len(shard.blocks["last"])


def test_no_documents_and_no_queries(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ranked.ranked(docs, items).collect() == [] and ranked.ranked(some, items.limit(0)).collect() == []
    (row,) = ranked.ranked(some, items).collect()
    assert (row.item_id, row.rank, row.doc_id) == (1, 1, 1) and row.score > 0
    with pytest.raises(ValueError):
        ranked.Shard(b"something else")
