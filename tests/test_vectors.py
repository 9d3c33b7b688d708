import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.functions.vector import cosine, sparse_dot, unwrapped
from presslens.operators import lookup, wordvectors as wv


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_cosine(one):
    assert one(cosine(arr(3, 4), arr(4, 3))) == pytest.approx(0.96)
    assert one(cosine(arr(0, 0), arr(4, 3))) == 0.0
    assert one(cosine(F.lit(None).cast("array<double>"), arr(1, 1))) == 0.0


def test_sparse_dot(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.sparse(5, [0, 3], [1.0, 2.0]), Vectors.sparse(5, [1, 3], [7.0, 5.0])), (Vectors.sparse(5, [], []), Vectors.sparse(5, [1], [1.0]))]
    df = spark.createDataFrame(rows, ["a", "b"])
    assert [r[0] for r in unwrapped(df, "a", "b").select(sparse_dot(F.col("a"), F.col("b"))).collect()] == [10.0, 0.0]


VECTORS = {"a": [1.0, 0.0, 2.0], "b": [0.0, 3.0, -1.0], "hot": [1.0, 1.0, 1.0]}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(VECTORS.items()), "token string, vec array<float>")


@pytest.mark.parametrize("limit", [64 * 2**20, 0])
@pytest.mark.parametrize("chunk", [16, 2])
def test_sentence_vectors_match_brute_force(spark, vectors, monkeypatch, limit, chunk):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(lookup, "HOT_KEYS", 1)
    monkeypatch.setattr(wv, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(i, rng.choices(["a", "b", "hot", "hot", "zz"], k=i % 5), rng.choices(["hot", "b", "oov"], k=i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "article_id bigint, t array<string>, c array<string>")
    got = {r.article_id: r for r in wv.sentence_vectors(df, "article_id", {"tv": "t", "cv": "c"}, vectors, 3).collect()}

    def mean(tokens):
        known = [VECTORS[t] for t in tokens if t in VECTORS]
        return np.mean(known, axis=0) if known else np.zeros(3)

    assert len(got) == 60
    for i, t, c in rows:
        assert got[i].tv == pytest.approx(mean(t).tolist()) and got[i].cv == pytest.approx(mean(c).tolist())


def test_small_vectors_add_whole_texts_as_rows_of_tokens_would(spark, monkeypatch):
    monkeypatch.setattr(wv, "TOKENS_AT_ONCE", 3)
    table = spark.createDataFrame([*VECTORS.items(), ("a", [5.0, None]), ("none", None), (None, [1.0])], "token string, vec array<float>")
    rows = [(1, ["a", "b", "zz", "a", None], None), (1, ["none"], ["hot"] * 9), (None, ["a"], []), (2, [], ["none"])]
    df = spark.createDataFrame(rows, "article_id bigint, t array<string>, c array<string>")
    args = df, "article_id", {"tv": "t", "cv": "c"}, table, 3
    ways = [sorted(f(*args).select("article_id", "side", "part.*").collect(), key=repr) for f in (wv._text_sums, wv._token_sums)]
    flat = [[(r.article_id, r.side, r.chunk, r.n, [x or 0.0 for x in r.sums]) for r in way] for way in ways]
    assert flat[0] == flat[1]
    plan = wv.sentence_vectors(*args)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_cosine_to_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "article_id bigint, v array<double>")
    got = {r.article_id: r.c for r in wv.cosine_to_mean(df, "v", 2, "c").collect()}
    assert got == {1: pytest.approx(0.5**0.5), 2: pytest.approx(0.5**0.5), 3: 0.0}


def grams(token):
    marked = f"<{token}>"
    return {marked[i : i + n] for n in range(3, 7) for i in range(len(marked) - n + 1)}


def test_backoff_matches_brute_force(spark):
    known = {"running": [1.0, 2.0], "runner": [3.0, 0.0], "한국어": [5.0, 5.0]}
    rare = ["runs", "q", "한국", "gunner"]
    vectors = spark.createDataFrame(list(known.items()), "token string, vec array<double>")
    table = {}
    for token, vec in known.items():
        for g in grams(token):
            table.setdefault(g, []).append(vec)
    got = {r.token: r for r in wv.backoff_vectors(spark.createDataFrame([(t,) for t in rare], "token string"), vectors, 2).collect()}
    for token in rare:
        means = [np.mean(table[g], axis=0) for g in grams(token) if g in table]
        assert got[token].grams == len(means)
        assert got[token].vec == pytest.approx((np.mean(means, axis=0) if means else np.zeros(2)).tolist())
    assert got["q"].vec == [0.0, 0.0]


def test_training_repeats_with_one_partition(spark):
    rows = [(i, ["x", "y", "z", "w"][: 2 + i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "article_id bigint, tokens array<string>").coalesce(1).sortWithinPartitions("article_id")
    runs = [wv.model_vectors(wv.train_word_vectors(df, "tokens", 4, 2, 1, partitions=1)).orderBy("token").collect() for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 4
    every = wv.subword_vectors(df.withColumn("tokens", F.concat("tokens", F.array(F.lit("xyz")))), "tokens", dim=4, window=2, min_count=20, partitions=1)
    assert {r.token for r in every.collect()} == {"x", "y", "z", "w", "xyz"}


def test_backoff_tasks_follow_the_number_of_tokens(spark, monkeypatch):
    vectors = spark.createDataFrame([("abcd", [1.0, 2.0]), ("bcde", [3.0, 5.0])], "token string, vec array<double>")
    tokens = spark.createDataFrame([(f"{w}{i}",) for i in range(10) for w in ("abcx", "bcdx", "qq")], "token string")
    whole = {r.token: (r.grams, r.vec) for r in wv.backoff_vectors(tokens, vectors, 2).collect()}
    monkeypatch.setattr(wv, "BACKOFF_TOKENS", 2)
    dealt = wv.backoff_vectors(tokens, vectors, 2)
    # no task adds up more tokens as the input grows, and their sums are not shuffled again
    assert dealt.rdd.getNumPartitions() == 15
    assert {r.token: (r.grams, r.vec) for r in dealt.collect()} == whole and len(whole) == 30
    assert whole["abcx1"][0] > 0 and whole["qq1"] == (0, [0.0, 0.0])
