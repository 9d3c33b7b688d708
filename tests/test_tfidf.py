import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from presslens.operators import tfidf

TEXTS = [
    (1, "red fox runs", "the red fox runs fast"),
    (2, "", "blue sky"),
    (3, "blue sky blue", "a red house, the RED house"),
    (4, "same words here", "same words here"),
    (5, None, None),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(TEXTS, "article_id bigint, title string, content string")


def terms(text):
    ws = re.findall(r"\w\w+", (text or "").lower())
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def brute(max_features=50_000, sides=(1, 2)):
    docs = [Counter(terms(row[s])) for s in sides for row in TEXTS]
    cf, df_ = Counter(), Counter()
    for d in docs:
        cf.update(d)
        df_.update(d.keys())
    kept = sorted(cf, key=lambda t: (-cf[t], t))[:max_features]
    return {t: (df_[t], cf[t], math.log((1 + len(docs)) / (1 + df_[t])) + 1) for t in kept}


def weights(text, fit):
    return {t: n * fit[t][2] for t, n in Counter(terms(text)).items() if t in fit}


def cos(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
    return sum(a[t] * b.get(t, 0) for t in a) / (na * nb) if na * nb else 0.0


@pytest.mark.parametrize("limit", [50_000, 7])
def test_fit_and_pair_cosine(df, limit):
    fit = brute(limit)
    model = tfidf.fit_tfidf(df, "title", "content", max_features=limit)
    assert {r.term: (r.df, r.cf, pytest.approx(r.idf)) for r in model.table.collect()} == fit
    got = {r.article_id: r.cos_sim for r in tfidf.pair_cosine(df, model, "title", "content").collect()}
    for i, t, c in TEXTS:
        assert got[i] == pytest.approx(cos(weights(t, fit), weights(c, fit)), abs=1e-12)
    assert got[4] == pytest.approx(1.0) and got[5] == 0.0


def test_centroid_and_norm(df):
    fit = brute(sides=(2,))
    model = tfidf.fit_tfidf(df, "content")
    rows = [weights(t[2], fit) for t in TEXTS]
    mean = Counter()
    for w in rows:
        n = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            mean[t] += x / n / len(TEXTS)
    table = tfidf.centroid(df, model, "content")
    assert {r.term: pytest.approx(r.mean_weight) for r in table.collect()} == dict(mean)
    near = {r.article_id: r.cos_tfidf_mean for r in tfidf.centroid_cosine(df, model, table, "content").collect()}
    raw = {r.article_id: r.tfidf_norm for r in tfidf.tfidf_norm(df, model, "content").collect()}
    one = {r.article_id: r.tfidf_norm for r in tfidf.tfidf_norm(df, model, "content", normalised=True).collect()}
    for (i, _, _), w in zip(TEXTS, rows):
        assert near[i] == pytest.approx(cos(w, mean))
        assert raw[i] == pytest.approx(math.sqrt(sum(x * x for x in w.values())))
        assert one[i] == (1.0 if w else 0.0)


@pytest.mark.parametrize("limit", [12, 5000])
def test_centroid_is_added_up_in_tasks(spark, monkeypatch, limit):
    monkeypatch.setattr(tfidf, "WORDS_AT_ONCE", 40)
    pool, rng = ["ab", "cd", "ÄÖ", "x" * 70, "y" * 40, *[f"w{i}" for i in range(30)]], random.Random(6)
    rows = [(i, " ".join(pool[min(int(rng.expovariate(0.15)), 34)] for _ in range(rng.randrange(60)))) for i in range(50)]
    df = spark.createDataFrame([*rows, (50, None), (51, ""), *rows[:2]], "article_id bigint, content string").repartition(3)
    model = tfidf.fit_tfidf(df, "content", max_features=limit)
    found = tfidf.centroid(df, model, "content")
    want = Counter()
    for r in tfidf.unit_weights(df.withColumn("article_id", F.monotonically_increasing_id()), model, "content").collect():
        want[r.term] += r.weight / 54
    assert {r.term: r.mean_weight for r in found.collect()} == {t: pytest.approx(x) for t, x in want.items()}
    assert dict(found.dtypes) == {"term": "string", "term_index": "int", "mean_weight": "double"}
    # no row per text and term is made
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_unit_weights(df):
    fit = brute(sides=(2,))
    model = tfidf.fit_tfidf(df, "content")
    got = {(r.article_id, r.term): r.weight for r in tfidf.unit_weights(df, model, "content").collect()}
    want = {}
    for i, _, content in TEXTS:
        w = weights(content, fit)
        want |= {(i, t): x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    assert got == {k: pytest.approx(x) for k, x in want.items()}


@pytest.mark.parametrize("sortable", [0, 100])
@pytest.mark.parametrize("limit", [1, 2, 4, 6])
def test_most_counted_cuts_ties_by_term(spark, limit, sortable):
    counts = {"b": 3, "a": 3, "c": 2, "f": 1, "e": 1, "d": 1}
    stats = spark.createDataFrame([(t, 1, n) for t, n in counts.items()], "term string, df long, cf long")
    kept = tfidf.most_counted(stats, limit, sortable)
    assert {r.term for r in kept.collect()} == set("abcdef"[:limit])
    if not sortable:
        assert "TakeOrdered" not in kept._jdf.queryExecution().executedPlan().toString()


def test_words_are_found_once_per_text(spark):
    assert str(tfidf.terms(F.col("content"))).count("regexp_extract_all") == 1


@pytest.mark.parametrize("limit", [40, 5000])
def test_only_terms_of_frequent_words_are_counted(spark, monkeypatch, limit):
    monkeypatch.setattr(tfidf, "WORDS_AT_ONCE", 50)
    pool, rng = ["ab", "cd", "ef", "ÄÖ", "x" * 70, "y" * 70, *[f"w{i}" for i in range(60)]], random.Random(5)
    rows = [(i, *[" ".join(pool[min(int(rng.expovariate(0.12)), 65)] for _ in range(n)) for n in (i % 4, rng.randrange(90))]) for i in range(80)]
    df = spark.createDataFrame([*rows, (80, None, None)], "article_id bigint, title string, content string").repartition(3)
    every = {r.term: (r.df, r.cf) for r in tfidf.term_statistics(df, "title", "content").collect()}
    found = {r.term: (r.df, r.cf) for r in tfidf.frequent_statistics(df, "title", "content", limit=limit).collect()}
    assert found.items() <= every.items()
    order = sorted(every, key=lambda t: (-every[t][1], t))[:limit]
    assert set(order) <= set(found) and (limit == 5000 or len(found) < len(every))
    kept = tfidf.fit_tfidf(df, "title", "content", max_features=limit).table.collect()
    assert {r.term: (r.df, r.cf) for r in kept} == {t: every[t] for t in order}


def test_words_alone_may_not_tell_the_kept_terms(df):
    # no term lies above the count of the 7th word, so all are counted
    assert tfidf.frequent_statistics(df, "title", "content", limit=7) is None
    fit = brute(7)
    assert {r.term: (r.df, r.cf, pytest.approx(r.idf)) for r in tfidf.fit_tfidf(df, "title", "content", max_features=7).table.collect()} == fit


def test_most_counted_of_nothing(spark):
    assert tfidf.most_counted(spark.createDataFrame([], "term string, df long, cf long"), 5).count() == 0


def test_long_terms_are_kept_whole(spark):
    word = "x" * 500
    df = spark.createDataFrame([(1, word, f"{word} yy"), (2, "yy", "zz")], "article_id bigint, title string, content string")
    model = tfidf.fit_tfidf(df, "title", "content")
    assert word in {r.term for r in model.table.collect()}
    assert max(map(len, model.keys)) <= 65
    got = {r.article_id: r.cos_sim for r in tfidf.pair_cosine(df, model, "title", "content").collect()}
    assert got[1] > 0.4 and got[2] == 0.0


def test_transform_needs_no_shuffle_and_no_python(df):
    model = tfidf.fit_tfidf(df, "title", "content")
    plan = tfidf.pair_cosine(df, model, "title", "content")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_limits(df):
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(df, "title", max_features=0)
    stacked = tfidf.stacked(df, "title", "content")
    assert stacked.groupBy("side").count().where(F.col("count") == 5).count() == 2
