import pytest
from pyspark.sql import functions as F

from presslens.operators import profile
from presslens.sources import articles as art


def test_headers_and_required_columns(spark):
    df = spark.createDataFrame([("a", "b", "1")], [" 뉴스제목", "본문 ", "가짜뉴스여부"])
    assert art.normalise_headers(df).columns == ["title", "content", "label"]
    with pytest.raises(ValueError, match="missing columns"):
        art.require_columns(df, "title")


def test_label_cast(one):
    assert one(art.label_int(F.lit("1.0"))) == 1
    assert one(art.label_int(F.lit("x"))) is None
    assert one(art.label_int(F.lit(None).cast("string"), null_as_zero=True)) == 0


ROWS = [("a", "x", 0, "s"), (None, "y", 1, "s"), ("b", None, 1, "s"), ("c", "z", None, None), ("d", "w", 1, None)]


def test_null_policies(spark):
    df = spark.createDataFrame(ROWS, "title string, content string, label int, source string")
    assert [r.title for r in art.apply_null_policy(df, "drop_any").collect()] == ["a"]
    assert {r.title for r in art.apply_null_policy(df, "drop_required").collect()} == {"a", "d"}
    filled = art.apply_null_policy(df, "fill").collect()
    assert [(r.title, r.content, r.label) for r in filled] == [("a", "x", 0), ("", "y", 1), ("b", "", 1), ("c", "z", 0), ("d", "w", 1)]
    with pytest.raises(ValueError):
        art.apply_null_policy(df, "other")


def test_label_domain_counts_null(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "label int")
    assert profile.label_domain(df).first()[0] == 2
    assert profile.null_rates(df).first()[0] == 25.0


def test_duplicates(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] + [(None, "n")] * 2, "title string, content string")
    assert profile.duplicates(df, "title", "content").first()[0] == 3


def test_histogram_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "v double")
    assert [r.n for r in profile.histogram(df, "v", 2).orderBy("bin").collect()] == [1, 2]
    flat = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [r.n for r in profile.histogram(flat, "v", 2).orderBy("bin").collect()] == [0, 4]


def test_describe_equals_pandas(spark):
    values = [0.3, 0.1, 0.1, 2.5, -1.0, 7.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = df.toPandas()["v"].describe()
    got = profile.describe(df, "v").first()
    assert list(got) == pytest.approx(list(want))
    near = profile.describe_approx(df, "v").first()
    assert near["count"] == 6 and near["max"] == 7.0


def test_density_integrates_to_one(spark):
    df = spark.range(200).select(((F.col("id") * 37) % 101 / 100.0).alias("v"), (F.col("id") % 2).alias("g"))
    rows = profile.density(df, "v", by="g").orderBy("g", "point").collect()
    for g in (0, 1):
        xs = [r.x for r in rows if r.g == g]
        area = sum(r.density for r in rows if r.g == g) * (xs[1] - xs[0])
        assert len(xs) == 200 and area == pytest.approx(1.0, abs=0.01)


def test_top_k_breaks_ties_by_id_and_plans_as_top_k(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 0.0), (4, None)], "article_id bigint, f double")
    assert [r.article_id for r in profile.top_k(df, "f", 2).collect()] == [1, 3]
    assert [r.article_id for r in profile.top_k(df, "f", 3, lowest=True).collect()] == [2, 1, 3]
    assert "TakeOrderedAndProject" in profile.top_k(df, "f", 2)._jdf.queryExecution().toString()
