import hashlib

import pytest
from pyspark.sql import functions as F

from presslens.operators import splits


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(200).select(F.col("id").alias("article_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))


def held(frame):
    return {r.article_id for r in frame.where("holdout = 1").collect()}


def test_hash_split_is_reproducible_and_shuffle_free(df):
    want = {i for i in range(200) if hashlib.md5(f"42:{i}".encode()).hexdigest()[:8] < "19999999"}
    out = splits.hash_split(df, "article_id")
    assert held(out) == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_quota_split_is_exact_per_label(df):
    out = splits.quota_split(df, "article_id")
    assert {r.label: r.n for r in out.where("holdout = 1").groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 15, 1: 5}
    assert out.count() == 200


def test_tail_split(df):
    assert held(splits.tail_split(df.where("article_id < 11"), "article_id")) == {8, 9, 10}
    assert held(splits.tail_split(df, "article_id")) == set(range(160, 200))
    assert held(splits.tail_split(df.where("article_id < 0"), "article_id")) == set()


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int")
    assert {r.label: r.weight for r in splits.class_weights(df).collect()} == {0: pytest.approx(2 / 3), 1: 2.0}
    assert splits.with_class_weight(df.dropna()).where("weight = 2.0").count() == 1
