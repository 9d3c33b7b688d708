import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.operators import ordered
from presslens.operators.ordered import quantiles, ranked, ranked_within, running_totals


@pytest.fixture(params=["one task", "slices"], autouse=True)
def way(request, monkeypatch):
    """Every test runs both ways; a default argument is fixed, so the function's own is changed."""
    if request.param == "slices":
        monkeypatch.setattr(ordered.running_totals, "__defaults__", (0,))


def test_running_totals_match_numpy(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 5)) for i in range(5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, n int").repartition(7)
    got = [r.upto for r in running_totals(df, [F.col("k").desc()], {"upto": "n"}).orderBy(F.col("k").desc()).collect()]
    want = np.cumsum([n for _, n in sorted(rows, reverse=True)])
    assert got == want.tolist()


def test_running_totals_shuffle_rows_once_and_skip_nulls(spark):
    rows = [(i, None if i % 3 == 0 else i, i / 4) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, n int, x double")
    out = running_totals(df, [F.col("k")], {"n_upto": "n", "x_upto": "x"}, sortable=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") <= 1  # of slice sums alone
    assert dict(out.dtypes)["n_upto"] == "bigint"
    got = out.orderBy("k").collect()
    assert [r.n_upto for r in got] == np.cumsum([n or 0 for _, n, _ in rows]).tolist()
    assert [r.x_upto for r in got] == pytest.approx(np.cumsum([x for *_, x in rows]).tolist())


def test_rank_spreads_over_slices(spark):
    df = spark.range(0, 40000, 2).withColumn("id", F.col("id") * 7919 % 40009)
    out = ranked(df, [F.col("id")], "place")
    assert [r.place for r in out.orderBy("id").collect()] == list(range(1, 20001))
    assert out.rdd.getNumPartitions() > 1 or out.count() == 20000


def test_rank_within_a_group_holding_most_rows(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(5)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = {(r.g, r.v): r.place for r in ranked_within(df, "g", [F.col("v").desc()], "place").collect()}
    assert got == {(g, v): (3000 if g == "hot" else 5) - v for g, v in rows if g}


@pytest.mark.parametrize("n", [1, 2, 5, 100])
def test_quantiles_interpolate(spark, n):
    values = [(i * 37 % 11) / 3 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    assert list(quantiles(df, "v", probs).first()) == pytest.approx(np.quantile(values, list(probs.values())).tolist())
