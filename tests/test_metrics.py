import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from presslens.functions import scoring
from presslens.operators import metrics


@pytest.fixture
def golden(spark):
    rows = [(1, 0.9, 1), (1, 0.5, 1), (0, 0.5, 1), (0, 0.1, 0), (None, 0.7, 1)]
    return spark.createDataFrame(rows, "y int, prob double, pred int")


def test_goldens(golden):
    assert {(r.y, r.pred): r.n for r in metrics.confusion(golden).collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    assert list(metrics.precision_recall_f1(golden).first()) == pytest.approx([0.75, 2 / 3, 1.0, 0.8])
    assert metrics.accuracy(golden).first()[0] == 0.75
    assert metrics.auroc(golden).first()[0] == 0.875
    assert metrics.evaluate(golden).first()["ROC-AUC"] == 0.875


def test_curves(golden):
    roc = [(r.fpr, r.tpr) for r in metrics.roc_curve(golden).orderBy(F.col("threshold").desc()).collect()]
    assert roc == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]
    pr = [(r.threshold, r.recall) for r in metrics.pr_curve(golden).orderBy(F.col("threshold").asc_nulls_last()).collect()]
    assert pr == [(0.1, 1.0), (0.5, 1.0), (0.9, 0.5), (None, 0.0)]


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.2, 0), (1, 0.9, 1)], "y int, prob double, pred int")
    assert metrics.auroc(df).first()[0] is None
    assert metrics.evaluate(df).first()["Accuracy"] == 0.5
    empty = df.where("y = 5")
    assert metrics.precision_recall_f1(empty).first()["f1"] == 0.0


def test_auroc_equals_sparks_evaluator(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), rng.randint(0, 40) / 40) for _ in range(3000)]
    df = spark.createDataFrame(rows, "y int, prob double").withColumn("pred", scoring.decide_threshold(F.col("prob")))
    want = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="y", numBins=0).evaluate(df.withColumn("y", F.col("y").cast("double")))
    assert metrics.auroc(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_decisions(one):
    assert one(scoring.decide_argmax(F.lit(1.0), F.lit(1.0))) == 0
    assert one(scoring.decide_threshold(F.lit(0.5))) == 1
    assert one(scoring.softmax_positive(F.lit(0.3), F.lit(0.3))) == 0.5
    assert one(scoring.one_hot(F.lit(1))) == [0, 1]
    assert one(scoring.clip_unit(F.lit(1.7)), scoring.clip_unit(F.lit(-1.0))) == (1.0, 0.0)


def test_best_step_prefers_the_first(spark):
    rows = [(1, "validation", "accuracy", 0.7), (2, "validation", "accuracy", 0.9), (3, "validation", "accuracy", 0.9), (4, "train", "accuracy", 1.0)]
    history = spark.createDataFrame(rows, "step int, split string, metric string, value double")
    assert metrics.best_step(history, "accuracy").first().step == 2
    assert [tuple(r) for r in metrics.best_steps(history).collect()] == [("accuracy", 2, 0.9)]
    assert [r.validation for r in metrics.history_by_split(history, "accuracy").orderBy("step").collect()] == [0.7, 0.9, 0.9, None]
