"""Evaluation of predictions ``(y, prob, pred)``; rows with a null label are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslens.operators.ordered import running_totals
from presslens.session import cut

EPSILON = 1e-15


def _labelled(df: DataFrame) -> DataFrame:
    return df.where(F.col("y").isNotNull())


def _cells(df: DataFrame) -> DataFrame:
    """One row with the four counts, one map-side combined aggregate."""
    y, pred = F.col("y"), F.col("pred")
    return _labelled(df).agg(
        F.count_if((y == 0) & (pred == 0)).alias("tn"), F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"), F.count_if((y == 1) & (pred == 1)).alias("tp"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _f1(hit: Column, false_alarm: Column, missed: Column) -> Column:
    return _ratio(2.0 * hit, 2 * hit + false_alarm + missed)


def confusion(df: DataFrame) -> DataFrame:
    """``(y, pred, n)`` for all four cells, empty ones included."""
    cells = [
        F.struct(F.lit(y).alias("y"), F.lit(p).alias("pred"), F.col(c).alias("n"))
        for y, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return _cells(df).select(F.inline(F.array(*cells)))


def accuracy(df: DataFrame) -> DataFrame:
    return _labelled(df).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))


def precision_recall_f1(df: DataFrame) -> DataFrame:
    """One row for class 1; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    return _cells(df).select(
        F.when(total > 0, (tp + tn) / total).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"),
    )


def class_report(df: DataFrame) -> DataFrame:
    """Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg``.

    The accuracy row carries its value in ``f1`` only.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    per_class = _cells(df).select(
        "*",
        *[
            e.alias(n)
            for n, e in {
                "p0": _ratio(tn, tn + fn), "r0": _ratio(tn, tn + fp), "f0": _f1(tn, fn, fp), "s0": tn + fp,
                "p1": _ratio(tp, tp + fp), "r1": _ratio(tp, tp + fn), "f1": _f1(tp, fp, fn), "s1": tp + fn,
            }.items()
        ],
    )
    s0, s1 = F.col("s0"), F.col("s1")
    nothing = F.lit(None).cast("double")

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support")
        )

    def mean(m: str, weighted: bool) -> Column:
        a, b = F.col(m + "0"), F.col(m + "1")
        return _ratio(a * s0 + b * s1, s0 + s1) if weighted else (a + b) / 2.0

    return per_class.select(
        F.inline(
            F.array(
                row("0", F.col("p0"), F.col("r0"), F.col("f0"), s0),
                row("1", F.col("p1"), F.col("r1"), F.col("f1"), s1),
                row("accuracy", nothing, nothing, _ratio(tp + tn, s0 + s1), s0 + s1),
                row("macro avg", *[mean(m, False) for m in "prf"], s0 + s1),
                row("weighted avg", *[mean(m, True) for m in "prf"], s0 + s1),
            )
        )
    )


def _score_counts(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return _labelled(df).groupBy("prob").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def auroc(df: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, ties at half weight; null for one class."""
    run = running_totals(_score_counts(df), [F.col("prob")], {"neg_upto": "neg"})
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return run.agg(F.when(pairs > 0, won / pairs).alias("auroc"))


def _curve(df: DataFrame) -> DataFrame:
    """Counts at or above each distinct score, with the totals beside them."""
    counts = _score_counts(df)
    run = running_totals(counts, [F.col("prob").desc()], {"tp": "pos", "fp": "neg"})
    totals = run.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return run.withColumn("all", totals)


def roc_curve(df: DataFrame) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score, from (0, 0) at infinity."""
    points = _curve(df).select(
        F.col("prob").alias("threshold"),
        F.when(F.col("all.n") > 0, F.col("fp") / F.col("all.n")).alias("fpr"),
        F.when(F.col("all.p") > 0, F.col("tp") / F.col("all.p")).alias("tpr"),
    )
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return start.unionAll(points)


def pr_curve(df: DataFrame) -> DataFrame:
    """``(threshold, precision, recall)`` for every distinct score, ending at (1, 0)."""
    points = _curve(df).select(
        F.col("prob").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("all.p") > 0, F.col("tp") / F.col("all.p")).otherwise(F.lit(1.0)).alias("recall"),
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema)
    return points.unionAll(end)


def log_loss(df: DataFrame) -> DataFrame:
    """Mean cross-entropy, probabilities kept off 0 and 1."""
    p = F.greatest(F.lit(EPSILON), F.least(F.col("prob"), F.lit(1 - EPSILON)))
    return _labelled(df).agg(F.avg(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p))).alias("log_loss"))


def pearson(df: DataFrame) -> DataFrame:
    return _labelled(df).agg(F.corr(F.col("y").cast("double"), F.col("prob")).alias("pearson_r"))


def evaluate(df: DataFrame, loss: bool = False) -> DataFrame:
    """One row with everything the JSON report holds; ``loss`` adds the mean cross-entropy."""
    df = cut(_labelled(df).select("y", "prob", "pred"))
    area = auroc(df).scalar()
    return precision_recall_f1(df).select(
        F.col("accuracy").alias("Accuracy"), F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
        F.col("f1").alias("F1"), area.alias("ROC-AUC"), area.alias("AUROC"),
        *([log_loss(df).scalar().alias("Loss")] if loss else []),
    )


def best_step(history: DataFrame, metric: str, split: str = "validation") -> DataFrame:
    """The history row with the greatest value; the earliest step wins ties."""
    rows = history.where((F.col("metric") == metric) & (F.col("split") == split))
    return rows.orderBy(F.col("value").desc_nulls_last(), "step").limit(1)


def best_steps(history: DataFrame, split: str = "validation") -> DataFrame:
    """``(metric, step, value)``: ``best_step`` of every metric at once."""
    rows = history.where((F.col("split") == split) & F.col("value").isNotNull())
    earliest = rows.groupBy("metric", "value").agg(F.min("step").alias("step"))
    return earliest.groupBy("metric").agg(F.max_by("step", "value").alias("step"), F.max("value").alias("value"))


def history_by_split(history: DataFrame, metric: str) -> DataFrame:
    """``(step, train, validation)`` for one metric."""
    rows = history.where(F.col("metric") == metric)
    return rows.groupBy("step").pivot("split", ["train", "validation"]).agg(F.max("value"))
