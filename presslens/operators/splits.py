"""Hold-outs and class weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from presslens.operators.ordered import ranked, ranked_within
from presslens.session import few_rows


def split_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_split(df: DataFrame, id_col: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``holdout`` 0/1 from a hash of the id: no shuffle, the same in every run."""
    limit = format(int(fraction * 2**32), "08x")
    return df.withColumn("holdout", (F.substring(split_hash(id_col, seed), 1, 8) < limit).cast("int"))


def quota_split(df: DataFrame, id_col: str, label_col: str = "label", fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``holdout`` with exactly the rounded share of every label held out."""
    keyed = df.select(id_col, label_col, split_hash(id_col, seed).alias("_h"))
    order = ranked_within(keyed, label_col, [F.col("_h"), F.col(id_col)], "_place")
    quota = keyed.groupBy(label_col).agg(F.round(F.count("*") * fraction).alias("_quota"))
    held = order.join(few_rows(quota), label_col).where(F.col("_place") <= F.col("_quota")).select(id_col, F.lit(1).alias("_held"))
    return df.join(held, id_col, "left").withColumn("holdout", F.coalesce("_held", F.lit(0))).drop("_held")


def tail_split(df: DataFrame, id_col: str, fraction: float = 0.2) -> DataFrame:
    """Add ``holdout`` for the last share of rows in id order (ids are unique).

    Only the ids are ordered; the rows themselves are compared to one boundary id.
    """
    places = ranked(df.select(id_col), [F.col(id_col)], "_place")
    n = df.count()
    first_held = math.floor(n * (1 - fraction)) + 1
    boundary = places.where(F.col("_place") == first_held).agg(F.min(id_col)).scalar()
    return df.withColumn("holdout", F.coalesce(F.col(id_col) >= boundary, F.lit(False)).cast("int"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, n, weight)`` with weight = rows / (classes x rows of the class)."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n"))
    scale = counts.agg(F.sum("n") / F.count("*")).scalar()
    return counts.withColumn("weight", scale / F.col("n"))


def with_class_weight(df: DataFrame, label_col: str = "label", out_col: str = "weight") -> DataFrame:
    weights = class_weights(df, label_col).select(label_col, F.col("weight").alias(out_col))
    return df.join(few_rows(weights), label_col)
