"""Data profile, distributions and ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from presslens.operators.ordered import quantiles

DENSITY_GROUPS = 1000


def null_rates(df: DataFrame, *columns: str) -> DataFrame:
    """One row: percent of nulls per column."""
    return df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"{c}_null_pct") for c in columns or df.columns])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))


def label_domain(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: how many labels are not 0 or 1; null is not."""
    valid = F.coalesce(F.col(label_col).isin(0, 1), F.lit(False))
    return df.agg(F.count_if(~valid).alias("invalid_labels"))


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows that repeat an earlier one in ``columns``; nulls are equal.

    Grouping by digests keeps whole texts out of the shuffle, and counting
    before it makes a much copied text cost one row per task.
    """
    keys = [F.sha2(F.col(c).cast("string"), 256).alias(f"k{i}") for i, c in enumerate(columns)]
    copies = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(columns))]).count()
    return copies.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, quartiles, maximum."""
    x = F.col(col)
    plain = df.agg(
        F.struct(
            F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"),
        ).alias("s")
    )
    quartiles = quantiles(df, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return quartiles.withColumn("s", plain.scalar()).select("s.count", "s.mean", "s.std", "s.min", "p25", "p50", "p75", "s.max")


def describe_approx(df: DataFrame, col: str, accuracy: int = 10_000) -> DataFrame:
    """``describe`` in one pass, with quartiles off by at most 1/accuracy in rank."""
    x = F.col(col)
    quarter = {name: F.percentile_approx(x, p, accuracy).alias(name) for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}
    return df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        *quarter.values(), F.max(x).alias("max"),
    )


def mean_by_label(df: DataFrame, feature: str, label_col: str = "label") -> DataFrame:
    return df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.avg(feature).alias(f"mean_{feature}"))


def histogram(df: DataFrame, col: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """``([by], bin, bin_start, n)`` over equal bins of [min, max], empty ones included.

    With ``by`` all groups share the bounds. A constant column gets a range of
    width 1 around its value.
    """
    rows = df.where(F.col(col).isNotNull())
    if by is not None:
        rows = rows.where(F.col(by).isNotNull())
    flat = F.min(col) == F.max(col)
    edge = rows.agg(
        F.struct(
            F.when(flat, F.min(col) - 0.5).otherwise(F.min(col)).alias("lo"),
            F.when(flat, F.max(col) + 0.5).otherwise(F.max(col)).alias("hi"),
        )
    ).scalar()
    lo, width = edge["lo"], edge["hi"] - edge["lo"]
    place = F.least(F.floor((F.col(col) - lo) / width * bins), F.lit(bins - 1)).cast("int")
    keys = [by] if by is not None else []
    counts = rows.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    # At most `bins` entries per group.
    filled = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"))
    return filled.select(
        *keys, "found", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        *keys,
        "bin",
        (lo + width * F.col("bin") / bins).alias("bin_start"),
        F.coalesce(F.try_element_at("found", F.col("bin")), F.lit(0)).cast("bigint").alias("n"),
    )


def density(df: DataFrame, col: str, by: str | None = None, points: int = 200, cut: float = 3.0) -> DataFrame:
    """``([by], point, x, density)``: Gaussian kernel density with Scott's bandwidth.

    The grid reaches ``cut`` bandwidths past the data. Scores stay where they lie: each
    task adds its own to one grid of sums, batch by batch, and the shuffle carries
    ``points`` rows per task and group. Groups of one value are left out; over
    ``DENSITY_GROUPS`` groups are an error.
    """
    spark = df.sparkSession
    keys = [by] if by is not None else []
    rows = df.where(F.col(col).isNotNull() & (F.col(by).isNotNull() if by else F.lit(True)))
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.stddev_samp(col).alias("std"), F.min(col).alias("lo"), F.max(col).alias("hi")
    ).where(F.col("std") > 0)
    h = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    step = (F.col("hi") - F.col("lo") + 2 * cut * h) / (points - 1)
    grids = stats.select(*keys, "n", h.alias("h"), (F.col("lo") - cut * h).alias("start"), step.alias("step")).limit(DENSITY_GROUPS + 1).collect()
    if len(grids) > DENSITY_GROUPS:
        raise ValueError(f"over {DENSITY_GROUPS} groups")
    key_type = df.schema[by].dataType.simpleString() if by is not None else "int"
    listed = [(k, r[by] if by is not None else 0, r["n"], float(r["h"]), float(r["start"]), float(r["step"])) for k, r in enumerate(grids)]
    known = F.broadcast(spark.createDataFrame(listed, f"g int, _key {key_type}, n long, h double, start double, step double"))
    placed = rows.select((F.col(by) if by is not None else F.lit(0)).alias("_key"), F.col(col).cast("double").alias("v"))
    sums = placed.join(known.select("g", "_key"), "_key").select("g", "v").mapInArrow(
        _grid_sums([x[3:] for x in listed], points), "g int, point int, total double"
    )
    x = F.col("start") + F.col("step") * F.col("point")
    scale = F.col("n") * F.col("h") * F.sqrt(2 * F.pi())
    totals = sums.groupBy("g", "point").agg(F.sum("total").alias("total")).join(known, "g")
    return totals.select(*[F.col("_key").alias(k) for k in keys], "point", x.alias("x"), (F.col("total") / scale).alias("density"))


def _grid_sums(grids: list[tuple[float, float, float]], points: int):
    """Per task and group, the sum of every score's kernel at every grid point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            group, value = batch.column("g").to_numpy(), batch.column("v").to_numpy()
            for g in np.unique(group).tolist():
                h, start, step = grids[g]
                at = start + step * np.arange(points)
                mine = value[group == g]
                for k in range(0, len(mine), 4096):
                    z = (at - mine[k : k + 4096, None]) / h
                    totals[g] = totals.get(g, 0) + np.exp(-z * z / 2).sum(0)
        for g, total in totals.items():
            columns = [pa.array(np.full(points, g, np.int32)), pa.array(np.arange(points, dtype=np.int32)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["g", "point", "total"])

    return run


def top_k(df: DataFrame, feature: str, k: int, id_col: str = "article_id", lowest: bool = False) -> DataFrame:
    """The k rows with the highest (or lowest) feature; ties by id."""
    order: Column = F.col(feature).asc_nulls_last() if lowest else F.col(feature).desc_nulls_last()
    return df.orderBy(order, id_col).limit(k)


def head(df: DataFrame, id_col: str = "article_id", k: int = 5) -> DataFrame:
    return df.orderBy(id_col).limit(k)
