"""Exact running totals, ranks and quantiles without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from presslens.session import cut, few_rows

# Up to this many counted rows are put in order by one task.
SORTABLE_ROWS = 500_000


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str], sortable: int = SORTABLE_ROWS) -> DataFrame:
    """Add, per entry ``out: column``, the sum of ``column`` over all rows up to this one; nulls add nothing.

    Rows are written and counted first. Few of them pass one window in one task; both ways
    give the same rows. More are shuffled once: range-partitioned and sorted in ``order`` (which must be
    unique) and written, because range bounds come from a sample that a second run could
    draw differently. Each slice is summed where it lies, in Arrow batches; only the slice
    totals, one row per partition, are added up in one task.
    """
    columns = df.columns
    df = cut(df)
    if df.count() <= sortable:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*columns, *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(o) for o, c in totals.items()])
    in_order = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sliced = cut(in_order.withColumn("_slice", F.spark_partition_id()))
    slice_sums = sliced.groupBy("_slice").agg(*[F.sum(c).alias(o) for o, c in totals.items()])
    kinds = {o: slice_sums.schema[o].dataType for o in totals}
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slice_sums.select(
        "_slice", *[F.coalesce(F.sum(o).over(earlier), F.lit(0)).cast(kind).alias(f"_before_{o}") for o, kind in kinds.items()]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto: dict[str, pa.Scalar] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = [batch.column(c) for c in columns]
            for out, c in totals.items():
                before = batch.column(f"_before_{out}")
                steps = pc.fill_null(batch.column(c).cast(before.type), pa.scalar(0).cast(before.type))
                sums = pc.add(pc.cumulative_sum(steps), upto.get(out, before[0])).cast(before.type)
                upto[out] = sums[-1]
                arrays.append(sums)
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *totals])

    placed = sliced.join(F.broadcast(offsets), "_slice").select(*columns, *[f"_before_{o}" for o in totals])
    return placed.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(o, kind) for o, kind in kinds.items()]]))


def ranked(df: DataFrame, order: list[Column], out_col: str) -> DataFrame:
    """Add the 1-based position in ``order``."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(ones, order, {out_col: "_one"}).drop("_one")


def ranked_within(df: DataFrame, group_col: str, order: list[Column], out_col: str) -> DataFrame:
    """Add the 1-based position inside each non-null group; a group may span many slices."""
    whole = ranked(df.where(F.col(group_col).isNotNull()), [F.col(group_col), *order], "_rank")
    first = whole.groupBy(group_col).agg(F.min("_rank").alias("_first"))
    return whole.join(few_rows(first), group_col).withColumn(out_col, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first")


def quantiles(df: DataFrame, col: str, probabilities: dict[str, float]) -> DataFrame:
    """One row with an interpolated quantile per entry ``out: probability``.

    Equal values are counted together first; the quantile is then read off the
    running count, so no task ever holds all values.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    upto = running_totals(counts, [F.col("v")], {"upto": "n"})
    last = upto.agg(F.max("upto")).scalar() - 1
    picks = []
    for name, p in probabilities.items():
        place = last * F.lit(float(p))
        low = F.min(F.when(F.col("upto") > F.floor(place), F.col("v")))
        high = F.min(F.when(F.col("upto") > F.ceil(place), F.col("v")))
        picks.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return upto.agg(*picks)
