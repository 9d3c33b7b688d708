"""Equi-join of many rows to a keyed table when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from presslens.operators.tfidf import bounded_key
from presslens.session import cut

# A table is broadcast whole only if it was measured to be smaller than this.
BROADCAST_BYTES = 64 * 2**20
# Beyond that, what is broadcast is bounded by as many keys; one over 64 characters goes by its digest.
HOT_KEYS = 20_000


def _short(table: DataFrame, key: str) -> Column:
    """``bounded_key`` of a text key; keys of other types are short as they are."""
    return bounded_key(F.col(key)) if isinstance(table.schema[key].dataType, StringType) else F.col(key)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """``_key``: the keys of ``rows`` with more than 1/HOT_KEYS of them, so fewer than HOT_KEYS.

    Rows are counted with map-side combine; nothing is put in order.
    """
    counts = cut(rows.where(F.col(key).isNotNull()).groupBy(_short(rows, key).alias("_key")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * HOT_KEYS > total).select("_key")


def broadcasts(table: DataFrame, key: str, payload_bytes: int) -> int:
    """Measure the table, key bytes plus the given bytes per row: how many broadcasts hold it."""
    size = table.agg(F.sum(F.octet_length(F.col(key).cast("string")) + F.lit(payload_bytes).cast("bigint"))).first()[0]
    return max(1, -(-(size or 0) // max(1, BROADCAST_BYTES)))


def fits_broadcast(table: DataFrame, key: str, payload_bytes: int) -> bool:
    return broadcasts(table, key, payload_bytes) == 1


def lookup(rows: DataFrame, key: str, table: DataFrame, payload_bytes: int, keep_missing: bool = False) -> DataFrame:
    """Join ``rows`` to ``table``, whose ``key`` is unique; rows without a key stay only with ``keep_missing``.

    A table measured to be small is broadcast. With a large one, the hot keys of ``rows``,
    whether the table knows them or not, meet a broadcast slice of it and are never
    shuffled; what is left has no key with more than 1/HOT_KEYS of the rows and joins by
    shuffle. Measuring and counting run jobs while the plan is built. Pass rows and a
    table that are cheap to read again.
    """
    how = "left" if keep_missing else "inner"
    if fits_broadcast(table, key, payload_bytes):
        return rows.join(F.broadcast(table), key, how)
    hot = hot_keys(rows, key)
    slice_of_table = table.withColumn("_key", _short(table, key)).join(F.broadcast(hot), "_key", "left_semi").drop("_key")
    marked = rows.withColumn("_key", _short(rows, key)).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_key", "left").drop("_key")
    # Rows without a key would all meet in one task, so they stay with the hot ones.
    stays = F.col("_hot").isNotNull() | F.col(key).isNull()
    near = marked.where(stays).drop("_hot").join(F.broadcast(slice_of_table), key, how)
    far = marked.where(~stays).drop("_hot").join(table, key, how)
    return near.unionByName(far)
