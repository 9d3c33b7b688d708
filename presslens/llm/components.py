"""Connected components of a table of links by alternating stars, in DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presslens.session import scratch_path

# A written table of at most so many narrow rows is grouped and joined in one task.
ROWS_TOGETHER = 250_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def together(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as one partition where it was counted to be small (``rows``, if known): what groups it or joins it with
    another such table then takes one task and no exchange, however many partitions a shuffle has. Larger tables are left alone.
    """
    return df.coalesce(1) if (df.count() if rows is None else rows) <= ROWS_TOGETHER else df


def _each(df: DataFrame, *pairs: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """Every row once for each pair of its columns."""
    x, y = names
    made = F.array(*[F.struct(F.col(a).alias(x), F.col(b).alias(y)) for a, b in pairs])
    return df.select(F.inline(made))


def _both_ways(edges: DataFrame) -> DataFrame:
    return _each(edges, ("a", "b"), ("b", "a"), names=("u", "v"))


def _star(pairs: DataFrame, emit: DataFrame) -> DataFrame:
    """Every ``emit`` pair (u, v) moved to the least of u and its neighbours in ``pairs``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = emit.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Large stars hang higher neighbours on the least one, small stars do the same for lower
    ones; both keep components and end in stars. Rows are grouped only to take minima. Few
    links are gone through in one task a step.
    """
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rows, state = edges.count(), None
    while True:
        edges = together(edges, rows)
        ways = _both_ways(edges)
        large = together(saved(_star(ways, ways.where("v > u")), "large"), rows)
        # b is above a, so a small star moves b's lower neighbours and b itself
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        both = _each(large, ("b", "a"), ("b", "b"), names=("u", "v"))
        edges = saved(_star(down, both).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "small")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        rows, state = now[0], now
    return _each(together(edges, rows), ("b", "a"), ("a", "a"), names=("node", "component")).distinct()
