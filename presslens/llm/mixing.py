"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents that belong to the same set of sources form a pattern; only the patterns' sizes
meet in the driver. The flow routes each pattern's capacity to the quotas of its sources: a
pattern can give its whole size once at cost 0, again at cost 1, a third time at cost 2 and
so on, so repetition is used only where a quota can't be met without it. Within a pattern
documents are then taken in a seeded order until the flow is used up; the last one may be
taken in part.

Targets: sources weigh 5, 2, 1, repeating in the order of their names (null last) and share a
multiple of all sizes; no target exceeds ``max_repeats`` times what its source has, and the
excess goes to the others by weight.

Null texts have size 0. Empty tables give empty results. Rows with the same id and text are
interchangeable; the order is by seeded digest of the id, then of the text.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from presslens.llm.common import WORD
from presslens.session import scratch_path

WEIGHTS = (5, 2, 1)
MAX_PATTERNS = 100_000
ROWS_PER_BUCKET = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], share: float = 1.5, max_repeats: int = 2, weights: Sequence[int] = WEIGHTS) -> dict[str | None, float]:
    """Quota of every source: by weight, capped, the excess shared again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap = {s: float(max_repeats * sizes[s]) for s in names}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > cap[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        free = [s for s in free if s not in full]
    return out


@dataclass
class _Edge:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, max_repeats: int = 2) -> dict[tuple, int]:
    """Words each pattern gives in all: cheapest way to fill the quotas (successive shortest paths).

    ``patterns``: words of each set of sources. A quota that the patterns can't fill is filled
    as far as they go. The network has a node for each pattern and source, none for documents.
    """
    nodes = {("pattern", p): k + 2 for k, p in enumerate(patterns)}
    nodes |= {("source", s): len(nodes) + 2 + k for k, s in enumerate(quotas)}
    graph: list[list[_Edge]] = [[] for _ in range(len(nodes) + 2)]

    def join(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(_Edge(b, room, cost, len(graph[b])))
        graph[b].append(_Edge(a, 0, -cost, len(graph[a]) - 1))

    tiers = {}
    for p, size in patterns.items():
        tiers[p] = range(len(graph[0]), len(graph[0]) + max_repeats)
        for k in range(max_repeats):
            join(0, nodes["pattern", p], size, k)
        for s in p:
            if s in quotas:
                join(nodes["pattern", p], nodes["source", s], max_repeats * size, 0)
    for s, quota in quotas.items():
        join(nodes["source", s], 1, quota, 0)
    height = [0] * len(graph)
    while True:
        cost, via = [float("inf")] * len(graph), [None] * len(graph)
        cost[0], queue = 0, [(0, 0)]
        while queue:
            c, a = heapq.heappop(queue)
            if c > cost[a]:
                continue
            for e in graph[a]:
                new = c + e.cost + height[a] - height[e.to]
                if e.room and new < cost[e.to]:
                    cost[e.to], via[e.to] = new, (a, e)
                    heapq.heappush(queue, (new, e.to))
        if via[1] is None:
            break
        height = [h + (c if c < float("inf") else 0) for h, c in zip(height, cost)]
        path, at = [], 1
        while at:
            path.append(via[at][1])
            at = via[at][0]
        room = min(e.room for e in path)
        for e in path:
            e.room -= room
            graph[e.to][e.back].room += room
    return {p: max_repeats * patterns[p] - sum(graph[0][k].room for k in tiers[p]) for p in patterns}


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sources: Column | None = None, **options) -> DataFrame:
    """One row for each document: doc_id, sources, size, source_size, target and taken.

    ``sources`` is an array of the sources a document belongs to (default: its ``source``
    alone); ``source_size`` and ``target`` are sums over them. A document in no source, with an
    empty or a null array, is never taken. Sizes are worked out once and written to the shared folder. Options are
    those of ``_mixture``.
    """
    return _mixture(docs, doc_id, text, sources, **options).drop("tie")


def _mixture(
    docs: DataFrame, doc_id: str, text: str, sources: Column | None = None, *,
    share: float = 1.5, max_repeats: int = 2, seed: int = 11, weights: Sequence[int] = WEIGHTS,
) -> DataFrame:
    spark = docs.sparkSession
    none = F.array().cast("array<string>")
    sources = F.array(F.col("source")) if sources is None else F.coalesce(F.array_sort(F.array_distinct(sources)), none)
    path = scratch_path(spark, "sizes")
    digest = F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    docs.select(
        F.col(doc_id).alias("doc_id"), sources.alias("sources"), word_count(F.col(text)).alias("size"),
        digest.alias("turn"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
    ).write.parquet(path)
    sized = spark.read.parquet(path)

    sums = sized.groupBy("sources").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} sets of sources")
    by_source: dict = {}
    for r in sums:
        for s in r.sources:
            by_source[s] = by_source.get(s, 0) + r.size
    quota = targets(by_source, share, max_repeats, weights)
    given = min_cost_flow(
        {tuple(r.sources): r.size for r in sums}, {s: int(q + 0.5) for s, q in quota.items()}, max_repeats
    )
    rows = [
        (list(r.sources), sum(by_source[s] for s in r.sources), float(sum(quota[s] for s in r.sources)),
         given[tuple(r.sources)] // r.size if r.size else 0, given[tuple(r.sources)] % r.size if r.size else 0)
        for r in sums
    ]
    plan = spark.createDataFrame(rows, "sources array<string>, source_size long, target double, whole long, part long")
    width = 1
    while 16**width * ROWS_PER_BUCKET < max((r.n for r in sums), default=0):
        width += 1
    return _taken(sized, plan, width).select("doc_id", "sources", "size", "source_size", "target", "taken", "tie")


def _taken(sized: DataFrame, plan: DataFrame, width: int) -> DataFrame:
    """Whole rounds for every document, one more for the first ones in seeded order.

    The seeded digests are cut into buckets by their first hex digits; sums of buckets tell
    where a pattern's part ends, and only that bucket's few rows are put in order.
    """
    sized = sized.withColumn("bucket", F.substring("turn", 1, width)).withColumn("pattern", F.to_json("sources"))
    plan = plan.withColumn("pattern", F.to_json("sources")).drop("sources")
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    placed = starts.join(F.broadcast(plan), "pattern")
    last = (F.col("start") < F.col("part")) & (F.col("part") < F.col("start") + F.col("words"))
    edges = placed.where(last).select("pattern", "bucket", "start")
    full = placed.groupBy("pattern").agg(
        F.max(F.when(F.col("start") + F.col("words") <= F.col("part"), F.col("bucket"))).alias("full_to")
    )
    known = sized.join(F.broadcast(plan.join(full, "pattern", "left")), "pattern", "left")
    known = known.join(F.broadcast(edges), ["pattern", "bucket"], "left")
    inner = F.sum("size").over(
        Window.partitionBy("pattern", "bucket").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    common = ["doc_id", "sources", "size", "source_size", "target", "tie"]
    base = F.col("whole") * F.col("size")
    plain = known.where(F.col("start").isNull()).select(
        *common, (base + F.when(F.col("bucket") <= F.col("full_to"), F.col("size")).otherwise(0)).alias("taken")
    )
    left = F.col("part") - F.col("start") - F.coalesce(inner, F.lit(0))
    edge = known.where(F.col("start").isNotNull()).withColumn("left", left).select(
        *common, (base + F.greatest(F.lit(0), F.least("size", "left"))).alias("taken")
    )
    return plain.unionByName(edge)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word; null for a null text."""

    def cut(t: str, k: int) -> str:
        last = next(islice(WORD.finditer(t), k - 1, None), None)
        return t[: last.end()] if last else t

    def run(texts: pa.Array, counts: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), counts.to_pylist())
        return pa.array([None if t is None else cut(t, k) for t, k in pairs], pa.string())

    return F.arrow_udf(run, "string")(text, n)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as it is taken, its last copy cut to the words taken.

    Rows keep their columns; ``n_chars`` follows the text where there is one. Rows with the
    same id and text take equal parts of what they are given together.
    """
    mark = "_"  # the working columns' names begin as no column of `docs` does
    while any(c.lower().startswith(f"{mark}mix_") for c in docs.columns):
        mark += "_"
    doc, tie, taken, rows, own, take, copy, room = (f"{mark}mix_{n}" for n in ("doc", "tie", "taken", "rows", "own", "take", "copy", "room"))
    counts = _mixture(docs, doc_id, text, **options).groupBy(F.col("doc_id").alias(doc), F.col("tie").alias(tie)).agg(
        F.sum("taken").alias(taken), F.count("*").alias(rows)
    )
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    joined = docs.join(counts, F.col(doc_id).eqNullSafe(F.col(doc)) & (digest == F.col(tie)))
    held = joined.withColumns({own: word_count(F.col(text)), take: F.floor(F.col(taken) / F.col(rows))})
    times = F.when(F.col(own) == 0, 0).otherwise(F.ceil(F.col(take) / F.col(own)))
    repeated = held.withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int"))))
    repeated = repeated.where(F.col(take) > 0).withColumn(room, F.col(take) - (F.col(copy) - 1) * F.col(own))
    partial = F.when(F.col(room) < F.col(own), F.col(text))
    out = repeated.withColumn(text, F.coalesce(first_words(partial, F.col(room)), F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
