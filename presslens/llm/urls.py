"""URL filter: exact rule lookup through a cascade of Bloom filters.

Listed keys are rules (``host/path-prefix``) and hosts. The first filter holds the listed keys;
the next holds those unlisted keys of the corpus that the first one wrongly accepts; the next
the listed keys that this one wrongly accepts, and so on until no error is left. The levels
are built from the complete set of keys that the corpus can ask for, so every answer over
that corpus is exact, and judging a url is a map over rows without a join.

A url's keys are the suffixes of its host times the starts of its path, only for the numbers
of labels and the path lengths that occur among the listed rules. Null urls and urls without
``://`` have an empty host and path and match nothing. Repeated urls get equal answers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presslens.session import scratch_path

BITS_PER_KEY = 12
PROBES = 8
MAX_FILTER_BYTES = 64 * 2**20
MAX_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, path


@dataclass(frozen=True)
class Rules:
    """Verdicts by rule, longest rule first; a rule is a host, then its path from the slash on."""

    verdicts: dict[str, str]

    def shapes(self) -> list[tuple[int, int]]:
        """(labels of the host, length of the path) that occur, longest paths first."""
        found = {(r.partition("/")[0].count(".") + 1, len(r) - len(r.partition("/")[0])) for r in self.verdicts}
        return sorted(found, reverse=True)


def rule_keys(rules: Rules, host: Column, path: Column) -> Column:
    """Every rule that could fit the url: array of keys, null where the url has no such part."""
    keys = []
    for labels, size in rules.shapes():
        suffix = F.substring_index(host, ".", -labels)
        enough = (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1 >= labels) & (F.length(path) >= size)
        keys.append(F.when(enough, F.concat(suffix, F.substring(path, 1, size))))
    return F.array(*keys) if keys else F.array().cast("array<string>")


def host_key(host: Column) -> Column:
    """A listed host as a key; the blank keeps it apart from rules."""
    return F.concat(F.lit("host "), host)


# ---- the cascade ----


@dataclass(frozen=True)
class Cascade:
    """Bit arrays of the levels; an odd number of passed levels means listed."""

    levels: tuple[bytes, ...]

    def size(self) -> int:
        return sum(map(len, self.levels))

    def listed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Membership of keys given by two 64-bit hashes."""
        passed = np.zeros(len(first), np.int64)
        alive = np.arange(len(first))
        for k, level in enumerate(self.levels):
            alive = alive[probe(level, first[alive], second[alive], k)]
            passed[alive] += 1
            if not len(alive):
                break
        return passed % 2 == 1


def positions(n_bits: int, first: np.ndarray, second: np.ndarray, level: int) -> np.ndarray:
    a, b = first.astype(np.uint64), second.astype(np.uint64) | np.uint64(1)
    mixed = (a ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((mixed + steps * b) >> np.uint64(3)) % np.uint64(n_bits)


def probe(level: bytes, first: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    bits = np.frombuffer(level, np.uint8)
    at = positions(8 * len(bits), first, second, k)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(1)).alias("first"), F.xxhash64(key, F.lit(2)).alias("second")]


def _filter(keys: DataFrame, level: int) -> bytes:
    """The bit array of a set of hashed keys; tasks set bits, blocks of bits meet by their number."""
    size = max(64, -(-keys.count() * BITS_PER_KEY // 8))
    if size > MAX_FILTER_BYTES:
        raise ValueError(f"a level needs {size} bytes; the limit for sharing it is {MAX_FILTER_BYTES}")
    block = 2**16

    def set_bits(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            first, second = (batch.column(k).to_numpy() for k in (0, 1))
            at = positions(8 * size, first, second, level).ravel()
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        used = [k for k in range(0, size, block) if bits[k : k + block].any()]
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(used, pa.int64()), "bits": pa.array([bits[k : k + block].tobytes() for k in used], pa.binary())}
        )

    def union(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, bits in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.frombuffer(bits, np.uint8)
                blocks[at] = blocks[at] | new if at in blocks else new
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(list(blocks), pa.int64()), "bits": pa.array([b.tobytes() for b in blocks.values()], pa.binary())}
        )

    schema = "at long, bits binary"
    parts = keys.mapInArrow(set_bits, schema).repartition("at").mapInArrow(union, schema)
    out = np.zeros(size, np.uint8)
    for row in parts.collect():
        out[row.at : row.at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact over ``universe`` and ``listed`` (one string column ``key`` each).

    Both may hold repeated keys and nulls. Every key is written once, with its two hashes, to
    the shared folder; each level then reads only what its predecessor got wrong.
    """
    spark = listed.sparkSession
    marked = listed.select("key", F.lit(True).alias("listed")).union(universe.select("key", F.lit(False)))
    keys = marked.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed"))
    path = scratch_path(spark, "keys")
    keys.select(*hashes(F.col("key")), "listed").write.parquet(path)
    keys = spark.read.parquet(path)
    inside, outside = keys.where("listed"), keys.where("not listed")
    levels: list[bytes] = []
    while len(levels) < MAX_LEVELS:
        side = inside if len(levels) % 2 == 0 else outside
        if levels and side.isEmpty():
            return Cascade(tuple(levels))
        levels.append(_filter(side.select("first", "second"), len(levels)))
        wrong = _accepted(levels[-1], len(levels) - 1)
        other = outside if len(levels) % 2 else inside
        kept = other.where(wrong("first", "second"))
        if len(levels) % 2:
            outside = kept
        else:
            inside = kept
    raise ValueError("two keys share both hashes, so no filter tells them apart")


def _accepted(level: bytes, k: int):
    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        return pa.array(probe(level, first.to_numpy(), second.to_numpy(), k))

    return F.arrow_udf(run, "boolean")


def membership(cascade: Cascade, keys: Column) -> Column:
    """Array of booleans for an array of keys; null keys are not listed."""

    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        flat = [x.flatten().to_numpy() for x in (first, second)]
        return pa.ListArray.from_arrays(first.offsets, pa.array(cascade.listed(*flat)))

    def hashed(n: int) -> Column:
        return F.transform(keys, lambda k: F.xxhash64(k, F.lit(n)))

    found = F.arrow_udf(run, "array<boolean>")(hashed(1), hashed(2))
    return F.zip_with(keys, found, lambda k, f: k.isNotNull() & f)


def judge(urls: DataFrame, rules: Rules, listed_hosts: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict; columns of these names are replaced.

    The longest fitting rule decides; without one, a url of a host in ``listed_hosts`` (column
    ``host``) is blocked and any other gets ``default``.
    """
    spark = urls.sparkSession
    host, path = host_and_path(F.col(url))
    parts = urls.select(host.alias("host"), path.alias("path"))
    universe = parts.select(F.explode(F.array_append(rule_keys(rules, F.col("host"), F.col("path")), host_key(F.col("host")))).alias("key"))
    fixed = spark.createDataFrame([(r,) for r in rules.verdicts], "key string")
    cascade = build(fixed.union(listed_hosts.select(host_key(F.col("host")))), universe)

    keys = F.array_append(rule_keys(rules, F.col("host"), F.col("path")), host_key(F.col("host")))
    named = urls.withColumns({"host": host, "path": path})
    held = named.withColumn("_keys", keys).withColumn("_listed", membership(cascade, F.col("_keys")))
    last = F.size("_keys") - 1
    fits = F.filter(F.slice("_keys", 1, last), lambda k, i: F.get("_listed", i))
    longest = F.reduce(fits, F.lit(None).cast("string"), lambda best, k: F.when(best.isNull() | (F.length(k) > F.length(best)), k).otherwise(best))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.verdicts.items() for x in pair])
    ruled = held.withColumn("rule", longest)
    other = F.when(F.get("_listed", last), F.lit("block")).otherwise(F.lit(default))
    return ruled.withColumn("verdict", F.when(F.col("rule").isNull(), other).otherwise(F.get(F.map_values(F.map_filter(verdicts, lambda k, v: k == F.col("rule"))), F.lit(0)))).drop("_keys", "_listed")


def spam_hosts(urls: DataFrame, words: Sequence[str], url: str = "url") -> DataFrame:
    """Hosts of the corpus with a label that has one of ``words`` between hyphens or borders."""
    host = host_and_path(F.col(url))[0]
    pattern = "(^|[.-])(" + "|".join(words) + ")([.-]|$)"
    return urls.select(host.alias("host")).where(F.col("host").rlike(pattern)).distinct()
