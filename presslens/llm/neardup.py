"""Near-duplicates on word shingles through an LSH forest of MinHash signatures.

Texts with equal sets of shingles form a class at once. Each class's signature is laid out in
several orders, and each order is sorted: neighbours with a long common prefix are likely
near-duplicates. Every row looks at the ``WINDOW`` rows after it that share at least one
value, so the prefix it takes adapts to the region: where many texts are alike the rows in
reach share many values, elsewhere few. A one-bit sketch and the sizes drop most false
neighbours on the spot; the best ``NEAREST`` of each order become candidates. Rows for which
the window or this list was too short are marked and go through an exact join as well.

Candidates are confirmed on full sets, nearest first: once two texts are known to be in one
component their pair needs no check, the others get theirs. A candidate that fails
proposes the best linked text of the other side's component instead, so a copy that is near
only to the common original of a large group finds it; this goes on until nothing new turns
up. Then the marked rows are joined on their rarest shingles (prefix filter): any two of them
in different components that may still be linked are counted in full. Null texts count as empty; texts without words have no shingles and no links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from presslens.llm.common import bounded_sample
from presslens.llm.components import components, saved, together
from presslens.operators.ordered import ranked
from presslens.session import few_rows

WIDTH = 5
VALUES = 128
ORDERS = 16
DEPTH = 16
WINDOW = 64
REACH = WINDOW + 1
NEAREST = 4
SKETCH_SPREADS = 5.5
ROWS_PER_TASK = 2000
BROADCAST_IDS = 1_000_000
CHUNK_BYTES = 1_000_000
SAMPLE_ROWS = 4000
COMMON_SHINGLES = 500_000
SALT_ROWS = 512
BLOCK_ROWS = 1024
# One byte counts the texts of all shingles whose hashes begin alike: at most 32 MB.
SLOT_BITS = 25
SLOT_CHUNKS = 1024

_RNG = np.random.default_rng(20240)
_TABLE = _RNG.integers(0, 2**64, 256, np.uint64)
for _c in range(ord("A"), ord("Z") + 1):
    _TABLE[_c] = _TABLE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACES = _RNG.integers(0, 2**63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _RNG.integers(0, 2**32, (VALUES, 1), np.uint32)
_TIMES = _RNG.integers(0, 2**31, (VALUES, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def sketch_limit(share: float) -> int:
    """The largest distance of one-bit sketches a linked pair is expected to have: its mean and ``SKETCH_SPREADS`` spreads."""
    odds = (1 - share) / 2
    return math.ceil(VALUES * odds + SKETCH_SPREADS * math.sqrt(VALUES * odds * (1 - odds)))


class Shingler:
    """Distinct hashed shingles of the texts of an Arrow column, without a Python object for each word."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            last = min(last, len(texts))
            yield from self._chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        n = len(data)
        if len(self.up) < n or len(self.up) > max(n, 4 * CHUNK_BYTES):
            self.up, self.down = _powers(_BASE, max(n, CHUNK_BYTES)), _powers(_BASE_INVERSE, max(n, CHUNK_BYTES))
        inside = ~_SPACE[data]
        borders = np.zeros(n + 1, bool)
        borders[offsets] = True
        edge = np.concatenate([[False], inside, [False]])
        starts = np.flatnonzero(inside & (~edge[:n] | borders[:n]))
        ends = np.flatnonzero(inside & (~edge[2:] | borders[1:])) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * self.up[:n], dtype=np.uint64)])
        words = _mix((sums[ends] - sums[starts]) * self.down[starts])
        count = len(words) - WIDTH + 1
        shingles = np.zeros(max(count, 0), np.uint64)
        for k in range(WIDTH):
            if count > 0:
                shingles += words[k : k + count] * _PLACES[k]
        shingles = _mix(shingles)
        first_word = np.searchsorted(starts, offsets)
        for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist()):
            if b - a >= WIDTH:
                yield np.unique(shingles[a : b - WIDTH + 1])
            elif b > a:
                short = np.sum(words[a:b] * _PLACES[: b - a], dtype=np.uint64) + np.uint64(b - a)
                yield _mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The signature: the least value of every one of ``VALUES`` hash functions."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(out, ((low[k : k + 2048] ^ _FLIPS) * _TIMES).min(1), out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text_sha256, text) as doc_id, text_sha256, n, digest of the set, signature of 16-bit values, one-bit sketch; nulls for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            rows = []
            for s in shingler.sets(batch.column(2).fill_null("")):
                if len(s):
                    m = minima(s)
                    values = ((m * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(">u2")
                    bits = np.packbits((m * np.uint32(0xC2B2AE35)) >> np.uint32(31)).tobytes()
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), values.tobytes(), bits))
                else:
                    rows.append((0, None, None, None))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            columns = zip(*rows) if rows else [()] * 4
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "text_sha256", "n", "digest", "signature", "sketch"])

    schema = "doc_id long, text_sha256 string, n long, digest binary, signature binary, sketch binary"
    return docs.select("doc_id", "text_sha256", "text").mapInArrow(run, schema)


# ---- candidates ----

ROW = "tree int, key binary, id long, n long, sketch binary"


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class once for every order: the signature from another value on."""
    step = VALUES // ORDERS
    turns = (np.arange(ORDERS)[:, None] * step + np.arange(DEPTH)) % VALUES
    for batch in batches:
        ids, n, raw, sketches = (batch.column(k) for k in range(4))
        rows = len(ids)
        if not rows:
            continue
        values = np.frombuffer(b"".join(raw.to_pylist()), ">u2").reshape(rows, VALUES)
        keys = values[:, turns]
        flat = np.ascontiguousarray(keys).tobytes()
        size = 2 * DEPTH
        every = np.repeat(np.arange(rows), ORDERS)
        columns = [
            pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), rows)),
            pa.array([flat[k : k + size] for k in range(0, len(flat), size)], pa.binary()),
            ids.take(pa.array(every)), n.take(pa.array(every)), sketches.take(pa.array(every)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "key", "id", "n", "sketch"])


class _Rows:
    """Rows of a sorted order as arrays."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        column = lambda name: table.column(name).combine_chunks() if isinstance(table, pa.Table) else table.column(name)
        self.n = len(table.column("id"))
        first = np.frombuffer(b"".join(k[:2] for k in column("key").to_pylist()), ">u2").astype(np.int64)
        self.group = column("tree").to_numpy().astype(np.int64) * 2**16 + first
        self.id = column("id").to_numpy()
        self.size = column("n").to_numpy()
        self.sketch = np.frombuffer(b"".join(column("sketch").to_pylist()), np.uint64).reshape(self.n, -1)

    def nearest(self, upto: int, share: float, begin: int = 0) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """(id, id, sketch distance) of rows ``begin``..``upto`` with the best of the ``WINDOW`` rows after them, and marked ids.

        A pair that the window or the list of the best leaves out has both its ids marked.
        """
        out, marked = [], []
        for a in range(begin, upto, 2000):
            i = np.arange(a, min(a + 2000, upto))
            j = i[:, None] + np.arange(1, WINDOW + 1)
            real = j < self.n
            j = np.minimum(j, self.n - 1)
            far = np.zeros(j.shape, np.int64)
            for k in range(self.sketch.shape[1]):
                far += np.bitwise_count(self.sketch[i, k][:, None] ^ self.sketch[j, k])
            x, y = self.size[i][:, None], self.size[j]
            good = real & (self.group[i][:, None] == self.group[j]) & (np.minimum(x, y) >= share * np.maximum(x, y)) & (far <= sketch_limit(share))
            rank = np.where(good, far * (WINDOW + 1) + np.arange(WINDOW), 2**20)
            best = np.argpartition(rank, NEAREST, 1)[:, :NEAREST]
            r, c = np.nonzero(np.take_along_axis(good, best, 1))
            c = best[r, c]
            out.append((self.id[i[r]], self.id[j[r, c]], far[r, c]))
            over = good.sum(1) > NEAREST
            beyond = i[i + REACH < self.n]
            beyond = beyond[self.group[beyond] == self.group[beyond + REACH]]
            marked += [self.id[i[over]], self.id[j[over][good[over]]], self.id[beyond], self.id[beyond + REACH]]
        ids = np.unique(np.concatenate(marked)) if marked else np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3, ids


def _neighbours(share: float):
    """Within a task, rows in order give pairs (kind 0) and marks (kind 3); its first and last rows are handed on for the borders."""
    names = ["kind", "border", "a", "b", "far", *(x.split()[0] for x in ROW.split(", "))]

    def pairs(a, b, far, kind: int = 0) -> pa.RecordBatch:
        n = len(a)
        nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int32()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far), *nothing], names)

    def seen(found, marked, before: np.ndarray) -> tuple[list[pa.RecordBatch], np.ndarray]:
        new = np.setdiff1d(marked, before, assume_unique=True)
        return [pairs(*found), pairs(new, new, np.zeros(len(new), np.int64), 3)], marked

    def handed(rows: pa.Table, kind: int, border: int) -> list[pa.RecordBatch]:
        n = rows.num_rows
        marks = [pa.array(np.full(n, v, np.int32)) for v in (kind, border)]
        return pa.Table.from_arrays([*marks, *(pa.nulls(n, pa.int64()) for _ in range(3)), *rows.columns], names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, head = None, None
        marked = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            head = table if head is None else head if head.num_rows >= REACH else pa.concat_tables([head, table])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows > REACH:
                upto = held.num_rows - REACH
                out, marked = seen(*_Rows(held).nearest(upto, share), marked)
                yield from out
                held = held.slice(upto)
        if held is None:
            return
        yield from seen(*_Rows(held).nearest(held.num_rows, share), marked)[0]
        yield from handed(head.slice(0, REACH), 1, part)
        yield from handed(held.slice(max(0, held.num_rows - REACH)), 2, part + 1)

    return run


def _border(share: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tree", "ascending"), ("key", "ascending"), ("id", "ascending")])
        (a, b, far), marked = _Rows(table).nearest(table.num_rows, share)
        a, b, far = np.concatenate([a, marked]), np.concatenate([b, marked]), np.concatenate([far, np.zeros(len(marked), np.int64)])
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "far": far})

    return run


def candidates(classes: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, far): likely near-duplicates among ``classes`` (id, n, signature, sketch), a under b; and the marked ids."""
    rows = classes.count() * ORDERS
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, rows // ROWS_PER_TASK))
    ordered = classes.select("id", "n", "signature", "sketch").mapInArrow(_orders, ROW)
    ordered = ordered.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = saved(ordered.mapInArrow(_neighbours(share), f"kind int, border int, a long, b long, far long, {ROW}"), "neighbours")
    handed = found.where("kind in (1, 2)")
    edges = saved(handed.groupBy("border").applyInArrow(_border(share), "a long, b long, far long"), "edges")
    pairs = found.where("kind = 0").select("a", "b", "far").union(edges).where("a <> b")
    # rows on both sides of a task with less than a window's rows do not meet: all are marked
    heads = dict(found.where("kind = 1").groupBy("border").count().collect())  # one row for each task
    short = [p for p in range(max(heads, default=0) + 1) if heads.get(p, 0) < REACH]
    around = handed.where(F.col("border").isin(sorted({q for p in short for q in (p, p + 1)}))).select("id")
    marked = found.where("kind = 3").select(F.col("a").alias("id")).union(edges.where("a = b").select("a")).union(around)
    return pairs.groupBy("a", "b").agg(F.min("far").alias("far")), marked.distinct()


# ---- confirmation ----


def _linked(percent: int):
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(Shingler().sets(left), Shingler().sets(right)):
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Written ``pairs`` (a, b) with ``linked``: 100 * common shingles >= percent * all shingles of both.

    The pairs go to the texts, so no text is moved but those of a pair.
    """
    pairs = _sent(pairs, pairs)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x")).join(pairs, "a")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y")).join(pairs.select("b"), "b", "left_semi")
    return left.join(right, "b").select("a", "b", _linked(percent)("x", "y").alias("linked"))


def _turns(pairs: DataFrame) -> DataFrame:
    """(a, b, turn): every pair's place among the pairs of either text, nearest first; the lower of the two."""
    both = pairs.select("a", "b", "far", F.explode(F.array("a", "b")).alias("u"))
    place = F.row_number().over(Window.partitionBy("u").orderBy("far", "a", "b"))
    return both.withColumn("turn", place).groupBy("a", "b").agg(F.min("turn").alias("turn"))


def links(pairs: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links and their components (node, component).

    Pairs are ranked once; a round takes those up to place ``k`` that are still apart, proposals first.
    """
    spark = pairs.sparkSession
    n_left = pairs.count()
    left = saved(_turns(together(pairs, n_left)), "turns")
    found = checked = None
    n_checked = 0
    labels = spark.createDataFrame([], "node long, component long")
    k = 1
    while True:
        left = together(left, n_left)
        batch = saved(confirmed(left.where(F.col("turn") <= k).select("a", "b"), texts, percent), "checked")
        n_batch = batch.count()
        n_checked += n_batch
        batch = together(batch, n_batch)
        new = batch.where("linked").select("a", "b")
        checked = together(batch if checked is None else saved(checked.union(batch), "all_checked"), n_checked)
        found = checked.where("linked").select("a", "b")
        if not new.isEmpty():
            labels = together(saved(components(found), "labels"))
        degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
        hubs = labels.join(degree, "node").groupBy("component").agg(F.max_by("node", F.struct("d", -F.col("node"))).alias("hub"))
        hubs = _sent(hubs, labels)  # a large component's proposals then stay where they are
        # a failed pair proposes two at most
        proposed = together(left.unionByName(_proposals(batch.where("not linked"), labels, hubs)), n_left + 2 * n_batch)
        proposed = proposed.groupBy("a", "b").agg(F.min("turn").alias("turn")).join(checked.select("a", "b"), ["a", "b"], "left_anti")
        for side in "ab":
            own = labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
            proposed = proposed.join(own, side, "left")
        apart = F.col("ca").isNull() | F.col("cb").isNull() | (F.col("ca") != F.col("cb"))
        left = saved(proposed.where(apart).select("a", "b", "turn"), "left")
        n_left, least = left.agg(F.count("*"), F.min("turn")).first()
        if not n_left:
            return found, labels
        k = max(4 * k, least)


def _proposals(failed: DataFrame, labels: DataFrame, hubs: DataFrame) -> DataFrame:
    """For a failed pair, either side with the best linked text of the other side's component."""
    sides = failed.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("node")), F.struct(F.col("b").alias("u"), F.col("a").alias("node")))).alias("p")).select("p.u", "p.node")
    aimed = sides.join(labels, "node").join(hubs, "component").where("u <> hub").select("u", "hub").distinct()
    return aimed.select(F.least("u", "hub").alias("a"), F.greatest("u", "hub").alias("b"), F.lit(0).alias("turn"))


# ---- the exact join of marked rows ----


def _shingle_rows(texts: DataFrame, name: str, fn, fields: str) -> DataFrame:
    """Rows of ``fn``, from the id, component and shingles of every row of ``texts`` (id, component, text)."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, c, s in zip(ids, parts, shingler.sets(batch.column(2).fill_null(""))):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in fn(i, c, s)], names)

    return saved(texts.select("id", "component", "text").mapInArrow(run, fields), name)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a sample of the texts that two or more of them have, sorted, and how many have them."""
    sample = bounded_sample(texts, "id", SAMPLE_ROWS, 11)
    rows = _shingle_rows(sample, "sampled", lambda i, c, s: (s.view(np.int64),), "s long")
    often = rows.groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(COMMON_SHINGLES).toArrow()
    values = often.column("s").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], often.column("count").to_numpy()[order]


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(len(rows["counts"][0].as_py()), np.uint64)
    for counts in rows["counts"]:
        total += np.frombuffer(counts.as_py(), np.uint8)
    return pa.table({"chunk": [key[0].as_py()], "counts": [np.minimum(total, 255).astype(np.uint8).tobytes()]})


def _slots(texts: DataFrame) -> np.ndarray:
    """How many ``texts`` have a shingle of each slot, counted up to 255: no less than how many have any one of its shingles."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(SLOT_BITS, max(16, (size // 4).bit_length()))
    per_chunk = 2**bits // SLOT_CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(), np.zeros(2**bits, np.uint8)
        for batch in batches:
            for sets in _several(shingler.sets(batch.column(0).fill_null(""))):
                slot, n = np.unique(sets >> np.uint64(64 - bits), return_counts=True)
                counts[slot] = np.minimum(counts[slot] + n, 255)
        for chunk in np.flatnonzero(counts.reshape(SLOT_CHUNKS, -1).any(1)):
            part = counts[chunk * per_chunk : (chunk + 1) * per_chunk]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part.tobytes()])], ["chunk", "counts"])

    fields = "chunk long, counts binary"
    out = np.zeros(2**bits, np.uint8)
    for chunk, counts in texts.select("text").mapInArrow(count, fields).groupBy("chunk").applyInArrow(_added, fields).collect():  # 2**bits bytes, whatever the rows
        out[chunk * per_chunk : (chunk + 1) * per_chunk] = np.frombuffer(counts, np.uint8)
    return out


def _several(sets: Iterator[np.ndarray], entries: int = 500_000) -> Iterator[np.ndarray]:
    """Sets one after the other, about ``entries`` at once."""
    held, n = [], 0
    for s in sets:
        held.append(s)
        n += len(s)
        if n >= entries:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """(s, id, component, n, place): of every text the shingles one of which any linked text must share.

    The order is one for all texts, rare shingles first: by the count of their slots, which sees
    shingles of a few texts among millions too, then by a sample that tells the frequent ones apart.
    It does not change the result, only how many pairs are counted. A shingle alone in its slot is in
    one text and gets no row.
    """
    shared = texts.sparkSession.sparkContext.broadcast((*_common(texts), _slots(texts)))

    def prefix(i: int, c: int, s: np.ndarray):
        known, counts, slots = shared.value
        seen = slots[s >> np.uint64(64 - (len(slots).bit_length() - 1))]
        n = len(s)
        often = np.zeros(n, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            often = np.where(known[at] == s, counts[at], 0)
        k = n - -(-percent * n // 100) + 1
        first = np.lexsort((s, often, seen))[:k]
        place = np.flatnonzero(seen[first] > 1)
        k = len(place)
        return s[first[place]].view(np.int64), np.full(k, i), np.full(k, c), np.full(k, n), place

    return _shingle_rows(texts, "prefixes", prefix, "s long, id long, component long, n long, place long")


def _counted(percent: int):
    """Linked pairs of two blocks, from their pairs and texts; every set is made once."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        ids = texts.column("id").to_numpy()
        sets = list(Shingler().sets(texts.column("text").combine_chunks()))
        size = np.array([len(s) for s in sets], np.int64)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, pairs.column(c).to_numpy(), sorter=order)] for c in ("a", "b"))
        mark = np.zeros(int(codes.max()) + 1, bool)
        linked = np.zeros(len(a), bool)
        by_a = np.argsort(a, kind="stable")
        for some in np.split(by_a, np.flatnonzero(np.diff(a[by_a])) + 1):
            x = a[some[0]]
            own = codes[starts[x] : starts[x] + size[x]]
            mark[own] = True
            common = np.array([np.count_nonzero(mark[codes[starts[y] : starts[y] + size[y]]]) for y in b[some]])
            mark[own] = False
            linked[some] = 100 * common >= percent * (size[x] + size[b[some]] - common)
        return pairs.select(["a", "b"]).filter(pa.array(linked))

    return run


def _sent(df: DataFrame, bound: DataFrame, times: int = 1) -> DataFrame:
    """``df`` marked for broadcast if the written table ``bound``, which has no fewer rows (``times`` over), is counted to be small."""
    return F.broadcast(df) if times * bound.count() <= BROADCAST_IDS else df


def gathered(rows: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """``rows`` (id, ...) of the ids of the written table ``asked``, with its other columns, written.

    Rows stay where they lie: the ids go to them, in as many slices, each with a pass of its own over the rows, as fit a broadcast.
    """
    slices = max(1, -(-asked.count() // BROADCAST_IDS))
    own = F.pmod(F.xxhash64("id"), F.lit(slices))
    parts = [saved(rows.join(F.broadcast(asked.where(own == k) if slices > 1 else asked), "id"), name) for k in range(slices)]
    return reduce(DataFrame.unionByName, parts)


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` but for those whose ``key`` the written table ``ids`` has; rows stay where they lie, ids go to them in slices."""
    slices = max(1, -(-ids.count() // BROADCAST_IDS))
    own = F.pmod(F.xxhash64(key), F.lit(slices))
    for k in range(slices):
        rows = rows.join(F.broadcast(ids.where(own == k) if slices > 1 else ids), key, "left_anti")
    return rows


def _sides(df: DataFrame, keys: list[str], fields: list[str]) -> list[DataFrame]:
    return [df.select(*keys, *[F.col(c).alias(c + mark) for c in fields]) for mark in ("_a", "_b")]


def _may_link(percent: int, low: str, high: str, rest: str) -> Column:
    """Whether sides a and b may hold a link: by the ranges of their sizes, and by what is left of the sets at a shared shingle."""
    sized = 100 * F.least(f"{high}_a", f"{high}_b") >= percent * F.greatest(f"{low}_a", f"{low}_b")
    reach = F.least(f"{rest}_a", f"{rest}_b")
    return sized & ((100 + percent) * reach >= percent * (F.col(f"{low}_a") + F.col(f"{low}_b")))


def _component_pairs(parts: DataFrame, percent: int) -> DataFrame:
    """(s, component_a, component_b, salts_a, salts_b): components that share a shingle and may hold a link, a under b."""
    used = parts.groupBy("s").agg(F.count("*").alias("parts")).where("parts > 1")
    parts = parts.join(used, "s").withColumn("splits", F.ceil(F.col("parts") / SALT_ROWS).cast("int"))
    left = parts.withColumn("split", F.pmod(F.xxhash64("component"), F.col("splits")).cast("int"))
    right = parts.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    fields = ["component", "salts", "low", "high", "rest"]
    left, right = _sides(left, ["s", "split"], fields)[0], _sides(right, ["s", "split"], fields)[1]
    met = left.join(right, ["s", "split"]).where((F.col("component_a") < F.col("component_b")) & _may_link(percent, "low", "high", "rest"))
    return met.select("s", "component_a", "component_b", "salts_a", "salts_b")


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): texts of different components that may be linked, from ``rows`` (s, id, component, n, place), a under b.

    Components meet before their texts do, so texts of one component are never put side by
    side: what is joined grows with the pairs that come out.
    """
    rest = F.col("n") - F.col("place")
    sizes = [F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(rest).alias("rest")]
    parts = rows.groupBy("s", "component").agg(*sizes).withColumn("salts", F.ceil(F.col("rows") / SALT_ROWS).cast("int"))
    parts = saved(parts, "parts")
    met = saved(_component_pairs(parts, percent), "component_pairs")
    many = parts.where("salts > 1").select("s", "component", "salts")
    rows = rows.join(_sent(met.select("s").distinct(), met), "s", "left_semi").join(_sent(many, many), ["s", "component"], "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).withColumn("rest", rest)
    left, right = _sides(rows, ["s"], ["id", "component", "salt", "n", "rest"])
    for side in "ab":
        met = met.withColumn(f"salt_{side}", F.explode(F.sequence(F.lit(0), F.col(f"salts_{side}") - 1)))
    pairs = met.join(left, ["s", "component_a", "salt_a"]).join(right, ["s", "component_b", "salt_b"]).where(_may_link(percent, "n", "n", "rest"))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def exact_links(texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links between different components of ``texts`` (id, component, text), a under b."""
    pairs = saved(open_pairs(_prefixes(texts, percent), percent), "open_pairs")
    regions = _regions(pairs)
    for side in "ab":
        own = regions.select(F.col("id").alias(side), F.col("block").alias(f"block_{side}"), *(["blocks", "region"] if side == "a" else []))
        pairs = pairs.join(_sent(own, regions), side)
    pairs = saved(pairs.select("a", "b", "blocks", "region", F.least("block_a", "block_b").alias("p"), F.greatest("block_a", "block_b").alias("q")), "placed_pairs")
    keys = ["blocks", "region", "p", "q"]
    asked = _sent(pairs.select(*keys, F.explode(F.array("a", "b")).alias("id")).distinct(), pairs, 2)
    asked = texts.select("id", "text").join(asked, "id").select(*[F.col(c).alias(f"own_{c}") for c in keys], "id", "text")
    return pairs.groupBy(*keys).cogroup(asked.groupBy(*[f"own_{c}" for c in keys])).applyInArrow(_counted(percent), "a long, b long")


def _regions(pairs: DataFrame) -> DataFrame:
    """(id, blocks, region, block): texts that hang together by ``pairs`` (a, b) have one region, cut into blocks where it is large; small ones share a number.

    Pairs lie within a region, so a text is sent to its few blocks and not along with each of its pairs.
    """
    labels = saved(components(pairs), "regions")
    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    shared = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-labels.count() // BLOCK_ROWS))))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    region = F.when(F.col("blocks") == 1, shared).otherwise(F.col("component"))
    return saved(labels.join(sizes, "component").select(F.col("node").alias("id"), "blocks", region.alias("region"), block.alias("block")), "blocks")


def text_key(text: str) -> Column:
    """What tells the texts of one id apart."""
    return F.sha2(F.col(text), 256)


def _keyed(classes: DataFrame, mixed: DataFrame) -> DataFrame:
    """``classes`` with a key of their own, ``id``: the least document id, or a number past all ids where another class has that."""
    own = classes.withColumn("id", F.col("doc_id"))
    if mixed.isEmpty():
        return own
    shared = saved(classes.join(mixed, "doc_id", "left_semi").select("doc_id", "digest"), "shared_ids")
    first = shared.groupBy("doc_id").agg(F.min("digest").alias("first"))
    later = shared.join(first, "doc_id").where(F.col("digest") != F.col("first")).select("doc_id", "digest")
    past = classes.agg(F.max("doc_id")).first()[0] or 0
    moved = saved(ranked(later, [F.col("doc_id"), F.col("digest")], "turn"), "moved").select("digest", (F.col("turn") + F.lit(past)).alias("moved"))
    return own.join(moved, "digest", "left").withColumn("id", F.coalesce("moved", "id")).drop("moved")


def _texts(named: DataFrame, features: DataFrame, classes: DataFrame, repeated: DataFrame, mixed: DataFrame, needed: DataFrame) -> DataFrame:
    """(id, text): one text of every class of ``needed`` (id); only texts of ids that come again (``repeated``) are put side by side."""
    asked = needed.withColumn("again", F.lit(False))
    if not repeated.isEmpty():
        again = repeated.select(F.col("doc_id").alias("id"), F.lit(True).alias("again"))
        asked = saved(needed.join(again, "id", "left").select("id", F.coalesce("again", F.lit(False)).alias("again")), "asked")
    source = gathered(named.select(F.col("doc_id").alias("id"), "text"), asked, "gathered")
    texts = source.where("not again").select("id", "text")
    if repeated.isEmpty():
        return texts
    several = source.where("again").select("id", "text").join(mixed.withColumnRenamed("doc_id", "id"), "id", "left_anti")
    texts = texts.unionByName(saved(several.groupBy("id").agg(F.min("text").alias("text")), "several"))
    if mixed.isEmpty():
        return texts
    # the least document of a class stands for it, by whichever of that id's texts is of the class
    wanted = classes.join(_sent(needed, needed), "id", "left_semi").join(mixed, "doc_id", "left_semi").select("id", "digest", F.col("doc_id").alias("least"))
    chosen = features.join(wanted, "digest").where("doc_id = least").groupBy("id", "doc_id").agg(F.min("text_sha256").alias("text_sha256"))
    odd = named.join(saved(chosen, "chosen"), ["doc_id", "text_sha256"]).groupBy("id").agg(F.min("text").alias("text"))
    return texts.unionByName(saved(odd, "odd"))


def _named(classes: DataFrame, labels: DataFrame, mixed: DataFrame) -> DataFrame:
    """(digest, group_id, component_id): each class's component by its least key, and by its least document id."""
    by_class = classes.select("digest", "doc_id", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
    by_class = by_class.select("digest", "doc_id", "id", F.coalesce("component", "id").alias("group_id"))
    if mixed.isEmpty():
        return by_class.select("digest", "group_id", F.col("group_id").alias("component_id"))
    by_class = saved(by_class, "by_class")
    # keys are document ids but for the moved ones, whose ids may be lower than their group's other keys
    moved = few_rows(by_class.where("id <> doc_id").groupBy("group_id").agg(F.min("doc_id").alias("moved")))
    past = classes.agg(F.max("doc_id")).first()[0]
    real = F.when(F.col("group_id") <= F.lit(past), F.col("group_id"))
    return by_class.join(moved, "group_id", "left").select("digest", "group_id", F.least(real, "moved").alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``, with its group_id and text_sha256; ids are integers.

    A row without an id takes part in nothing: its component is null and it is kept. Rows
    with the same id and text have equal results. Rows with one id and different texts are
    documents of their own: each is linked by its own text, and only rows of linked texts
    have one ``group_id`` (null where nothing can link). Very long texts are taken whole,
    pairs at exactly ``percent`` are linked, other columns of ``docs`` are not looked at.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_sha256"), F.col(text).alias("text"))
    features = saved(signatures(named), "signatures")
    known = features.where("n > 0 and doc_id is not null")
    best = F.min(F.struct("doc_id", "n", "signature", "sketch")).alias("c")
    classes = known.groupBy("digest").agg(best).select("digest", "c.doc_id", "c.n", "c.signature", "c.sketch")
    some = F.coalesce("digest", F.lit(b""))
    per_id = features.where("doc_id is not null").groupBy("doc_id").agg(F.min(some).alias("low"), F.max(some).alias("high"), F.count("*").alias("rows"))
    repeated = saved(per_id.where("rows > 1").select("doc_id", (F.col("low") != F.col("high")).alias("mixed")), "repeated")
    mixed = repeated.where("mixed").select("doc_id")
    classes = saved(_keyed(classes, mixed), "classes")
    pairs, marked = (saved(x, name) for x, name in zip(candidates(classes, percent / 100), ("candidates", "marked")))
    needed = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(marked).distinct(), "needed")
    texts = _texts(named, features, classes, repeated, mixed, needed)
    found, labels = links(pairs, texts, percent)
    own = labels.withColumnRenamed("node", "id")
    open_ids = saved(marked.join(own, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "open_ids")
    more = saved(exact_links(gathered(texts, open_ids, "open_texts"), percent), "exact_links")
    if not more.isEmpty():
        labels = saved(components(found.union(more)), "labels")
    by_class = _named(classes, labels, mixed)
    rows = features.select("doc_id", F.col("n").alias("n_shingles"), "digest", "text_sha256")
    nothing = F.lit(None).cast("long")
    alone = rows.where("digest is null").withColumns({"group_id": nothing, "component_id": nothing})
    out = rows.where("digest is not null").join(by_class, "digest", "left").unionByName(alone, allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id"), "text_sha256",
    )


def surplus(found: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of all rows of ``near_duplicates`` but the texts that stay, one of each group."""
    kept = found.where("kept and group_id is not null")
    several = kept.groupBy("group_id").agg(F.min("text_sha256").alias("stays"), F.max("text_sha256").alias("last")).where("stays <> last")
    second = kept.join(several, "group_id").where(F.col("text_sha256") != F.col("stays"))
    return found.where("not kept").select("doc_id", "text_sha256").union(second.select("doc_id", "text_sha256")).distinct()
