"""Token ids in wavelet-matrix files: bit-planes with rank and select, one compressed file a shard.

A wavelet matrix keeps the highest bit of every id in its first plane, then moves the ids
with a 0 before those with a 1, keeping their order, writes the next bit, and so on. Ones
counted before a place (rank) lead from a plane to the next, the place of the k-th bit
(select) leads back. So one file gives the id at a place, the count of an id in any stretch, and
the places of an id, without decoding the rest: planes are cut into blocks of ``BLOCK`` bits,
each compressed for itself, with the ones before every block beside them.

Documents are put in ascending id order by one range shuffle (equal ids by the text's hash;
null ids first), tokenized where they lie and written as shards of about ``SHARD`` ids. A shard
holds whole documents, their ids and token counts. Files are named by the task and
the shard's number in it and moved into place when complete, so a task that runs again
writes the same files. Only one total a task meets in the driver.

Null and empty texts hold the closing id alone. Repeated rows are written as often as they
occur. Very long texts make a longer shard. An empty table gives no file and no row. Other
columns of the documents, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from presslens.llm.files import listed, read_file, write_file
from presslens.llm.wordids import WordIds, with_closing
from presslens.session import scratch_path

MAGIC = b"WAVELET1"
BLOCK = 2**16
SHARD = 4_000_000
ENDING = ".wavelet"


def build(ids: np.ndarray, levels: int, meta: dict | None = None, docs: pa.Table | None = None) -> bytes:
    """The file of a sequence of ids below ``2 ** levels``; ``docs`` and ``meta`` are kept as given."""
    pack = zstandard.ZstdCompressor(level=1)
    n = len(ids)
    zeros, ones_before, sizes, blocks = [], [], [], []
    now = np.ascontiguousarray(ids)
    for level in range(levels - 1, -1, -1):
        bit = ((now >> now.dtype.type(level)) & now.dtype.type(1)).astype(bool)
        packed = np.packbits(bit)
        per_block = np.add.reduceat(bit, np.arange(0, n, BLOCK), dtype=np.int64) if n else np.zeros(0, np.int64)
        pieces = [pack.compress(packed[at : at + BLOCK // 8].tobytes()) for at in range(0, len(packed), BLOCK // 8)]
        ones = int(per_block.sum())
        zeros.append(n - ones)
        ones_before.append(np.concatenate([[0], np.cumsum(per_block)]))
        sizes.append([len(p) for p in pieces])
        blocks += pieces
        after = np.empty_like(now)
        np.compress(~bit, now, out=after[: n - ones])
        np.compress(bit, now, out=after[n - ones :])
        now = after
    table = _ipc(docs) if docs is not None else b""
    directory = np.concatenate([np.array(ones_before, "<i8").ravel(), np.array(sizes, "<i8").ravel()]).tobytes()
    directory = pack.compress(directory)
    head = json.dumps({"n": n, "levels": levels, "zeros": zeros, "docs": len(table), "directory": len(directory), **(meta or {})}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, directory, table, *blocks])


def _ipc(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue()


class Shard:
    """A wavelet-matrix file opened for reading; only blocks that a question touches are decompressed."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack_from("<I", raw, len(MAGIC))
        at = len(MAGIC) + 4
        self.meta = json.loads(raw[at : at + size])
        self.n, self.levels, self.zeros = self.meta["n"], self.meta["levels"], self.meta["zeros"]
        at += size
        n_blocks = -(-self.n // BLOCK)
        found = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at : at + self.meta["directory"]]), "<i8")
        self.ones = found[: self.levels * (n_blocks + 1)].reshape(self.levels, n_blocks + 1)
        sizes = found[self.levels * (n_blocks + 1) :].reshape(self.levels, n_blocks)
        at += self.meta["directory"]
        self._table = raw[at : at + self.meta["docs"]]
        at += self.meta["docs"]
        ends = at + np.cumsum(sizes.ravel()).reshape(sizes.shape)
        self.begins, self.ends, self.raw = ends - sizes, ends, raw
        self.dtype = np.dtype("<u2" if self.levels <= 16 else "<u4")
        self._bits = functools.lru_cache(maxsize=64)(self._unpacked)

    @functools.cached_property
    def docs(self) -> pa.Table:
        return pa.ipc.open_stream(self._table).read_all()

    def _packed(self, level: int, block: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.raw[self.begins[level, block] : self.ends[level, block]])

    def _unpacked(self, level: int, block: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._packed(level, block), np.uint8), count=min(BLOCK, self.n - block * BLOCK))

    def rank1(self, level: int, place: int) -> int:
        """Ones of a plane before ``place``."""
        block, rest = divmod(place, BLOCK)
        before = int(self.ones[level, block])
        return before + int(np.count_nonzero(self._bits(level, block)[:rest])) if rest else before

    def _select(self, level: int, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Places of the bits that have so many equal bits before them; ``ranks`` ascend."""
        before = self.ones[level] if bit else np.minimum(np.arange(self.ones.shape[1]) * BLOCK, self.n) - self.ones[level]
        block = np.searchsorted(before, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        for b in np.unique(block).tolist():
            here = block == b
            out[here] = b * BLOCK + np.flatnonzero(self._bits(level, b) == bit)[ranks[here] - before[b]]
        return out

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level in range(self.levels):
            bit = int(self._bits(level, place // BLOCK)[place % BLOCK])
            before = self.rank1(level, place)
            place = self.zeros[level] + before if bit else place - before
            value = 2 * value + bit
        return value

    def _span(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of an id in [low, high) stand behind the last plane."""
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            if low >= high:
                return 0, 0
            a, b = self.rank1(level, low), self.rank1(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs in [low, high)."""
        a, b = self._span(token, low, self.n if high is None else high)
        return b - a

    def occurrences(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """The places of an id in [low, high), ascending."""
        a, b = self._span(token, low, self.n if high is None else high)
        return self._up(token, np.arange(a, b))

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of an id, from 0."""
        a, b = self._span(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        return int(self._up(token, np.array([a + k]))[0])

    def _up(self, token: int, places: np.ndarray) -> np.ndarray:
        for level in range(self.levels - 1, -1, -1):
            if len(places):
                bit = token >> (self.levels - 1 - level) & 1
                places = self._select(level, bit, places - self.zeros[level] if bit else places)
        return places

    def ids(self) -> np.ndarray:
        """The whole sequence: ids are put together plane by plane from the last to the first."""
        now = np.zeros(self.n, self.dtype)
        for level in range(self.levels - 1, -1, -1):
            packed = b"".join(self._packed(level, b) for b in range(self.begins.shape[1]))
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).view(bool)
            before = np.empty_like(now)
            before[bit] = now[self.zeros[level] :]
            before[~bit] = now[: self.zeros[level]]
            now = before | (bit.astype(self.dtype) << self.dtype.type(self.levels - 1 - level))
        return now


def write_shards(docs: DataFrame, definition: str, path: str, closing: int = 1, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> dict[int, int]:
    """Write all documents as shards under ``path``; gives the ids before each task's first one."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)  # a tokenizer file, some MB at most
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Rows of one id and text are equal, so any order among them is right; the last key lets them be dealt out.
    order = [F.col("doc_id").asc(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("doc_id", "text", *[c.alias(f"k{i}") for i, c in enumerate(order[1:])])
    keys = [F.col("doc_id").asc(), F.col("k0"), F.col("k1")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        levels = max(1, int(max(encoder.size - 1, closing)).bit_length())
        part, first, number = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> int:
            names, counts, ids = (list(c) for c in zip(*held))
            table = pa.table({"doc_id": pa.chunked_array(names), "n_tokens": pa.array(np.concatenate(counts))})
            whole = np.concatenate(ids)
            raw = build(whole, levels, {"part": part, "first": first}, table.combine_chunks())
            write_file(f"{path}/{part:06d}-{number:06d}{ENDING}", raw)
            held.clear()
            return len(whole)

        size = 0
        for batch in batches:
            for ids, counts, at in with_closing(encoder, batch.column(1), closing, shard):
                held.append((batch.column(0).slice(at, len(counts)), counts, ids))
                size += len(ids)
                if size >= shard:
                    n = flush()
                    first, number, size = first + n, number + 1, 0
        if held:
            first += flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([first], pa.int64())], ["part", "n"])

    found = sorted(dealt.mapInArrow(run, "part long, n long").collect())  # one row a task
    before, total = {}, 0
    for part, n in found:
        before[part] = total
        total += n
    return before


@functools.lru_cache(maxsize=1)
def _encoder(definition: str) -> WordIds:
    """Kept between the tasks of a Python worker, so its words are."""
    return WordIds(definition)


def read_documents(spark: SparkSession, path: str, before: dict[int, int], id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files; with its ids as bytes on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = Shard(read_file(name))
                wide = held.ids().astype("<u4")
                counts = held.docs["n_tokens"].to_numpy()
                ends = np.cumsum(counts)
                start = before[held.meta["part"]] + held.meta["first"]
                view = memoryview(wide.tobytes())
                for at in range(0, len(counts), 5000):
                    spans = list(zip((4 * (ends - counts)[at : at + 5000]).tolist(), (4 * ends[at : at + 5000]).tolist()))
                    ids = held.docs["doc_id"].slice(at, len(spans)).combine_chunks()
                    columns = [
                        ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids,
                        pa.array(start + (ends - counts)[at : at + 5000]), pa.array(counts[at : at + 5000]),
                        pa.array([zlib.crc32(view[a:b]) for a, b in spans], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([bytes(view[a:b]) for a, b in spans], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return listed(spark, path, ENDING).mapInArrow(run, schema)


def token_places(spark: SparkSession, path: str, tokens: list[int], id_type: str = "bigint") -> DataFrame:
    """(token, doc_id, place): every occurrence of the tokens, found by select; ``place`` counts inside the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = Shard(read_file(name))
                ends = np.cumsum(held.docs["n_tokens"].to_numpy())
                for token in tokens:
                    places = held.occurrences(token)
                    doc = np.searchsorted(ends, places, side="right")
                    starts = np.concatenate([[0], ends])[doc]
                    ids = held.docs["doc_id"].take(pa.array(doc)).combine_chunks()
                    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                    yield pa.RecordBatch.from_arrays([pa.array([token] * len(places), pa.int64()), ids, pa.array(places - starts)], ["token", "doc_id", "place"])

    return listed(spark, path, ENDING).mapInArrow(run, f"token long, doc_id {id_type}, place long")


def token_totals(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each token occurs, by rank alone; one row a file and token before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = Shard(read_file(name))
                counts = [held.count(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(counts, pa.int64())], ["token", "n"])

    return listed(spark, path, ENDING).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def stored_documents(docs: DataFrame, definition: str, path: str | None = None, closing: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Write the documents' ids as shards and read every document back from the files."""
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    path = path or scratch_path(spark, "shards")
    before = write_shards(docs, definition, path, closing, doc_id, text)
    if listed(spark, path, ENDING) is None:
        schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
        return spark.createDataFrame([], schema)
    return read_documents(spark, path, before, id_type, with_ids)
