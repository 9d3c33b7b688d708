"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index.

Tasks cut their rows into shards of about ``SHARD`` words and write each as one file: its terms, its
documents with their lengths, and for every term blocks of ``BLOCK`` postings
(document, occurrences) packed in bytes of their own, with the block's last document, most
occurrences and least document length. Nothing is shuffled to build it. A term's count of
documents is summed over the shards for the terms asked for.

Within a shard the lists of a query are ordered by the most they can add. From the top, lists are
essential: they are unpacked and their documents become candidates. As soon as all lists
left add less, together, than the k-th best score so far, they are non-essential: a candidate is
looked up in one of them only if its score, the bound of its block there and the bounds of the
lists after it still reach the k-th best; only blocks that hold such a candidate are unpacked.
Nothing below the k-th best is dropped before its bound says so, and equal scores stay, so the
ranking is exact. The best of each shard and query are merged by a ranked window.

Queries go to the shards in blocks of at most ``QUERIES`` rows and ``QUERY_CHARS`` characters.
Null and empty documents are in no list and not counted. Rows with one id are documents of
their own; null ids rank after equal scores. Queries without a known term have no result.
Repeated query rows have a result each. Very long texts make a longer shard. Other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import math
import struct
from collections import OrderedDict
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from presslens.llm.files import listed, read_file, write_file
from presslens.session import scratch_path

MAGIC = b"POSTING1"
ENDING = ".postings"
SHARD = 3_000_000
BLOCK = 128
QUERIES = 1000
QUERY_CHARS = 4_000_000
ROWS_AT_ONCE = 2000
KEPT_POSTINGS = 4_000_000
#: Letters, digits and all beyond ASCII stay, A-Z in lower case; any other byte parts terms.
BYTES = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and how many each text has."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    _, offsets, data = texts.buffers()
    changed = pa.py_buffer((data.to_pybytes() if data else b"").translate(BYTES))
    plain = pa.LargeStringArray.from_buffers(len(texts), offsets, changed, offset=texts.offset)
    lists = pc.ascii_split_whitespace(plain)
    words = pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(words), 0)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return words.filter(real), np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


# ---- shards ----


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers in 7-bit bytes, the last of each below 128; and where each ends."""
    values = values.astype(np.uint64)
    n = np.ones(len(values), np.int64)
    for k in range(1, 10):
        n += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(n.max(initial=0))):
        here = n > k
        more = (n[here] > k + 1).astype(np.uint8) << 7
        out[(ends - n)[here] + k] = (values[here] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes(), ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The numbers back from their bytes."""
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first) if len(raw) else np.zeros(0, np.int64)


def build(words: pa.Array, lengths: np.ndarray, doc_ids: pa.Array) -> list[bytes]:
    """The pieces of a shard's file; every document has at least one term."""
    coded = words.dictionary_encode()
    n_docs = len(lengths)
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys = place[coded.indices.to_numpy(zero_copy_only=False)] * n_docs + np.repeat(np.arange(n_docs), lengths)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    tf = np.diff(np.append(first, len(keys)))
    term, doc = np.divmod(keys[first], n_docs)
    df = np.bincount(term, minlength=len(names))
    within = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
    starts = np.flatnonzero(within % BLOCK == 0)
    steps = np.diff(doc, prepend=0)
    steps[starts] = doc[starts]
    data, ends = packed(np.column_stack([steps, tf]).ravel())
    blocks = pa.table(
        {
            "last": doc[np.append(starts[1:], len(doc)) - 1], "most": np.maximum.reduceat(tf, starts),
            "least": np.minimum.reduceat(lengths[doc], starts), "end": ends[2 * np.append(starts[1:], len(doc)) - 1],
        }
    )
    listed_terms = pa.table({"term": names.take(pa.array(order)), "df": df, "blocks": np.bincount(term[starts], minlength=len(names))})
    docs = pa.table({"doc_id": doc_ids, "length": lengths})
    sections = [_stored(t) for t in (listed_terms, blocks, docs)] + [data]
    head = json.dumps([len(s) for s in sections]).encode()
    return [MAGIC, struct.pack("<I", len(head)), head, *sections]


def _stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


class Shard:
    """A shard's file; sections are read when they are asked for."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of postings")
        (size,) = struct.unpack_from("<I", raw, len(MAGIC))
        at = len(MAGIC) + 4 + size
        self.sections = []
        for n in json.loads(raw[len(MAGIC) + 4 : at]):
            self.sections.append(memoryview(raw)[at : at + n])
            at += n
        self.data = np.frombuffer(self.sections[3], np.uint8)
        self.kept: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.n_kept = 0

    def _table(self, k: int) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self.sections[k])).read_all()

    @cached_property
    def terms(self) -> pa.Table:
        return self._table(0)

    @cached_property
    def blocks(self) -> dict[str, np.ndarray]:
        return {n: c.to_numpy() for n, c in zip(("last", "most", "least", "end"), self._table(1).columns)}

    @cached_property
    def docs(self) -> pa.Table:
        return self._table(2)

    @cached_property
    def lengths(self) -> np.ndarray:
        return self.docs["length"].to_numpy()

    @cached_property
    def first_blocks(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.terms["blocks"].to_numpy())])

    def known(self, asked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number in the shard, number in ``asked``) of the terms that occur here."""
        found = pc.index_in(self.terms["term"].combine_chunks(), value_set=asked.cast(self.terms["term"].type))
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        here = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        return here, found.take(pa.array(here)).to_numpy(zero_copy_only=False).astype(np.int64)

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, occurrences) of ascending blocks of one term."""
        ends = self.blocks["end"]
        begins = np.where(blocks > 0, ends[blocks - 1], 0)
        sizes = ends[blocks] - begins
        if len(blocks) and blocks[-1] - blocks[0] + 1 == len(blocks):
            raw = self.data[begins[0] : ends[blocks[-1]]]
        else:
            raw = self.data[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        values = unpacked(raw).reshape(-1, 2)
        # a block's first step is a document's own number; every block but a term's last is full
        doc, first = np.cumsum(values[:, 0]), np.arange(0, len(values), BLOCK)
        before = np.concatenate([[0], doc[first[1:] - 1]])
        return doc - np.repeat(before, np.diff(np.append(first, len(values)))), values[:, 1]

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """A term's postings; lists that many queries share are kept for a while."""
        if term in self.kept:
            self.kept.move_to_end(term)
            return self.kept[term]
        found = self.kept[term] = self.postings(np.arange(self.first_blocks[term], self.first_blocks[term + 1]))
        self.n_kept += len(found[0])
        while self.n_kept > KEPT_POSTINGS and len(self.kept) > 1:
            self.n_kept -= len(self.kept.popitem(last=False)[1][0])
        return found


# ---- search ----


class Scoring:
    """The whole-number score: N documents with L terms, a term's weight from its count of documents."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def share(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term adds per unit of weight; it grows with ``tf`` and falls with ``length``."""
        m = 10 + (90 * length * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def search_shard(shard: Shard, scoring: Scoring, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of the ``k`` best and those equal to the last; ``query`` lists (term, weight)."""
    lists = []
    for term, weight in query:
        span = slice(int(shard.first_blocks[term]), int(shard.first_blocks[term + 1]))
        bounds = weight * scoring.share(shard.blocks["most"][span], shard.blocks["least"][span])
        lists.append((int(bounds.max()), term, weight, bounds, span))
    lists.sort(key=lambda x: (x[0], x[1]))
    upto = np.cumsum([0] + [x[0] for x in lists]).tolist()  # upto[i]: most that lists before i add together
    score = np.zeros(len(shard.lengths), np.int64)
    needed = 1
    i = len(lists)
    while i and upto[i] >= needed:  # essential
        _, term, weight, _, _ = lists[i - 1]
        doc, tf = shard.whole(term)
        score[doc] += weight * scoring.share(tf, shard.lengths[doc])
        i -= 1
        needed = max(needed, _kth(score, k))
    found = np.flatnonzero(score)
    for j in range(i - 1, -1, -1):  # non-essential
        _, term, weight, bounds, span = lists[j]
        found = found[score[found] + upto[j + 1] >= needed]
        block = np.searchsorted(shard.blocks["last"][span], found)
        there = block < len(bounds)
        most = np.zeros(len(found), np.int64)
        most[there] = bounds[block[there]]
        hopeful = score[found] + most + upto[j] >= needed
        asked = hopeful & there
        if asked.any():
            doc, tf = shard.postings(span.start + np.unique(block[asked]))
            held = found[asked]
            at = np.minimum(np.searchsorted(doc, held), len(doc) - 1)
            hit = doc[at] == held
            score[held[hit]] += weight * scoring.share(tf[at[hit]], shard.lengths[held[hit]])
        found = found[hopeful]
        needed = max(needed, _kth(score[found], k))
    found = found[score[found] >= needed]
    return found, score[found]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def write_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> Scoring:
    """Write the index of all documents under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, n_docs, n_words = TaskContext.get().partitionId(), 0, 0, 0, 0
        held: list[tuple[pa.Array, np.ndarray, pa.Array]] = []

        def flush() -> None:
            words, lengths, ids = (list(c) for c in zip(*held))
            pieces = build(pa.concat_arrays(words), np.concatenate(lengths), pa.concat_arrays(ids))
            write_file(f"{path}/{part:06d}-{number:06d}{ENDING}", *pieces)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                words, lengths = terms(batch.column(1).slice(at, ROWS_AT_ONCE))
                real = pa.array(np.flatnonzero(lengths))
                lengths = lengths[lengths > 0]
                if len(words):
                    held.append((words, lengths, batch.column(0).slice(at, ROWS_AT_ONCE).take(real)))
                size, n_docs, n_words = size + len(words), n_docs + len(lengths), n_words + len(words)
                if size >= shard:
                    flush()
                    number, size = number + 1, 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_words], pa.int64())], ["docs", "words"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = rows.mapInArrow(run, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    return Scoring(total[0] or 0, total[1] or 0)


def _frequencies(files: DataFrame, asked: pa.Array) -> dict[int, int]:
    """Documents with each term asked for."""
    shared = files.sparkSession.sparkContext.broadcast(asked)  # the terms of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = Shard(read_file(name))
                here, number = held.known(shared.value)
                df = held.terms["df"].to_numpy()[here]
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(df)], ["term", "df"])

    found = files.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in found.collect()}  # at most the terms of one block of queries


def _searched(files: DataFrame, scoring: Scoring, queries: list[pa.Array], k: int, id_type: str) -> DataFrame:
    """(query, doc_id, score): at least the ``k`` best of each shard and query."""
    asked = pc.unique(pa.concat_arrays(queries))
    numbers = [pc.index_in(q, value_set=asked).to_numpy(zero_copy_only=False).tolist() for q in queries]
    df = _frequencies(files, asked)
    weights = {t: scoring.weight(n) for t, n in df.items()}
    shared = files.sparkSession.sparkContext.broadcast((asked, numbers, weights))  # one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_asked, lists, weight = shared.value
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = Shard(read_file(name))
                here = dict(zip(*(x.tolist() for x in reversed(held.known(terms_asked)))))
                ids = held.docs["doc_id"].combine_chunks()
                for q, wanted in enumerate(lists):
                    doc, score = search_shard(held, scoring, [(here[t], weight[t]) for t in wanted if t in here], k)
                    if not len(doc):
                        continue
                    table = pa.table({"doc_id": ids.take(pa.array(doc)), "score": score})
                    best = pc.sort_indices(table, [("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")[:k]
                    table = table.take(best).combine_chunks()
                    columns = [pa.array([q] * len(table), pa.int64()), *[c.chunk(0) for c in table.columns]]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return files.mapInArrow(run, f"query long, doc_id {id_type}, score long")


def search(spark: SparkSession, path: str, scoring: Scoring, queries: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", id_type: str = "bigint") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every query."""
    item_type = queries.schema[item_id].dataType.simpleString()
    schema = f"item_id {item_type}, rank int, doc_id {id_type}, score long"
    files = listed(spark, path, ENDING)
    if files is None:
        return spark.createDataFrame([], schema)
    parts = []
    for items, texts in _blocks(queries.select(item_id, text)):
        words, counts = terms(pa.array(texts, pa.string()))
        cuts = np.concatenate([[0], np.cumsum(counts)])
        lists = [pc.unique(words.slice(int(a), int(b - a))) for a, b in zip(cuts, cuts[1:])]
        if not len(words):
            continue
        found = _searched(files, scoring, lists, k, id_type)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(items)), f"query long, item_id {item_type}")
        # at most QUERIES rows
        parts.append(merged.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _blocks(queries: DataFrame) -> Iterator[tuple[list, list[str]]]:
    items, texts, size = [], [], 0
    for item, text in queries.toLocalIterator():
        items.append(item)
        texts.append(text or "")
        size += len(texts[-1])
        if len(items) >= QUERIES or size >= QUERY_CHARS:
            yield items, texts
            items, texts, size = [], [], 0
    if items:
        yield items, texts


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Index ``docs`` and give the ``k`` best of them for every query."""
    path = scratch_path(docs.sparkSession, "postings")
    scoring = write_index(docs, path, doc_id, text)
    return search(docs.sparkSession, path, scoring, queries, k, item_id, text, docs.schema[doc_id].dataType.simpleString())
