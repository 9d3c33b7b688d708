"""Packing by concatenate and cut: token totals, prefix sums, fixed windows.

The first pass tokenizes every text once and writes its ids, with the task it ran in and the
running total of ids inside that task. Only one total for each task meets in the driver;
its prefix sums give every document's place in one long row of ids. The second pass cuts
that row into windows of ``window`` ids: a document becomes one piece for each window it
touches, and a window's pieces may come from several documents. Every window is full but
the last, so nothing but that is padded.

Null and empty texts hold the closing id alone. Repeated rows are packed as often as they
occur. An empty table gives no pieces. Very long texts become many pieces of one row each.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from presslens.llm.wordids import MARKS, WordIds, _after, _stretches, with_closing
from presslens.session import scratch_path

#: About so many ids are made and handed on at once.
IDS_AT_ONCE = 4_000_000
#: Words that are encoded as one text.
WORDS_AT_ONCE = 50_000
#: A blank before another blank character; elsewhere a blank always starts a new unit of a byte-level tokenizer.
BLANKS = r" [\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


class Ids(WordIds):
    """Token ids of texts; the ids of a word after a blank are remembered.

    ``definition`` is the tokenizer's own JSON text. A plain byte-level tokenizer never joins
    across a blank that a non-blank follows, so texts are cut there and only words not
    seen lately are encoded, many at once. Any other tokenizer or text is encoded whole.
    """

    def __init__(self, definition: str):
        super().__init__(definition)
        kept = json.loads(definition)
        steps = kept.get("pre_tokenizer") or {}
        plain = steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True)
        self.by_word = bool(plain and not kept.get("normalizer") and not kept.get("truncation") and not kept["model"].get("dropout"))
        self.special = [t["content"] for t in kept.get("added_tokens", [])]
        if self.by_word:
            # a byte-level token has a character for each byte
            self.token_bytes = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.size)])

    def batch(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of every text as bytes."""
        ids, counts = self.flat(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, BLANKS)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        if not pc.any(odd).as_py():
            return self._cut(texts)
        found = self._cut(texts.filter(pc.invert(odd))), self._whole(texts.filter(odd).to_pylist())
        order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        n = np.concatenate([n for _, n in found])
        counts, starts = np.empty_like(n), np.empty_like(n)
        counts[order], starts[order] = n, np.cumsum(n) - n
        return _stretches(np.concatenate([ids for ids, _ in found]), starts, counts), counts

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without odd blanks or special tokens: the first word as it is, every other one after its blank."""
        words = pc.split_pattern(texts, " ")
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        flat = pc.list_flatten(words)
        first = np.zeros(len(flat), bool)
        first[bounds[:-1]] = True
        first = pa.array(first)
        heads, rest = flat.filter(first).dictionary_encode(), flat.filter(pc.invert(first)).dictionary_encode()
        pools = self._whole(heads.dictionary.to_pylist()), self._pool(rest.dictionary)
        pool, lengths = (np.concatenate(x) for x in zip(*pools))
        codes = np.empty(len(flat), np.int64)
        at = first.to_numpy(zero_copy_only=False)
        codes[at] = heads.indices.to_numpy(zero_copy_only=False)
        codes[~at] = rest.indices.to_numpy(zero_copy_only=False) + np.int64(len(heads.dictionary))
        n = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        return _stretches(pool, (np.cumsum(lengths) - lengths)[codes], n), np.diff(upto[bounds])

    def _pool(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        stems = pc.ascii_rtrim(words, characters=MARKS)
        heads = pc.if_else(pc.utf8_is_alpha(stems), stems, words)
        marks = _after(words, heads).dictionary_encode()
        coded = heads.dictionary_encode()
        starts, lengths = self._places(coded.dictionary)
        tails, sizes = self._whole(marks.dictionary.to_pylist())  # some marks without a blank, or nothing
        at, tail = (x.indices.to_numpy(zero_copy_only=False) for x in (coded, marks))
        # head and closing marks of a word stand side by side
        n = np.stack([lengths[at], sizes[tail]], axis=1)
        places = np.stack([starts[at], (np.cumsum(sizes) - sizes)[tail] + len(self.pool)], axis=1)
        return _stretches(np.concatenate([self.pool, tails]), places.ravel(), n.ravel()), n.sum(axis=1)

    def _forget(self) -> None:
        """Only the empty word stays: a blank at a text's end."""
        super()._forget()
        self.pool, n = self._whole([" "])
        self.lengths = n

    def _add(self, words: pa.Array) -> int:
        if len(words):
            parts = [self._after_blank(words.slice(at, WORDS_AT_ONCE)) for at in range(0, len(words), WORDS_AT_ONCE)]
            self.known = pa.concat_arrays([self.known, words])
            self.pool = np.concatenate([self.pool, *[ids for ids, _ in parts]])
            self.lengths = np.concatenate([self.lengths, *[n for _, n in parts]])
            self.starts = np.cumsum(self.lengths) - self.lengths
        return len(self.known)

    def _after_blank(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Encode words, each after a blank, as one text and cut its ids by their bytes."""
        (e,) = self.tokenizer.encode_batch_fast([" " + " ".join(words.to_pylist())], add_special_tokens=False)
        ids = np.array(e.ids, self.dtype)
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(ends, prepend=0)


@functools.lru_cache(maxsize=1)
def _encoder(definition: str) -> Ids:
    """Kept between the tasks of a Python worker, so its words are."""
    return Ids(definition)


def tokenized(docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text", closing: int = 0) -> DataFrame:
    """(doc_id, ids, n, part, place): the ids of each text with ``closing`` after them, in the task's order."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a tokenizer file, some MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        width = encoder.dtype.itemsize
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, n, at in with_closing(encoder, batch.column(1), closing, IDS_AT_ONCE):
                ends = place + np.cumsum(n)
                cuts = np.concatenate([[0], np.cumsum(n) * width]).astype(np.int64)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
                kept = [batch.column(0).slice(at, len(n)), raw.cast(pa.binary()), pa.array(n), pa.array(np.full(len(n), part)), pa.array(ends - n)]
                place = int(ends[-1])
                yield pa.RecordBatch.from_arrays(kept, ["doc_id", "ids", "n", "part", "place"])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids binary, n long, part long, place long"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def pack(docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text", window: int = 1024, closing: int = 0) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    path = scratch_path(spark, "ids")
    tokenized(docs, definition, doc_id, text, closing).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    totals = sorted(rows.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each task
    offsets, total = {}, 0
    for part, n in totals:
        offsets[part] = total
        total += n
    width = Ids(definition).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, raw, sizes, parts, places = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for d, ids, n, part, place in zip(doc, raw, sizes, parts, places):
                first = offsets[part] + place
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, window)
                    length = min(n - start, window - offset)
                    piece = np.frombuffer(ids, width, length, start * width.itemsize)
                    out.append((d, start, length, piece.astype("<u4").tobytes(), n, sequence, offset))
                    start += length
            for at in range(0, len(out), 2000):
                columns = zip(*out[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]
    return rows.select("doc_id", "ids", "n", "part", "place").mapInArrow(run, schema)


def ids_checksum(ids):
    """crc32 of pieces' little-endian 32-bit ids."""
    return F.crc32(ids)
