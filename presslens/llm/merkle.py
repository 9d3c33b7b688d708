"""Document fingerprints: a Merkle tree of leaves, paragraphs and sections.

A paragraph is a line; its leaves are its sentences (short ones run on, long ones are cut). A
section is a run of paragraphs that ends where a paragraph's own digest says so, so an edit
moves no border elsewhere. A node's digest is that of its children's; the root's tests
equality, and comparing trees branch by branch locates edits.

The fingerprint is text: the root in hex, a colon, and the leaves' short digests, parted by
``.`` in a paragraph, ``,`` in a section and ``;`` in the document. Likeness is the Dice share
of common leaves, worked out from two fingerprints alone. Null and empty texts have the
fingerprint of no leaf; two of them are alike (1), one of them and another text are not (0).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from presslens.llm.common import text_value

LEAF = re.compile(r"[^\n]{40,200}?[.!?](?=\s|\Z)|[^\n]{1,200}")
SHORT = 4
SECTION_EVERY = 8


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def tree(text: str, known: dict[str, bytes] | None = None) -> tuple[bytes, list[list[list[bytes]]]]:
    """Root digest and the leaves' digests by section and paragraph; ``known`` remembers leaves."""
    known = {} if known is None else known
    sections: list[list[list[bytes]]] = []
    section: list[list[bytes]] = []
    marks: list[bytes] = []
    nodes: list[bytes] = []
    for line in text.split("\n") if text else ():
        leaves = []
        for leaf in LEAF.findall(line):
            d = known.get(leaf)
            if d is None:
                d = known[leaf] = _digest(leaf.encode("utf-8", "surrogatepass"))
            leaves.append(d)
        node = _digest(b"p" + b"".join(leaves))
        section.append(leaves)
        nodes.append(node)
        if node[0] % SECTION_EVERY == 0 and leaves:
            sections.append(section)
            marks.append(_digest(b"s" + b"".join(nodes)))
            section, nodes = [], []
    if section:
        sections.append(section)
        marks.append(_digest(b"s" + b"".join(nodes)))
    return _digest(b"r" + b"".join(marks)), sections


def fingerprint(text: str, known: dict[str, bytes] | None = None) -> str:
    root, sections = tree(text, known)
    body = ";".join(",".join(".".join(d[:SHORT].hex() for d in p) for p in s) for s in sections)
    return f"{root.hex()}:{body}"


def leaves_of(print_: str) -> list[str]:
    return [x for x in re.split("[.,;]", print_.partition(":")[2]) if x]


def likeness(a: str, b: str) -> float:
    """Share of common leaves of two fingerprints, from 0 to 1."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    return _dice(leaves_of(a), leaves_of(b))


def _dice(x: list[str], y: list[str]) -> float:
    if not x or not y:
        return float(not x and not y)
    return 2 * (Counter(x) & Counter(y)).total() / (len(x) + len(y))


def changed_paragraphs(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers of ``a`` that ``b`` doesn't have; equal roots are not entered."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    other = Counter(b.partition(":")[2].split(";"))
    paragraphs = Counter(p for s in b.partition(":")[2].split(";") for p in s.split(","))
    out = []
    for i, section in enumerate(a.partition(":")[2].split(";")):
        if other[section]:
            continue
        for k, p in enumerate(section.split(",")):
            if paragraphs[p]:
                paragraphs[p] -= 1
            else:
                out.append((i, k))
    return out


def fingerprints(text: Column | str = "text") -> Column:
    """Fingerprint of a text column, null counting as empty."""
    return text_value(fingerprint, "string")(text)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text and its likeness to both neighbours' texts.

    The order is by descending id, repeated ids by the digest of their text; a document without
    an id stands alone and counts as its own neighbour.
    Documents are dealt out by ranges of ids; the first document of a range also goes to
    the range that comes before it, so texts are shuffled once and no task needs a whole column.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = named.where(F.col("doc_id").isNotNull())
    cuts = [k / n_parts for k in range(1, n_parts)]
    bounds = np.array(sorted(set(known.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", cuts, 0.25 / n_parts)))) if cuts else np.array([])

    def part_of(ids: pa.Array) -> np.ndarray:
        """0 for the highest ids, counting up; null ids are spread over all parts."""
        values = ids.cast(pa.float64()).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
        ranks = len(bounds) - np.searchsorted(bounds, values, "right")
        return np.where(np.isneginf(values), np.arange(len(values)) % (len(bounds) + 1), ranks)

    number = F.arrow_udf(_typed(lambda ids: pa.array(part_of(ids), pa.int64())), "long")
    firsts = {r.part: r.first for r in known.select(number("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("first")).collect()}
    held = sorted(firsts)
    before = {p: held[k - 1] for k, p in enumerate(held)}  # the first range's goes to the last

    def goals(ids: pa.Array) -> pa.Array:
        parts = part_of(ids).tolist()
        return pa.array([[p] + [before[p]] * (i is not None and i == firsts[p]) for p, i in zip(parts, ids.to_pylist())], pa.list_(pa.int64()))

    goal = F.arrow_udf(_typed(goals), "array<long>")
    dealt = named.select("doc_id", "text", F.md5("text").alias("tie"), F.posexplode(goal("doc_id")).alias("extra", "part"))
    placed = dealt.repartitionById(max(n_parts, len(bounds) + 1), F.col("part").cast("int"))
    ordered = placed.sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "tie")
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("doc_id", "text", "extra", "part").mapInArrow(_walk, schema)


def _typed(fn):
    def run(ids: pa.Array) -> pa.Array:
        return fn(ids)

    return run


ROWS_AT_ONCE = 500


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each own document once its follower is known."""
    out: list[tuple] = []
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None
    id_type = None

    def batch() -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def emit(d, t: str, mark: str, leaves: dict, following: str, next_mark: str) -> None:
        new = edited(t, following)
        new_mark = fingerprint(new, leaves)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((d, len(t), sha, mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)))

    for rows in batches:
        id_type = rows.schema.field(0).type
        for doc, text, extra, part in zip(*(c.to_pylist() for c in rows.columns)):
            known: dict[str, bytes] = {}
            mark = fingerprint(text, known)
            if doc is None:
                emit(doc, text, mark, known, text, mark)
            else:
                if held is not None and held[-1] == part:
                    emit(*held[:-1], text, mark)
                held = None if extra else (doc, text, mark, known, part)
            if len(out) >= ROWS_AT_ONCE:
                yield batch()
                out.clear()
    if out:
        yield batch()
