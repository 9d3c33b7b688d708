"""Pieces the operators share: words, text functions over Arrow batches, bounded samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(UPPER_TO_LOWER)


def text_struct(fn: Callable[[str], Sequence], schema: str):
    """A column function: ``fn`` turns one text (null counts as empty) into the fields of ``schema``."""
    fields = list(to_arrow_schema(StructType.fromDDL(schema)))

    def run(texts: pa.Array) -> pa.Array:
        rows = [fn(t or "") for t in texts.to_pylist()]
        columns = zip(*rows) if rows else [()] * len(fields)
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, fields)]
        return pa.StructArray.from_arrays(arrays, fields=fields)

    return F.arrow_udf(run, schema)


def text_value(fn: Callable[[str], object], kind: str):
    """A column function: ``fn`` turns one text (null counts as empty) into one value."""
    (field,) = to_arrow_schema(StructType.fromDDL(f"v {kind}"))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fn(t or "") for t in texts.to_pylist()], field.type)

    return F.arrow_udf(run, kind)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows (never over ``2 * rows``), the same ones on every run.

    A row is in when the seeded hash of its key falls under a threshold; rows
    with a null key are left out. Pass ``total`` when it is known already.
    """
    total = df.count() if total is None else total
    df = df.where(F.col(key).isNotNull())
    if total <= rows:
        return df
    share = int(2**32 * rows / total)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**32)) < share).limit(2 * rows)
