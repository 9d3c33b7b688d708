"""CSV article files in UTF-8 or a legacy Korean encoding."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from presslens.sources.articles import apply_null_policy, normalise_headers, require_columns, with_article_ids

# Strings the usual CSV reader takes for a missing value.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Encodings in the order they are tried, with the JVM's names;
# `lossy` decodes as UTF-8 and replaces what does not fit.
ENCODINGS = {"utf-16": "UTF-16", "utf-8-sig": "UTF-8", "euc-kr": "EUC-KR", "cp949": "x-windows-949", "lossy": "UTF-8"}


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    encoding: str = "UTF-8",
    schema: T.StructType | None = None,
    multi_line: bool = True,
    na_strings: tuple[str, ...] = NA_STRINGS,
) -> DataFrame:
    """CSV with a header; fields may hold line breaks and doubled quotes.

    A multi-line file is parsed by one task, so deliver large sets as many
    files, or pass ``multi_line=False`` when no field holds a line break: then
    files are split. Columns go by their header, never by position; a ``schema``
    picks and casts them, and files whose headers differ stop the scan (see
    ``load_articles`` for those). Legacy encodings need Spark's old charset setting, which is
    switched on here and must stay on until the rows are read.
    """
    jvm_name = ENCODINGS.get(encoding.lower(), encoding)
    if not jvm_name.upper().startswith(("UTF-", "US-ASCII", "ISO-8859-1")):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", jvm_name)
    names = reader.csv(paths).columns
    # With a schema of the header's own names every file's header is held against it.
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = reader.schema(texts).option("enforceSchema", False).csv(paths)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

    def present(name: str):
        col = F.col(f"`{name}`")
        return F.when(~col.isin(*na_strings), col)

    df = df.withColumns({c: present(c) for c in strings})
    return df if schema is None else with_schema(df, schema)


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by normalised header, cast; unreadable values are null."""
    named = require_columns(normalise_headers(df), *schema.names)
    return named.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def _decodes_as(codec: str):
    @F.pandas_udf("boolean")
    def decodes(lines: pd.Series) -> pd.Series:
        def fits(line: bytes) -> bool:
            try:
                line.decode(codec)
                return True
            except UnicodeDecodeError:
                return False

        return lines.map(lambda line: fits(bytes(line)))

    return decodes


def detect_encodings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, encoding)``: UTF-16 by its mark, else the first encoding in which every line of a file decodes.

    Files are read as raw lines, so large ones are split among tasks; none of
    the other encodings uses the line break byte inside a character.
    """
    return _scanned(spark, paths).select("path", "encoding")


def _scanned(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, encoding, header)`` of every file; the header is its first line as bytes."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"),
        "value", F.col("value").cast("binary").alias("raw"),
    )
    # An ASCII line decodes in every encoding and need not reach Python.
    checked = lines.where(F.octet_length("value") != F.length(F.regexp_replace("value", r"[^\x00-\x7F]", ""))).select(
        "path", F.is_valid_utf8("value").alias("utf8"), _decodes_as("euc-kr")(F.col("raw")).alias("euc"), _decodes_as("cp949")(F.col("raw")).alias("cp949"),
    )
    ok = checked.groupBy("path").agg(*[F.bool_and(c).alias(c) for c in ("utf8", "euc", "cp949")])
    # Of a file split among tasks only the first line of its first block is the header.
    firsts = lines.where("at = 0").groupBy("path").agg(F.min_by("raw", "n").alias("header"))
    mark = F.hex(F.substring("header", 1, 2)).isin("FFFE", "FEFF")
    yes = {c: F.coalesce(c, F.lit(True)) for c in ("utf8", "euc", "cp949")}
    choice = F.when(mark, "utf-16").when(yes["utf8"], "utf-8-sig").when(yes["euc"], "euc-kr").when(yes["cp949"], "cp949").otherwise("lossy")
    return firsts.join(ok, "path", "left").select("path", choice.alias("encoding"), "header")


def read_csv_detected(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Read files of unknown encodings: one scan per encoding found, united by name.

    A column ``encoding`` tells how each row was decoded.
    """
    found: dict[str, list[str]] = {}
    for row in detect_encodings(spark, paths).collect():
        found.setdefault(row["encoding"], []).append(row["path"])
    if not found:
        raise ValueError(f"no files under {paths}")
    parts = [
        read_csv(spark, files, enc, schema, multi_line).withColumn("encoding", F.lit(enc)) for enc, files in sorted(found.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_articles(
    spark: SparkSession, paths: str | list[str], policy: str = "fill_text", multi_line: bool = True, na_strings: tuple[str, ...] = NA_STRINGS
) -> DataFrame:
    """Files to articles: detect, read, name the columns, give ids, apply a null policy.

    Files may differ in encoding and in the order or spelling of their headers; files that
    agree in both share a scan. Columns ``article_id, title, content, label``: an id is given
    where the file has none, a missing title or label is null before the policy.
    """
    groups: dict[tuple[str, bytes], list[str]] = {}
    for row in _scanned(spark, paths).collect():  # one row for each file
        groups.setdefault((row["encoding"], bytes(row["header"])), []).append(row["path"])
    if not groups:
        raise ValueError(f"no files under {paths}")
    parts = []
    for (encoding, _), files in sorted(groups.items()):
        raw = read_csv(spark, files, encoding, multi_line=multi_line, na_strings=na_strings)
        df = require_columns(normalise_headers(raw.withColumn("_path", F.col("_metadata.file_path"))), "content")
        for name in ("title", "label"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast("string"))
        df = df.withColumn("label", F.col("label").try_cast("double").try_cast("int"))
        if "article_id" not in df.columns:
            df = with_article_ids(df, "_path")
        parts.append(df.select(F.col("article_id").try_cast("bigint").alias("article_id"), "title", "content", "label"))
    return apply_null_policy(reduce(DataFrame.unionByName, parts), policy)
