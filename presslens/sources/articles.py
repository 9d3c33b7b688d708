"""The article table: required columns, header rules, null rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from presslens.functions.text import blank_if_null, clean_text, join_text

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("article_id", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

# Korean headers and the names used from here on.
HEADER_NAMES = {"뉴스제목": "title", "본문": "content", "가짜뉴스여부": "label"}


def with_article_ids(df: DataFrame, path_col: str) -> DataFrame:
    """Add ``article_id`` where files have none: a digest of file, title, content and the ordinal among copies.

    Stable for the same files; no order over all rows. Copies are numbered within a file.
    """
    parts = [F.col(path_col), blank_if_null(F.col("title")), blank_if_null(F.col("content"))]
    digest = F.xxhash64(*parts)
    ordinal = F.row_number().over(Window.partitionBy(path_col, digest).orderBy(F.col("label") if "label" in df.columns else digest))
    return df.withColumn("_copy", ordinal).withColumn("article_id", F.xxhash64(*parts, "_copy")).drop("_copy")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail while planning when a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower-case and strip the headers, then map the Korean names."""
    return df.toDF(*[c.lower().strip() for c in df.columns]).withColumnsRenamed(HEADER_NAMES)


def label_int(col: Column, null_as_zero: bool = False) -> Column:
    """Label as int; unreadable values become null, or 0 on request."""
    label = col.try_cast("double").try_cast("int")
    return F.coalesce(label, F.lit(0)) if null_as_zero else label


def unlabelled(df: DataFrame) -> DataFrame:
    """Mark rows without a known label: null, so that metrics skip them."""
    return df.withColumn("label", F.lit(None).cast("int"))


def apply_null_policy(df: DataFrame, policy: str, required: tuple[str, ...] = ("title", "content", "label")) -> DataFrame:
    """``drop_any``, ``drop_required``, ``fill`` (text to '', label to 0) or ``fill_text`` (label stays null)."""
    if policy == "drop_any":
        return df.dropna("any")
    if policy == "drop_required":
        return require_columns(df, *required).dropna("any", subset=list(required))
    if policy in ("fill", "fill_text"):
        filled = {c: blank_if_null(F.col(c)) for c in ("title", "content") if c in df.columns}
        if "label" in df.columns:
            filled["label"] = label_int(F.col("label"), null_as_zero=policy == "fill")
        return df.withColumns(filled)
    raise ValueError(f"unknown null policy {policy!r}")


def cleaned_articles(df: DataFrame, whole_word: bool = False, policy: str = "fill") -> DataFrame:
    """Fill nulls by ``policy``, clean title and content, and add the joined ``text``."""
    filled = apply_null_policy(require_columns(df, "title", "content"), policy)
    cleaned = filled.withColumns({c: clean_text(F.col(c), whole_word) for c in ("title", "content")})
    return cleaned.withColumn("text", join_text(F.col("title"), F.col("content")))
