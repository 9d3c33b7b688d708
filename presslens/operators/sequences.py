"""Fixed-length id sequences for single texts and for title-content pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslens.operators.lookup import lookup
from presslens.operators.vocabulary import CLS, SEP

HEAD_LENGTH = 256
TAIL_LENGTH = 500


def keep_head(tokens: Column, length: int) -> Column:
    return F.slice(tokens, 1, length)


def keep_tail(tokens: Column, length: int) -> Column:
    return F.slice(tokens, F.greatest(F.size(tokens) - length, F.lit(0)) + 1, F.lit(length))


def pad_right(ids: Column, length: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def numericalize(
    df: DataFrame,
    id_col: str,
    tokens_col: str,
    vocabulary: DataFrame,
    length: int = HEAD_LENGTH,
    truncate: str = "head",
    unknown_id: int = 1,
    num_words: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, *keep, ids)``: token ids cut to ``length`` and padded with 0.

    Tokens are cut before they are looked up, so a text of any size sends at
    most ``length`` rows. With ``num_words`` every id from there on reads as unknown.
    """
    cut_tokens = {"head": keep_head, "tail": keep_tail}[truncate](F.col(tokens_col), length)
    short = df.select(id_col, *keep, cut_tokens.alias("tokens"))
    table = vocabulary.select("token", "id")
    if num_words is not None:
        table = table.where(F.col("id") < num_words)
    rows = short.select(id_col, *keep, F.posexplode_outer("tokens").alias("pos", "token"))
    found = lookup(rows, "token", table, payload_bytes=16, keep_missing=True)
    known = F.when(F.col("pos").isNotNull(), F.coalesce(F.col("id"), F.lit(unknown_id)).cast("bigint"))
    # At most `length` entries per text; the row of an empty text adds none.
    listed = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", known.alias("id")))))
    ids = found.groupBy(id_col, *keep).agg(F.transform(listed, lambda e: e["id"]).alias("ids"))
    return ids.withColumn("ids", pad_right(F.col("ids"), length))


def pair_lengths(title_len: Column, content_len: Column, budget: int) -> tuple[Column, Column]:
    """How much of each side stays when the longer one loses a token at a time."""
    half_up, half_down = (budget + 1) // 2, budget // 2
    title = F.least(title_len, F.greatest(F.lit(half_up), F.lit(budget) - content_len))
    content = F.least(content_len, F.greatest(F.lit(half_down), F.lit(budget) - title_len))
    return title, content


def pair_sequences(
    df: DataFrame, id_col: str, title_tokens: str, content_tokens: str, vocabulary: DataFrame, length: int = HEAD_LENGTH
) -> DataFrame:
    """``(id, ids, mask, segments)`` for ``<cls> title <sep> content <sep>``.

    The vocabulary must have been built with the ``<cls>`` and ``<sep>`` rows.
    """
    t_len, c_len = pair_lengths(F.size(title_tokens), F.size(content_tokens), length - 3)
    sized = df.select(id_col, title_tokens, content_tokens, t_len.alias("t_len"), c_len.alias("c_len"))
    sep = F.array(F.lit(SEP))
    tokens = F.concat(
        F.array(F.lit(CLS)), F.slice(title_tokens, F.lit(1), F.col("t_len")), sep,
        F.slice(content_tokens, F.lit(1), F.col("c_len")), sep,
    )
    pairs = sized.select(id_col, "t_len", "c_len", tokens.alias("tokens"))
    ids = numericalize(pairs, id_col, "tokens", vocabulary, length, keep=("t_len", "c_len"))
    first = F.col("t_len") + 2
    second = F.col("c_len") + 1

    def repeat(value: int, times: Column) -> Column:
        return F.array_repeat(F.lit(value).cast("bigint"), times)

    return ids.select(
        id_col,
        "ids",
        pad_right(repeat(1, first + second), length).alias("mask"),
        pad_right(F.concat(repeat(0, first), repeat(1, second)), length).alias("segments"),
    )
