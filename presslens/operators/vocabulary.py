"""Token counts, vocabularies and the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presslens.operators.ordered import ranked

PAD, UNKNOWN, OOV, CLS, SEP = "<pad>", "<unk>", "<OOV>", "<cls>", "<sep>"
NUM_WORDS = 30_000


def exploded(df: DataFrame, tokens_col: str, *keep: str) -> DataFrame:
    """One row per token with its position.

    The outer form avoids the size filter a plain explode infers, which would
    run the tokenizer twice; the row of an empty list is dropped here.
    """
    rows = df.select(*keep, F.posexplode_outer(tokens_col).alias("pos", "token"))
    return rows.where(F.col("token").isNotNull())


def token_counts(df: DataFrame, tokens_col: str) -> DataFrame:
    return exploded(df, tokens_col).groupBy("token").agg(F.count("*").alias("cnt"))


def _special_rows(df: DataFrame, specials: tuple[str, ...], first_id: int) -> DataFrame:
    rows = [(token, i, 0) for i, token in enumerate(specials, first_id)]
    return df.sparkSession.createDataFrame(rows, "token string, id bigint, cnt bigint")


def frequency_vocabulary(
    df: DataFrame, tokens_col: str, min_freq: int = 2, specials: tuple[str, ...] = (PAD, UNKNOWN)
) -> DataFrame:
    """``(token, id, cnt)``: the specials, then tokens by count, ties by token."""
    kept = token_counts(df, tokens_col).where(F.col("cnt") >= min_freq)
    ids = ranked(kept, [F.col("cnt").desc(), F.col("token")], "rank")
    numbered = ids.select("token", (F.col("rank") - 1 + len(specials)).alias("id"), "cnt")
    return _special_rows(df, specials, 0).unionAll(numbered)


def capped_vocabulary(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """``(token, id, cnt)``: OOV is 1, words follow by count, ties by first appearance."""
    # A text sends all its tokens to be counted and its distinct ones, in order
    # of appearance, to find the first; plain numbers keep the aggregate hashed.
    lists = F.array(F.col(tokens_col), F.array_distinct(tokens_col))
    rows = (
        df.select(id_col, F.posexplode_outer(lists).alias("kind", "tokens"))
        .select(id_col, "kind", F.posexplode_outer("tokens").alias("pos", "token"))
        .where(F.col("token").isNotNull())
    )
    text = F.when(F.col("kind") == 1, F.col(id_col))
    counts = rows.groupBy("token").agg(
        F.count_if(F.col("kind") == 0).alias("cnt"), F.min(text).alias("text"), F.min_by("pos", text).alias("pos")
    )
    ids = ranked(counts, [F.col("cnt").desc(), F.col("text"), F.col("pos")], "rank")
    numbered = ids.select("token", (F.col("rank") + 1).alias("id"), "cnt")
    return _special_rows(df, (OOV,), 1).unionAll(numbered)


def embedding_matrix(
    vocabulary: DataFrame, vectors: DataFrame, dim: int, random_missing: bool = False, pad_zero: bool = True, seed: int = 42
) -> DataFrame:
    """``(id, token, vec)`` for every vocabulary row.

    Words without a vector get zeros, or seeded N(0, 0.1) noise on request; the
    padding row is zero unless ``pad_zero`` is off.
    """
    joined = vocabulary.join(vectors.select("token", "vec"), "token", "left")
    zeros = F.array_repeat(F.lit(0.0), dim)
    missing = F.array(*[F.randn(seed + i) * 0.1 for i in range(dim)]) if random_missing else zeros
    vec = F.coalesce(F.col("vec").cast("array<double>"), missing)
    if pad_zero:
        vec = F.when(F.col("token") == PAD, zeros).otherwise(vec)
    return joined.select("id", "token", vec.alias("vec"))
