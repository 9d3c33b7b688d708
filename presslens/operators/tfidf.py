"""TF-IDF over words and bigrams: fit, transform, cosines, centroid.

Fitting counts words, then the bigrams of words that are frequent enough, in Arrow batches;
it shuffles one row per distinct term counted and batch. Transforming shuffles
nothing: the vocabulary is capped at ``max_features`` terms of at most
``LONGEST_KEY`` characters, so it fits every executor, and each article keeps
its own sparse vectors in its row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from presslens.functions.text import term_words, with_bigrams
from presslens.functions.vector import (
    cosine_from,
    sparse_dot,
    sparse_norm,
    sparse_sum,
    unwrapped,
)
from presslens.operators.ordered import ranked
from presslens.session import cut

MAX_FEATURES = 50_000
FEATURE_LIMIT = 1_000_000
LONGEST_KEY = 64
# Up to this many candidates are sorted in one task; more are ranked over range partitions.
SORTABLE_TERMS = 500_000
# Words put in order at once while a batch of texts is counted.
WORDS_AT_ONCE = 1_000_000


def terms(col: Column) -> Column:
    """Words and bigrams; bound to a variable, the words are found once and not at every mention."""
    return F.get(F.transform(F.array(term_words(col)), with_bigrams), F.lit(0))


def bounded_key(term: Column) -> Column:
    """Terms over ``LONGEST_KEY`` characters stand in as their SHA-256 digest.

    ``#`` never occurs in a term, so a digest cannot meet a real one. This puts
    a bound on what a vocabulary of n terms weighs, whatever the texts hold.
    """
    return F.when(F.length(term) > LONGEST_KEY, F.concat(F.lit("#"), F.sha2(term, 256))).otherwise(term)


def stacked(df: DataFrame, *text_cols: str) -> DataFrame:
    """Every text column as documents of its own, tagged with its side."""
    sides = [df.select(F.lit(c).alias("side"), F.col(c).alias("text")) for c in text_cols]
    out = sides[0]
    for side in sides[1:]:
        out = out.unionAll(side)
    return out


def term_statistics(df: DataFrame, *text_cols: str) -> DataFrame:
    """``(term, df, cf)`` with each text column counted as separate documents.

    A document emits its terms once for the corpus count and its distinct terms
    once for the document count. Both are summed before the shuffle, so no
    grouping by document is needed and a frequent term costs one row per task.
    ``explode_outer`` is used because a plain ``explode`` adds a size filter that
    would run the tokenizer a second time.
    """
    tokens = df.select(*[terms(F.col(c)).alias(c) for c in text_cols])
    every = [F.col(c) for c in text_cols]
    lists = F.array(*every, *[F.array_distinct(c) for c in every])
    return (
        tokens.select(F.posexplode_outer(lists).alias("kind", "terms"))
        .select((F.col("kind") >= len(text_cols)).alias("first_seen"), F.explode_outer("terms").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(
            F.count_if(F.col("first_seen")).alias("df"),
            F.count_if(~F.col("first_seen")).alias("cf"),
        )
    )


def most_counted(statistics: DataFrame, limit: int, sortable: int = SORTABLE_TERMS) -> DataFrame:
    """The ``limit`` terms of the highest ``cf``, ties by term, without a top-k that meets in one task.

    Counting terms by ``cf`` finds the count below which nothing is kept; a corpus of n
    tokens has under ``sqrt(2 n)`` different counts. Only terms at or above it are put in
    order: by a plain sort where they were counted to be few, else by ranks over range
    partitions, so a wide band of ties is never gathered.
    """
    written = cut(statistics)
    found = _cutoff(written, limit)
    if (found["n"] or 0) <= limit:
        return written
    order = [F.col("cf").desc(), F.col("term")]
    held = written.where(F.col("cf") >= found["cf"])
    if found["held"] <= sortable:
        return held.orderBy(*order).limit(limit)
    return ranked(held, order, "_rank").where(F.col("_rank") <= limit).drop("_rank")


def _cutoff(counts: DataFrame, limit: int) -> Row:
    """Rows (n), the ``cf`` of the ``limit``-th most counted one, and how many reach it (held)."""
    above = Window.orderBy(F.col("cf").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.groupBy("cf").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(above))
    enough = F.when(F.col("upto") >= limit, F.col("upto"))
    return reached.agg(F.max("upto").alias("n"), F.min(enough).alias("held"), F.max_by("cf", -enough).alias("cf")).first()


def _keyed(words: pa.Array) -> pa.Array:
    """``bounded_key`` of every word."""
    long = pc.greater(pc.utf8_length(words), LONGEST_KEY)
    if not pc.any(long).as_py():
        return words
    digests = ["#" + hashlib.sha256(w.encode()).hexdigest() for w in words.filter(long).to_pylist()]
    return pc.replace_with_mask(words, long, pa.array(digests, words.type))


def _coded(texts: pa.ListArray, keys: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(codes, text, texts)`` of whole texts at a time; a word is its place in ``keys``, a bigram (first + 1) * len(keys) + second."""
    ends, size, start = texts.offsets.to_numpy().astype(np.int64), len(keys), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + WORDS_AT_ONCE, "right")) - 1)
        words = _keyed(texts.values.slice(ends[start], ends[stop] - ends[start]))
        ids = pc.fill_null(pc.index_in(words, keys), -1).to_numpy().astype(np.int64)
        text = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
        known = ids >= 0
        pair = known[1:] & known[:-1] & (text[1:] == text[:-1])
        codes = np.concatenate([ids[known], (ids[:-1][pair] + 1) * size + ids[1:][pair]])
        yield codes, np.concatenate([text[known], text[1:][pair]]), stop - start
        start = stop


def _coded_counts(texts: pa.ListArray, keys: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(codes, df, cf)`` of whole texts at a time."""
    for codes, text, n in _coded(texts, keys):
        # size * (size + 1) codes of at most FEATURE_LIMIT words leave room for a million texts
        yield _runs(np.sort(codes * n + text), n)


def _runs(order: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code of the sorted ``code * texts + text``: the code, its texts and its places."""
    codes = order // texts
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    seen = np.diff(order, prepend=-1) > 0
    return codes[starts], np.add.reduceat(seen, starts, dtype=np.int64) if len(starts) else starts, np.diff(np.append(starts, len(codes)))


def frequent_statistics(df: DataFrame, *text_cols: str, limit: int) -> DataFrame | None:
    """``(term, df, cf)`` of the ``limit`` most counted terms and ties, or None where words alone do not tell them.

    A bigram is counted at most as often as either word. So where words are counted first, all
    terms above the count of the ``limit``-th word consist of fewer than ``limit`` words, and
    only their terms are counted. None if fewer than ``limit`` terms lie above that count.
    """
    texts = df.select(*[term_words(F.col(c)).alias(c) for c in text_cols])
    lists = F.array(*[F.col(c) for c in text_cols])
    rows = texts.select(F.explode(lists).alias("words")).select(F.explode_outer("words").alias("term")).where("term is not null")
    words = cut(rows.groupBy("term").agg(F.count("*").alias("cf")))
    found = _cutoff(words, limit)
    floor = found["cf"] if (found["n"] or 0) > limit else 0
    kept = cut(words.where(F.col("cf") > floor).select("term", bounded_key(F.col("term")).alias("key")))
    keys = sorted(r["key"] for r in kept.select("key").collect())  # at most ``limit`` of a bounded length
    if not keys:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(keys, pa.string())
        for batch in batches:
            for column in batch.columns:
                for found in _coded_counts(column, listed):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["code", "df", "cf"])

    parts = texts.mapInArrow(run, "code long, df long, cf long")
    counts = cut(parts.groupBy("code").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("cf") > floor))
    found = _cutoff(counts, limit)
    if floor and (found["n"] or 0) < limit:
        return None
    top = counts.where(F.col("cf") >= found["cf"]) if found["cf"] is not None else counts
    numbered = df.sparkSession.createDataFrame(list(enumerate(keys)), "id long, key string")
    names = cut(kept.join(numbered, "key").select("id", "term"))
    first, second = (names.select(F.col("id").alias(f"_{s}"), F.col("term").alias(f"_{s}_word")) for s in "ab")
    pairs = top.withColumns({"_a": F.expr(f"code div {len(keys)} - 1"), "_b": F.expr(f"code % {len(keys)}")})
    named = pairs.join(second, "_b").join(first, "_a", "left")
    return named.select(F.concat_ws(" ", "_a_word", "_b_word").alias("term"), "df", "cf")


@dataclass
class TfidfModel:
    """Kept terms with counts and idf, and the lookup built from them.

    ``idf`` follows the index order of ``counter.vocabulary``.
    """

    table: DataFrame
    n_docs: int
    counter: CountVectorizerModel
    keys: list[str]
    idf: list[float]

    @cached_property
    def has_long_terms(self) -> bool:
        return any(k.startswith("#") for k in self.keys)

    def index(self) -> DataFrame:
        """``(term, term_index)`` for the positions in the sparse vectors."""
        numbered = self.table.sparkSession.createDataFrame(list(enumerate(self.keys)), "term_index int, key string")
        return self.table.join(numbered, "key").select("term", "term_index")

    def codes(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words of the kept terms by ``bounded_key``, every term's code out of them as in ``_coded``, and idf."""
        words = F.transform(F.split("term", " "), bounded_key)
        parts = {r["key"]: r["words"] for r in self.table.select("key", words.alias("words")).collect()}  # at most FEATURE_LIMIT
        listed = sorted({w for p in parts.values() for w in p})
        place = {w: i for i, w in enumerate(listed)}
        terms = [[place[w] for w in parts[k]] for k in self.keys]
        codes = [p[0] if len(p) == 1 else (p[0] + 1) * len(listed) + p[1] for p in terms]
        return listed, np.array(codes, np.int64), np.array(self.idf)

    def weights(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """Add count x idf of ``text_col`` as a sparse vector, unnormalised."""
        words, counts = f"{out_col}_terms", f"{out_col}_counts"
        tokens = terms(F.col(text_col))
        if self.has_long_terms:
            tokens = F.transform(tokens, bounded_key)
        counter = self.counter.copy({self.counter.inputCol: words, self.counter.outputCol: counts})
        scaler = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol=counts, outputCol=out_col)
        return scaler.transform(counter.transform(df.withColumn(words, tokens))).drop(words, counts)


def fit_tfidf(df: DataFrame, *text_cols: str, max_features: int = MAX_FEATURES) -> TfidfModel:
    """Keep the most counted terms (ties by term) with smooth idf plus one."""
    if not 0 < max_features <= FEATURE_LIMIT:
        raise ValueError(f"max_features must lie in 1..{FEATURE_LIMIT}: the vocabulary is sent to every executor")
    n_docs = df.count() * len(text_cols)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    statistics = frequent_statistics(df, *text_cols, limit=max_features)
    if statistics is None:
        statistics = term_statistics(df, *text_cols)
    kept = most_counted(statistics, max_features)
    return model_of(cut(kept.withColumns({"idf": idf, "key": bounded_key(F.col("term"))})), n_docs)


def model_of(table: DataFrame, n_docs: int) -> TfidfModel:
    """The model whose kept terms are in ``table``, fresh from fitting or read from a file."""
    rows = table.orderBy(F.col("cf").desc(), "term").select("key", "idf").collect()
    keys = [r["key"] for r in rows]
    return TfidfModel(table, n_docs, _counter(table.sparkSession, keys or [""]), keys, [r["idf"] for r in rows] or [0.0])


def _counter(spark: SparkSession, keys: list[str]) -> CountVectorizerModel:
    """``CountVectorizerModel.from_vocabulary`` with the keys sent as one text; sent one by one they take seconds."""
    array = spark.sparkContext._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(keys), -1)
    counter = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", array)
    return counter.setInputCol("key_list").setOutputCol("counts")


def pair_cosine(df: DataFrame, model: TfidfModel, left: str, right: str, out_col: str = "cos_sim") -> DataFrame:
    """Cosine of two text columns of the same row; 0 when a side has no known term."""
    both = unwrapped(model.weights(model.weights(df, left, "_left"), right, "_right"), "_left", "_right")
    left_v, right_v = F.col("_left"), F.col("_right")
    value = cosine_from(sparse_dot(left_v, right_v), sparse_norm(left_v), sparse_norm(right_v))
    return both.withColumn(out_col, value).drop("_left", "_right")


def tfidf_norm(df: DataFrame, model: TfidfModel, text_col: str, normalised: bool = False) -> DataFrame:
    """Length of the weight vector; ``normalised`` gives 1 (0 for no known term)."""
    out = unwrapped(model.weights(df, text_col, "_w"), "_w")
    length = sparse_norm(F.col("_w"))
    if normalised:
        length = F.when(length > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return out.withColumn("tfidf_norm", length).drop("_w")


def unit_weights(df: DataFrame, model: TfidfModel, text_col: str, id_col: str = "article_id") -> DataFrame:
    """``(id, term, weight)`` per known term of a text; the weights of a text have length 1."""
    w = unwrapped(model.weights(df.select(id_col, text_col), text_col, "_w"), "_w")
    rows = w.select(id_col, sparse_norm(F.col("_w")).alias("_n"), _entries(F.col("_w")).alias("_pairs"))
    known = rows.select(id_col, "_n", F.explode_outer("_pairs").alias("p")).where(F.col("p").isNotNull())
    scaled = known.select(id_col, F.col("p.i").alias("term_index"), (F.col("p.v") / F.col("_n")).alias("weight"))
    return scaled.join(model.index(), "term_index").select(id_col, "term", "weight")


def _entries(parts: Column) -> Column:
    """A sparse vector's parts as an array of (i, v)."""
    return F.arrays_zip(parts["indices"].alias("i"), parts["values"].alias("v"))


def centroid(df: DataFrame, model: TfidfModel, text_col: str) -> DataFrame:
    """Mean L2-normalised weight per known term that occurs: ``(term, term_index, mean_weight)``.

    Each task adds up its own rows in Arrow batches; at most one row per kept term and
    task is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.codes())
    n_rows = df.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes, idf = shared.value
        sums = np.zeros(len(idf))
        for batch in batches:
            for text, term, weight, n in _text_weights(batch.column(0), pa.array(keys, pa.string()), pa.array(codes), idf):
                length = np.sqrt(np.bincount(text, weight * weight, n))
                sums += np.bincount(term, weight / length[text], len(idf))
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["term_index", "total"])

    parts = df.select(term_words(F.col(text_col)).alias("words")).mapInArrow(run, "term_index long, total double")
    means = parts.groupBy(F.col("term_index").cast("int").alias("term_index")).agg((F.sum("total") / n_rows).alias("mean_weight"))
    return means.join(model.index(), "term_index").select("term", "term_index", "mean_weight")


def _text_weights(texts: pa.ListArray, keys: pa.Array, codes: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(text, term, weight, texts)``, whole texts at a time: count x idf of every kept term of a text."""
    for found, text, n in _coded(texts, keys):
        term = pc.fill_null(pc.index_in(pa.array(found), codes), -1).to_numpy().astype(np.int64)
        cells = np.sort(text[term >= 0] * len(idf) + term[term >= 0])
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        text, term = np.divmod(cells[starts], len(idf))
        yield text, term, np.diff(np.append(starts, len(cells))) * idf[term], n


def centroid_cosine(df: DataFrame, model: TfidfModel, mean: DataFrame, text_col: str, out_col: str = "cos_tfidf_mean") -> DataFrame:
    """Cosine of each text to a centroid; the centroid has one weight per kept term."""
    weights = [0.0] * len(model.keys)
    for row in mean.collect():
        weights[row["term_index"]] = row["mean_weight"]
    mean_norm = sum(x * x for x in weights) ** 0.5
    out = model.weights(df, text_col, "_w")
    out = unwrapped(ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_w", outputCol="_wm").transform(out), "_w", "_wm")
    value = cosine_from(sparse_sum(F.col("_wm")), sparse_norm(F.col("_w")), F.lit(mean_norm))
    return out.withColumn(out_col, value).drop("_w", "_wm")
