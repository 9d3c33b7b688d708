"""The operators as queries over the test tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presslens.functions import scoring
from presslens.functions.text import (
    basic_clean, clean_text, join_text, lower_space_tokens, space_tokens, term_words, with_bigrams, word_tokens,
)
from presslens.functions.vector import cosine, norm
from presslens.operators import metrics, profile, sequences, spectral, splits, tfidf, vocabulary, wordvectors
from presslens.operators.ordered import ranked_within
from presslens.plans import classify, missions
from presslens.session import cut, scratch_path, spread
from presslens.sources import articles as art
from presslens.sources.csv import load_articles as load_files, read_csv, read_csv_detected
from presslens.sources.sinks import load_or_train, write_csv, write_metrics

DIM = 64
LATIN = "abcdefghijklmnopqrstuvwxyz"
HANGUL = "가나다라마바사아자차카타파하거너더러머버서어저처커터"


def r6(col: Column) -> Column:
    """Six decimals; adding zero turns -0.0 into 0.0."""
    return F.round(col, 6) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- inputs derived from the tables ----


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """All documents: the first line is the title, the rest the content ('' where there is no other line)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rest = F.substr(F.col("text"), F.instr("text", "\n") + 1)
    return spread(docs).select(
        F.col("doc_id").alias("article_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("text").contains("\n"), rest).otherwise("").alias("content"),
    )


def with_labels(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"), (1 - F.col("quality")).alias("label"))
    return df.join(labels, "article_id", "left")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return with_labels(articles(spark, sf), spark, sf)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    prob = F.round((F.col("n_chars") % 50) / F.lit(50.0), 2)
    joined = table(spark, sf, "labels").join(docs, "doc_id")
    return joined.select("doc_id", (1 - F.col("quality")).alias("y"), prob.alias("prob")).withColumn(
        "pred", scoring.decide_threshold(F.col("prob"))
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    steps = ranked_within(events, "event_type", [F.col("ts"), F.col("event_id")], "step")
    return steps.select("step", F.lit("validation").alias("split"), F.col("event_type").alias("metric"), "value")


def full_text(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", word_tokens(join_text(F.col("title"), F.col("content"))))


def cleaned_lower(df: DataFrame) -> DataFrame:
    cleaned = art.cleaned_articles(df)
    return cleaned.select("article_id", lower_space_tokens(F.col("text")).alias("tokens"))


def text_vocabulary(df: DataFrame, **options) -> DataFrame:
    """Built once per query: ranks come from one written pass."""
    return cut(vocabulary.frequency_vocabulary(full_text(df), "tokens", **options))


def word_vectors(spark: SparkSession, sf: str, vocab: DataFrame) -> DataFrame:
    """The embeddings handed to the most frequent tokens in order."""
    vectors = table(spark, sf, "embeddings").select((F.col("vec_id") + 2).alias("id"), F.col("embedding").alias("vec"))
    return vocab.join(vectors, "id").select("token", "vec")


def korean(df: DataFrame) -> DataFrame:
    """Articles respelled in Hangul, so that every byte pattern of a legacy file occurs."""

    def respell(name: str) -> Column:
        return F.regexp_replace(F.translate(F.lower(name), LATIN, HANGUL), r'[^가-힣0-9 \n,."]', "")

    return df.select("article_id", respell("title").alias("title"), respell("content").alias("content"))


def joined_ids(col: str) -> Column:
    return F.array_join(F.col(col).cast("array<string>"), " ")


# ---- text and preparation ----


def clean_pages(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", clean_text(F.col("html")).alias("clean_text"))


def article_text(spark, sf):
    a = articles(spark, sf)
    return a.select("article_id", basic_clean(F.col("title")).alias("title"), join_text(F.col("title"), F.col("content")).alias("text"))


def clean_articles(spark, sf):
    return art.cleaned_articles(articles(spark, sf)).select("article_id", "title", "text")


def normalised_articles(spark, sf):
    raw = labelled(spark, sf).select(
        "article_id", F.col("title").alias(" 뉴스제목 "), F.col("content").alias("본문 "),
        F.col("label").cast("string").alias("가짜뉴스여부"),
    )
    named = art.require_columns(art.normalise_headers(raw), "title", "content", "label")
    return art.apply_null_policy(named, "fill").select("article_id", "title", "content", "label")


def unlabelled_articles(spark, sf):
    return art.unlabelled(articles(spark, sf)).select("article_id", "label")


def head_preview(spark, sf):
    return profile.head(articles(spark, sf)).select("article_id", "title")


def documents_with_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


def drop_nulls(spark, sf):
    return art.apply_null_policy(documents_with_labels(spark, sf), "drop_any")


def drop_required(spark, sf):
    return art.apply_null_policy(labelled(spark, sf), "drop_required").select("article_id", "label")


def label_domain(spark, sf):
    sums = documents_with_labels(spark, sf).select((F.col("quality") + F.col("toxic")).alias("label"))
    return profile.label_domain(sums)


def null_rates(spark, sf):
    rates = profile.null_rates(labelled(spark, sf), "title", "content", "label")
    return rates.select(*[r6(F.col(c)).alias(c) for c in rates.columns])


def table_shape(spark, sf):
    return profile.shape(table(spark, sf, "documents"))


def duplicates(spark, sf):
    return profile.duplicates(articles(spark, sf), "title", "content")


# ---- TF-IDF ----


def _cosine(spark, sf, keep_title: bool = False) -> DataFrame:
    a = articles(spark, sf)
    model = tfidf.fit_tfidf(a, "title", "content")
    keep = ["article_id", "title"] if keep_title else ["article_id"]
    return tfidf.pair_cosine(a, model, "title", "content").select(*keep, "cos_sim")


def tfidf_terms(spark, sf):
    model = tfidf.fit_tfidf(articles(spark, sf), "title", "content")
    return model.table.select("term", "df", "cf", r6(F.col("idf")).alias("idf"))


def title_content_cosine(spark, sf):
    return _cosine(spark, sf).select("article_id", r6(F.col("cos_sim")).alias("cos_sim"))


def cosine_topk(spark, sf):
    c = _cosine(spark, sf, keep_title=True).withColumn("cos_sim", r6(F.col("cos_sim")))
    return profile.top_k(c, "cos_sim", 10)


def cosine_bottomk(spark, sf):
    c = _cosine(spark, sf, keep_title=True).withColumn("cos_sim", r6(F.col("cos_sim")))
    return profile.top_k(c, "cos_sim", 10, lowest=True)


def cosine_describe(spark, sf):
    d = profile.describe(cut(_cosine(spark, sf)), "cos_sim")
    return d.select("count", *[r6(F.col(c)).alias(c) for c in d.columns if c != "count"])


def cosine_hist(spark, sf):
    h = profile.histogram(cut(_cosine(spark, sf)), "cos_sim", 50)
    return h.withColumn("bin_start", r6(F.col("bin_start")))


def cosine_hist_by_label(spark, sf):
    h = profile.histogram(cut(with_labels(_cosine(spark, sf), spark, sf)), "cos_sim", 50, by="label")
    return h.withColumn("bin_start", r6(F.col("bin_start")))


def cosine_by_label(spark, sf):
    m = profile.mean_by_label(with_labels(_cosine(spark, sf), spark, sf), "cos_sim")
    return m.withColumn("mean_cos_sim", r6(F.col("mean_cos_sim")))


def cosine_kde(spark, sf):
    d = profile.density(cut(with_labels(_cosine(spark, sf), spark, sf)), "cos_sim", by="label")
    return d.select("label", "point", r6(F.col("x")).alias("x"), r6(F.col("density")).alias("density"))


def cosine_kde_overall(spark, sf):
    d = profile.density(cut(_cosine(spark, sf)), "cos_sim", cut=0.0)
    return d.select("point", r6(F.col("x")).alias("x"), r6(F.col("density")).alias("density"))


def centroid_terms(spark, sf):
    a = articles(spark, sf)
    model = tfidf.fit_tfidf(a, "content")
    return tfidf.centroid(a, model, "content").select("term", r6(F.col("mean_weight")).alias("mean_weight"))


def centroid_cosine(spark, sf):
    a = articles(spark, sf)
    model = tfidf.fit_tfidf(a, "content")
    out = tfidf.centroid_cosine(a, model, tfidf.centroid(a, model, "content"), "content")
    return out.select("article_id", r6(F.col("cos_tfidf_mean")).alias("cos_tfidf_mean"))


def tfidf_weights(spark, sf):
    a = articles(spark, sf)
    out = tfidf.unit_weights(a, tfidf.fit_tfidf(a, "content"), "content")
    return out.select("article_id", "term", r6(F.col("weight")).alias("weight"))


def tfidf_norm(spark, sf):
    a = articles(spark, sf)
    out = tfidf.tfidf_norm(a, tfidf.fit_tfidf(a, "content"), "content")
    return out.select("article_id", r6(F.col("tfidf_norm")).alias("tfidf_norm"))


def stacked_texts(spark, sf):
    s = tfidf.stacked(articles(spark, sf), "title", "content")
    return s.groupBy("side").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# ---- tokens, vocabularies, sequences ----


def _token_digest(df: DataFrame, tokens: Column) -> DataFrame:
    t = df.select("article_id", tokens.alias("tokens"))
    return t.select("article_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", "|")).alias("digest"))


def both_texts() -> Column:
    return F.concat_ws(" ", "title", "content")


def tok_words(spark, sf):
    return _token_digest(articles(spark, sf), word_tokens(both_texts()))


def tok_space(spark, sf):
    return _token_digest(articles(spark, sf), space_tokens(both_texts()))


def tok_terms(spark, sf):
    return _token_digest(articles(spark, sf), with_bigrams(term_words(both_texts())))


def token_counts(spark, sf):
    return vocabulary.token_counts(full_text(articles(spark, sf)), "tokens")


def vocab_freq(spark, sf):
    return vocabulary.frequency_vocabulary(full_text(articles(spark, sf)), "tokens")


def vocab_capped(spark, sf):
    return vocabulary.capped_vocabulary(cleaned_lower(articles(spark, sf)), "article_id", "tokens")


def ids_head256(spark, sf):
    a = articles(spark, sf)
    ids = sequences.numericalize(full_text(a), "article_id", "tokens", text_vocabulary(a), 256)
    return ids.select("article_id", joined_ids("ids").alias("ids"))


def ids_tail500(spark, sf):
    texts = cleaned_lower(articles(spark, sf))
    vocab = cut(vocabulary.capped_vocabulary(texts, "article_id", "tokens"))
    ids = sequences.numericalize(
        texts, "article_id", "tokens", vocab, 500, truncate="tail", num_words=vocabulary.NUM_WORDS
    )
    return ids.select("article_id", joined_ids("ids").alias("ids"))


def pair_ids(spark, sf):
    a = articles(spark, sf)
    special = (vocabulary.PAD, vocabulary.UNKNOWN, vocabulary.CLS, vocabulary.SEP)
    sides = a.select("article_id", word_tokens(F.col("title")).alias("t"), word_tokens(F.col("content")).alias("c"))
    pairs = sequences.pair_sequences(sides, "article_id", "t", "c", text_vocabulary(a, specials=special))
    return pairs.select("article_id", *[joined_ids(c).alias(c) for c in ("ids", "mask", "segments")])


# ---- vectors ----


def _vector_summary(*keys: str) -> list:
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return [
        *keys, r6(F.get("vec", F.lit(0))).alias("v_first"), r6(F.get("vec", F.lit(DIM - 1))).alias("v_last"),
        r6(total).alias("v_sum"), r6(norm(F.col("vec"))).alias("v_norm"),
    ]


def embedding_matrix(spark, sf):
    vocab = text_vocabulary(articles(spark, sf))
    m = vocabulary.embedding_matrix(vocab, word_vectors(spark, sf, vocab), DIM)
    return m.select(*_vector_summary("id", "token"))


def in_vocabulary_tokens(spark, sf):
    a = full_text(articles(spark, sf))
    vectors = cut(word_vectors(spark, sf, text_vocabulary(articles(spark, sf))))
    from presslens.operators.lookup import lookup

    kept = lookup(vocabulary.exploded(a, "tokens", "article_id"), "token", vectors.select("token"), payload_bytes=0)
    return kept.groupBy("article_id").agg(F.count("*").alias("n_known"))


def _sentence_vectors(spark, sf, *sides: str) -> DataFrame:
    a = articles(spark, sf)
    vectors = cut(word_vectors(spark, sf, text_vocabulary(a)))
    tokens = a.select("article_id", *[word_tokens(F.col(s)).alias(s) for s in sides])
    return wordvectors.sentence_vectors(tokens, "article_id", {f"{s}_vec": s for s in sides}, vectors, DIM)


def sentence_vec(spark, sf):
    v = _sentence_vectors(spark, sf, "content")
    return v.select("article_id", F.posexplode("content_vec").alias("dim", "v")).withColumn("v", r6(F.col("v")))


def sentence_cosine(spark, sf):
    v = _sentence_vectors(spark, sf, "title", "content")
    c = wordvectors.pair_vector_cosine(v, "title_vec", "content_vec", "cos_sim")
    return c.select("article_id", r6(F.col("cos_sim")).alias("cos_sim"))


def mean_vec_cosine(spark, sf):
    v = _sentence_vectors(spark, sf, "content")
    c = wordvectors.cosine_to_mean(v, "content_vec", DIM, "cos_vec_mean")
    return c.select("article_id", r6(F.col("cos_vec_mean")).alias("cos_vec_mean"))


def mean_sentence_vec(spark, sf):
    m = wordvectors.mean_vector(_sentence_vectors(spark, sf, "content"), "content_vec", DIM)
    return m.select(F.posexplode("mean_vec").alias("dim", "v")).withColumn("v", r6(F.col("v")))


def oov_backoff(spark, sf):
    vocab = text_vocabulary(articles(spark, sf))
    vectors = cut(word_vectors(spark, sf, vocab))
    rare = cut(vocab.where(F.col("id") > 1).select("token").join(vectors, "token", "left_anti"))
    return wordvectors.backoff_vectors(rare, vectors, DIM).select(*_vector_summary("token", "grams"))


def pair_embedding_cosine(spark, sf):
    p = embedding_pairs(spark, sf)
    return p.select("article_id", r6(cosine(F.col("title_vec"), F.col("content_vec"))).alias("cos_sim"))


def embedding_pairs(spark, sf):
    """Neighbouring embeddings as title and content; fake when their classes differ."""
    e = table(spark, sf, "embeddings")
    left = e.select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("title_vec"), F.col("label").alias("tl"))
    right = e.select((F.col("vec_id") - 1).alias("article_id"), F.col("embedding").alias("content_vec"), F.col("label").alias("cl"))
    both = left.join(right, "article_id")
    return both.select("article_id", "title_vec", "content_vec", (F.col("tl") != F.col("cl")).cast("int").alias("label"))


# ---- labels, splits, scores ----


def label_rows(spark, sf):
    return table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))


def class_weights(spark, sf):
    return splits.class_weights(label_rows(spark, sf)).withColumn("weight", r6(F.col("weight")))


def split_hash(spark, sf):
    return splits.hash_split(label_rows(spark, sf), "doc_id")


def split_quota(spark, sf):
    return splits.quota_split(label_rows(spark, sf), "doc_id").select("doc_id", "label", "holdout")


def split_tail(spark, sf):
    return splits.tail_split(label_rows(spark, sf), "doc_id")


def one_hot(spark, sf):
    hot = label_rows(spark, sf).select("doc_id", scoring.one_hot(F.col("label")).alias("hot"))
    return hot.select("doc_id", F.col("hot")[0].alias("y0"), F.col("hot")[1].alias("y1"))


def _logits(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id").withColumn("size", F.col("n_chars") / F.lit(1000.0))
    logit = scoring.linear_score({"size": 0.25, "toxic": -0.75}, -0.5)
    return rows.select("doc_id", logit.alias("logit1"), (-logit).alias("logit0"))


def softmax_score(spark, sf):
    p = scoring.softmax_positive(F.col("logit0"), F.col("logit1"))
    return _logits(spark, sf).select("doc_id", r6(p).alias("prob"))


def decide(spark, sf):
    p = scoring.softmax_positive(F.col("logit0"), F.col("logit1"))
    return _logits(spark, sf).select(
        "doc_id", scoring.decide_argmax(F.col("logit0"), F.col("logit1")).alias("by_argmax"),
        scoring.decide_threshold(p).alias("by_threshold"),
    )


def predicted_fake(spark, sf):
    found = predictions(spark, sf).where(F.col("pred") == 1).withColumnRenamed("doc_id", "article_id")
    return articles(spark, sf).join(found, "article_id").select("article_id", "title", "prob", "pred")


# ---- metrics ----


def confusion(spark, sf):
    return metrics.confusion(predictions(spark, sf))


def accuracy(spark, sf):
    return metrics.accuracy(predictions(spark, sf)).select(r6(F.col("accuracy")).alias("accuracy"))


def prf(spark, sf):
    m = metrics.precision_recall_f1(predictions(spark, sf))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


def class_report(spark, sf):
    m = metrics.class_report(predictions(spark, sf))
    return m.select("class", "support", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def auroc(spark, sf):
    return metrics.auroc(predictions(spark, sf)).select(r6(F.col("auroc")).alias("auroc"))


def roc_curve(spark, sf):
    return metrics.roc_curve(predictions(spark, sf)).select("threshold", r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


def pr_curve(spark, sf):
    return metrics.pr_curve(predictions(spark, sf)).select(
        "threshold", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall")
    )


def log_loss(spark, sf):
    return metrics.log_loss(predictions(spark, sf)).select(r6(F.col("log_loss")).alias("log_loss"))


def pearson(spark, sf):
    return metrics.pearson(predictions(spark, sf)).select(r6(F.col("pearson_r")).alias("pearson_r"))


def best_step(spark, sf):
    return metrics.best_steps(history(spark, sf)).withColumn("value", r6(F.col("value")))


def clipped_history(spark, sf):
    h = history(spark, sf)
    return h.select("metric", "step", r6(scoring.clip_unit(F.col("value") / 100)).alias("clipped_loss"))


# ---- files ----


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "articles.csv")
    write_csv(labelled(spark, sf), path)
    back = read_csv(spark, path, schema=art.ARTICLE_SCHEMA, na_strings=("",))
    return back.fillna("", ["title", "content"]).select("article_id", "title", "content", "label")


def csv_by_name(spark, sf):
    """Columns in another order than the schema's, under Korean headers."""
    path = scratch_path(spark, "by_name.csv")
    rows = labelled(spark, sf).select(
        F.col("label").alias("가짜뉴스여부"), F.col("content").alias("본문"), "article_id", F.col("title").alias("뉴스제목"),
    )
    write_csv(rows, path)
    back = read_csv(spark, path, schema=art.ARTICLE_SCHEMA, na_strings=("",))
    return back.fillna("", ["title", "content"]).select("article_id", "title", "content", "label")


def load_articles(spark, sf):
    """Files without ids in two encodings, with headers of two languages and orders."""
    base = scratch_path(spark, "loaded")
    rows = labelled(spark, sf)
    write_csv(rows.where("article_id % 2 = 0").select("label", "content", "title"), f"{base}/a")
    other = korean(rows.where("article_id % 2 = 1")).select(F.col("title").alias("뉴스제목"), F.col("content").alias("본문"))
    write_csv(other, f"{base}/b", "EUC-KR")
    back = load_files(spark, [f"{base}/{d}" for d in "ab"], na_strings=("",))
    ids = back.agg(F.countDistinct("article_id").alias("ids"))
    return back.select("title", "content", "label", ids.scalar().alias("ids"))


def legacy_csv(spark, sf):
    path = scratch_path(spark, "legacy.csv")
    write_csv(korean(articles(spark, sf)), path, "EUC-KR")
    back = read_csv(spark, path, "euc-kr", na_strings=("",)).fillna("")
    return back.select(F.col("article_id").cast("bigint").alias("article_id"), "title", "content")


def encoding_scan(spark, sf):
    base = scratch_path(spark, "mixed")
    rows = cut(korean(articles(spark, sf)))
    # 햏 exists in cp949 only, so files holding it cannot pass for EUC-KR.
    third = F.col("article_id") % 3
    write_csv(rows.where(third == 0), f"{base}/a", "UTF-8")
    write_csv(rows.where(third == 1), f"{base}/b", "EUC-KR")
    write_csv(rows.where(third == 2).withColumn("title", F.concat(F.lit("햏"), "title")), f"{base}/c", "x-windows-949")
    back = read_csv_detected(spark, [f"{base}/{d}" for d in "abc"]).fillna("", ["title", "content"])
    return back.select(F.col("article_id").cast("bigint").alias("article_id"), "title", "content", "encoding")


def export_predictions(spark, sf):
    path = scratch_path(spark, "predictions.csv")
    found = predictions(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    write_csv(found.select("doc_id", "content", "pred", "prob"), path)
    back = spark.read.schema("doc_id bigint, content string, pred int, prob double").option("header", True)
    return back.option("multiLine", True).option("escape", '"').csv(path).fillna("", ["content"])


def export_metrics(spark, sf):
    path = scratch_path(spark, "metrics.json")
    write_metrics(metrics.evaluate(predictions(spark, sf)), path)
    names = ("Accuracy", "Precision", "Recall", "F1", "ROC-AUC", "AUROC")
    back = spark.read.schema(", ".join(f"`{n}` double" for n in names)).json(path)
    return back.select(*[r6(F.col(f"`{n}`")).alias(n) for n in names])


# ---- trained models (no SQL twin) ----


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nine tenths to train on, one tenth to score."""
    split = splits.hash_split(df, "article_id", seed=7)
    return split.where("holdout = 0").drop("holdout"), split.where("holdout = 1").drop("holdout")


def _scored(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("article_id", *[r6(F.col(c)).alias(c) for c in (*extra, "prob")], "pred")


def ngram_clf(spark, sf):
    train, test = halves(labelled(spark, sf))
    return _scored(missions.headline_study(train, test).scored, "cos_sim")


def context_clf(spark, sf):
    train, test = halves(labelled(spark, sf))
    return _scored(missions.context_study(train, test.drop("label")).scored, *missions.CONTEXT_FEATURES)


def vector_clf(spark, sf):
    train, test = halves(labelled(spark, sf))
    return _scored(missions.word_vector_study(train, test).scored, "cosine_similarity")


def embedding_clf(spark, sf):
    train, test = halves(embedding_pairs(spark, sf))
    return _scored(missions.embedding_study(train, test, "title_vec", "content_vec").scored, "cos_sim_embedding")


def w2v_cosine(spark, sf):
    rows = articles(spark, sf)
    (out,) = missions.word_vector_features(rows, rows)
    return out.select("article_id", r6(F.col("cosine_similarity")).alias("cosine_similarity"))


def subword_vec(spark, sf):
    v = wordvectors.subword_vectors(full_text(articles(spark, sf)), "tokens", dim=100)
    return v.select("token", r6(norm(F.col("vec"))).alias("v_norm"))


def _text_pairs(spark, sf):
    """The words of all texts seen twice or more with their hashes, and how often any two of them stand within five words."""
    words, pairs = spectral.hashed_pairs(full_text(articles(spark, sf)).select("tokens"), "tokens")
    return words.select("token", "word"), spectral.both_ways(pairs)


def _named(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` by hash with the words themselves."""
    return words.join(rows.withColumnRenamed("token", "word"), "word").drop("word")


def cooccurrence(spark, sf):
    words, counts = _text_pairs(spark, sf)
    found = counts.groupBy("token").agg(
        F.count("*").alias("n_contexts"), F.sum("n").alias("n_pairs"), F.max("n").alias("most"),
        F.sum(F.when(F.col("token") == F.col("context"), F.col("n")).otherwise(0)).alias("n_self"),
    )
    return _named(found, words)


def ppmi_weights(spark, sf):
    words, counts = _text_pairs(spark, sf)
    kept = spectral.positive_pmi(counts, shift=2.0)
    return _named(kept.groupBy("token").agg(F.count("*").alias("n_positive"), F.round(F.sum("w"), 4).alias("weight")), words)


def spectral_vec(spark, sf):
    """One row: words with a vector, vectors of a wrong length, and pairs of columns that are not at right angles."""
    dim = 32
    df = cut(full_text(articles(spark, sf)).select("tokens"))
    v = cut(spectral.spectral_vectors(df, "tokens", dim=dim))
    gram = cut(spectral.column_products(v, dim))  # dim x dim cells
    own = gram.where("i = j").select("i", F.col("g").alias("own"))
    # columns are scaled by the root of their value: the diagonal falls, all else is zero
    wrong = gram.join(F.broadcast(own), "i").agg(F.count_if((F.col("i") < F.col("j")) & ~(F.abs("g") <= 1e-6 * F.col("own"))).alias("not_square"))
    sizes = v.agg(F.count("*").alias("n_words"), F.count_if(F.size("vec") != dim).alias("wrong_length"))
    return sizes.withColumn("not_square", wrong.scalar())


def metric_history(spark, sf):
    pairs = embedding_pairs(spark, sf)
    h = missions.embedding_study(pairs, pairs, "title_vec", "content_vec").history
    return h.select("step", "split", "metric", r6(F.col("value")).alias("value"))


def model_reload(spark, sf):
    pairs = classify.dense_features(embedding_pairs(spark, sf), "title_vec")
    path = scratch_path(spark, "model")
    load_or_train(path, lambda: classify.dense_pipeline().fit(pairs))

    def no_training():
        raise AssertionError("the saved model was not found")

    return _scored(classify.score(load_or_train(path, no_training), pairs, "article_id"))


def _reloaded(spark, study, test, id_col="article_id"):
    """One row: scored rows, probabilities outside [0, 1], decisions against the threshold, scores that a saved copy gives otherwise."""
    path = scratch_path(spark, "study")
    study.save(path)
    again = missions.load_study(spark, path).score(test, id_col).select(id_col, F.col("prob").alias("again"))
    both = study.scored.select(id_col, "prob", "pred").join(again, id_col, "full")
    return both.agg(
        F.count("*").alias("n_scored"), F.count_if(~F.col("prob").between(0, 1)).alias("outside"),
        F.count_if((F.col("prob") >= 0.5).cast("int") != F.col("pred")).alias("undecided"),
        F.count_if(F.coalesce(F.abs(F.col("prob") - F.col("again")) > 1e-9, F.lit(True))).alias("changed"),
    )


def study_reload(spark, sf):
    train, test = halves(labelled(spark, sf))
    return _reloaded(spark, missions.headline_study(train, test), test)


def context_reload(spark, sf):
    train, test = halves(labelled(spark, sf))
    test = test.drop("label")
    return _reloaded(spark, missions.context_study(train, test), test)


def vector_reload(spark, sf):
    train, test = halves(labelled(spark, sf))
    return _reloaded(spark, missions.word_vector_study(train, test), test)


def embedding_reload(spark, sf):
    train, test = halves(embedding_pairs(spark, sf))
    return _reloaded(spark, missions.embedding_study(train, test, "title_vec", "content_vec"), test)


def epoch_history(spark, sf):
    """What must hold of the history by epochs, per metric: its epochs, splits, values out of range, and the kept one's rank.

    The learner sees the presence of single words, which ends sooner than the studies' n-grams.
    """
    rows = cut(full_text(labelled(spark, sf)).where("label is not null").select("article_id", "label", "tokens"))
    split = cut(splits.quota_split(rows, "article_id"))
    learner = classify.ngram_pipeline("tokens", sizes=(1,))
    model, history = classify.fit_best(split.where("holdout = 0"), split.where("holdout = 1"), [lambda: learner])
    kept = model.stages[-1].best_epoch
    epochs = cut(history.where(F.col("metric").isin("loss_1", "accuracy_1")))
    best = metrics.best_steps(epochs.where("metric = 'accuracy_1'")).select("metric", (F.col("step") == kept).cast("int").alias("best_kept"))
    value = F.col("value")
    wrong = ~value.between(0, F.when(F.col("metric") == "accuracy_1", 1.0).otherwise(float("inf")))
    found = epochs.groupBy("metric").agg(
        F.countDistinct("step").alias("epochs"), F.countDistinct("split").alias("splits"), F.count("*").alias("n_values"), F.count_if(wrong).alias("wrong"),
    )
    return found.join(best, "metric", "left").withColumn("best_kept", F.coalesce("best_kept", F.lit(1)))


QUERIES = {
    f.__name__: f
    for f in (
        clean_pages, article_text, clean_articles, normalised_articles, unlabelled_articles, head_preview, drop_nulls,
        drop_required, label_domain, null_rates, table_shape, duplicates, tfidf_terms, title_content_cosine, cosine_topk,
        cosine_bottomk, cosine_describe, cosine_hist, cosine_hist_by_label, cosine_by_label, cosine_kde,
        cosine_kde_overall, centroid_terms, centroid_cosine, tfidf_norm, tfidf_weights, stacked_texts, tok_words, tok_space, tok_terms,
        token_counts, vocab_freq, vocab_capped, ids_head256, ids_tail500, pair_ids, embedding_matrix,
        in_vocabulary_tokens, sentence_vec, sentence_cosine, mean_vec_cosine, mean_sentence_vec, oov_backoff,
        pair_embedding_cosine, class_weights, split_hash, split_quota, split_tail, one_hot, softmax_score, decide,
        predicted_fake, confusion, accuracy, prf, class_report, auroc, roc_curve, pr_curve, log_loss, pearson, best_step,
        clipped_history, csv_roundtrip, csv_by_name, load_articles,
        legacy_csv, encoding_scan, export_predictions, export_metrics, ngram_clf,
        context_clf, vector_clf, embedding_clf, w2v_cosine, subword_vec, metric_history, model_reload,
        study_reload, context_reload, vector_reload, embedding_reload, epoch_history,
        cooccurrence, ppmi_weights, spectral_vec,
    )
}
