import random

import pytest
from pyspark.sql import functions as F

from presslens.operators import tfidf
from presslens.plans import classify, missions
from presslens.streaming import score_headlines

TOPICS = (["river", "boat", "fish", "water", "shore"], ["vote", "party", "law", "mayor", "seat"])


def article(i, rng):
    """Label 1 when the body is about another topic and holds a planted phrase."""
    label, topic = i % 2, rng.randint(0, 1)
    title = " ".join(rng.choices(TOPICS[topic], k=4))
    body = rng.choices(TOPICS[topic if label == 0 else 1 - topic], k=15)
    return i, title, " ".join(body + (["truth", "they", "hide"] if label else ["as", "reported", "today"])), label


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(5)
    rows = [article(i, rng) for i in range(240)]
    return spark.createDataFrame(rows, "article_id bigint, title string, content string, label int").repartition(4, "article_id").cache()


def test_headline_study_separates_planted_articles(articles):
    study = missions.headline_study(articles.where("article_id < 200"), articles.where("article_id >= 200"), regs=(0.01,), width=64)
    m = study.metrics().first()
    assert m["AUROC"] > 0.95 and m["Accuracy"] > 0.9
    names = {(r.split, r.metric) for r in study.history.select("split", "metric").distinct().collect()}
    assert {("validation", "accuracy"), ("validation", "auroc"), ("train", "loss"), ("train", "loss_1")} <= names


def test_context_study_scores_unlabelled_articles(articles):
    test = articles.where("article_id >= 200").drop("label")
    study = missions.context_study(articles.where("article_id < 200"), test, regs=(0.01,), width=64, dim=8, partitions=2)
    rows = study.scored.join(articles.select("article_id", "label"), "article_id").collect()
    assert len(rows) == 40 and all(-1.0001 <= r[c] <= 1.0001 for r in rows for c in ("cos_tfidf_mean", "cos_vec_mean"))
    assert sum(r.pred == r.label for r in rows) > 36


def test_word_vector_study(articles):
    study = missions.word_vector_study(articles, articles, regs=(0.01,), dim=8, window=3, partitions=1)
    rows = study.scored.collect()
    assert len(rows) == 240 and all(0 <= r.prob <= 1 and -1.0001 <= r.cosine_similarity <= 1.0001 for r in rows)


def test_embedding_study_and_other_estimators(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        a = [rng.gauss(0, 1) for _ in range(4)]
        same = i % 2 == 0
        rows.append((i, a, [x if same else -x for x in a], int(not same)))
    df = spark.createDataFrame(rows, "article_id bigint, t array<double>, c array<double>, label int")
    study = missions.embedding_study(df, df, "t", "c", regs=(0.01,))
    assert study.metrics().first()["AUROC"] > 0.95
    dense = classify.dense_features(df.withColumn("w", F.lit(1.0)), "t")
    for estimator in (classify.perceptron(4, 3), classify.boosted(weight_col="w")):
        model = classify.dense_pipeline(estimator=estimator).fit(dense)
        assert classify.predictions(model, dense).where("prob between 0 and 1").count() == 120


def test_first_candidate_wins_ties(articles):
    train = articles.withColumn("tokens", F.split("content", " "))
    same = [lambda: classify.ngram_pipeline("tokens", width=32)] * 2
    model, history = classify.fit_best(train, train, same, "accuracy")
    values = [r.value for r in history.where("metric = 'accuracy' and split = 'validation'").orderBy("step").collect()]
    assert values[0] == values[1] and model.stages[-1].coefficients is not None


def test_streaming_scores_equal_batch_scores(spark, articles, tmp_path):
    model = tfidf.fit_tfidf(articles, "title", "content")
    (train,) = missions.headline_features(articles, articles)
    classifier = classify.ngram_pipeline("tokens", ("cos_sim",), width=32).fit(train)
    source = articles.drop("label")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = (
        score_headlines(stream, model, classifier).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(60)
    want = {r.article_id: r for r in score_headlines(source, model, classifier).collect()}
    got = {r.article_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and len(got) == 240


def test_word_vector_means_count_known_words_and_labels_stay_null(spark, articles):
    from pyspark.ml.functions import vector_to_array

    train = articles.where("article_id < 100")
    test = spark.createDataFrame([(1, "river unseen unknown", "boat x y z", None), (2, "river", "boat", None)], "article_id bigint, title string, content string, label int")
    train_f, test_f = missions.word_vector_features(train, train, test, dim=8, window=3, partitions=1)
    a, b = test_f.select("article_id", "label", vector_to_array("dense").alias("v"), "cosine_similarity").orderBy("article_id").collect()
    assert a.v == pytest.approx(b.v) and a.label is None and any(a.v)
    half = train.withColumn("label", F.when(F.col("article_id") % 3 > 0, F.col("label")))
    study = missions.word_vector_study(half, test.drop("label"), regs=(0.01,), dim=8, window=3, partitions=1)
    assert study.scored.count() == 2


def test_context_vectors_back_off_for_test_tokens(spark, articles):
    train = articles.where("article_id < 100")
    test = spark.createDataFrame([(1, "t", "rivers boating mayors")], "article_id bigint, title string, content string")
    _, test_f = missions.context_features(train, train, test, dim=8, partitions=1)
    assert test_f.first()["cos_vec_mean"] != 0


def test_trained_queries_take_the_library_defaults(monkeypatch):
    from presslens.plans import queries

    asked = []

    class Stop(Exception):
        pass

    def seen(*args, **options):
        asked.append(set(options) & {"width", "iterations"})
        raise Stop

    for module, name in [(missions, "headline_study"), (missions, "context_study"), (missions, "word_vector_study"), (missions, "word_vector_features"), (queries.wordvectors, "subword_vectors")]:
        monkeypatch.setattr(module, name, seen)
    for name in ("articles", "labelled", "full_text"):
        monkeypatch.setattr(queries, name, lambda *args: None)

    class Rows:
        def drop(self, *names):
            return self

    monkeypatch.setattr(queries, "halves", lambda rows: (Rows(), Rows()))
    for name in ("ngram_clf", "context_clf", "vector_clf", "w2v_cosine", "subword_vec"):
        with pytest.raises(Stop):
            queries.QUERIES[name](None, None)
    assert asked == [set()] * 5
