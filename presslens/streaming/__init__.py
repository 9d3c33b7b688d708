"""Scoring articles as they arrive, with operators fitted beforehand."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from presslens.functions.text import join_text, word_tokens
from presslens.operators.tfidf import TfidfModel, pair_cosine
from presslens.plans.classify import score


def score_headlines(articles: DataFrame, tfidf: TfidfModel, model: PipelineModel) -> DataFrame:
    """``(article_id, cos_sim, prob, pred)`` for a streaming (or static) article table.

    Every step is a map over rows: no state, no shuffle, no action.
    """
    tokens = word_tokens(join_text(F.col("title"), F.col("content")))
    featured = pair_cosine(articles, tfidf, "title", "content").withColumn("tokens", tokens)
    return score(model, featured, "article_id", "cos_sim")
