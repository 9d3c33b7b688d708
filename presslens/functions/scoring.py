"""Scores and decisions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    """Probability of class 1 out of two logits."""
    return 1.0 / (1.0 + F.exp(logit0 - logit1))


def decide_argmax(logit0: Column, logit1: Column) -> Column:
    """1 if class 1 scores higher; a tie is 0."""
    return F.when(logit1 > logit0, 1).otherwise(0)


def decide_threshold(prob: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold on; a tie is 1."""
    return (prob >= threshold).cast("int")


def one_hot(label: Column) -> Column:
    return F.array(1 - label, label)


def clip_unit(x: Column) -> Column:
    """Limit to [0, 1]; used on training losses shown next to accuracies."""
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def linear_score(features: dict[str, float], intercept: float) -> Column:
    """Logit of a linear model with known coefficients."""
    return reduce(lambda acc, kv: acc + F.col(kv[0]) * kv[1], features.items(), F.lit(float(intercept)))
