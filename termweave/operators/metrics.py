"""Scores of whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.scores import final_score, jaccard, word_error_rate
from termweave.functions.text import words_of
from termweave.functions.text import squeeze


def text_score(pairs: DataFrame) -> DataFrame:
    """(score) of (reference, hypothesis) texts: the mean of 1 minus the word error rate;
    1 without pairs."""
    wer = word_error_rate(words_of(squeeze("reference")), words_of(squeeze("hypothesis")))
    return pairs.agg(F.coalesce(F.avg(1 - wer), F.lit(1.0)).alias("score"))


def average_jaccard(pairs: DataFrame) -> DataFrame:
    """(score) of (truth, prediction) sets: the plain mean; 1 without pairs."""
    return pairs.agg(F.coalesce(F.avg(jaccard(F.col("truth"), F.col("prediction"))), F.lit(1.0)).alias("score"))


def weighted_jaccard(pairs: DataFrame) -> DataFrame:
    """(score) of (truth, prediction) sets, each weighed by the size of its truth plus 1."""
    weight = F.size("truth") + 1
    return pairs.agg(F.coalesce(F.sum(weight * jaccard(F.col("truth"), F.col("prediction"))) / F.sum(weight), F.lit(1.0)).alias("score"))


def overall(text: float, assertions: float, candidates: float, spark) -> float:
    return spark.range(1).select(final_score(F.lit(text), F.lit(assertions), F.lit(candidates)).alias("s")).first().s
