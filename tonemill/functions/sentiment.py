"""Score classes and the mapping of the overall class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the seven score classes.
NEUTRAL = "neutral"
STRONG_POSITIVE = "strong_positive"
POSITIVE = "positive"
WEAK_POSITIVE = "weak_positive"
WEAK_NEGATIVE = "weak_negative"
NEGATIVE = "negative"
STRONG_NEGATIVE = "strong_negative"


def score_class(score: Column) -> Column:
    """Seven classes with edges at 0, 0.25 and 0.75; unknown scores are neutral.

    NaN sorts above every number in Spark, so it is tested first.
    """
    return (
        F.when(score.isNull() | F.isnan(score) | (score == 0), NEUTRAL)
        .when(score >= 0.75, STRONG_POSITIVE)
        .when(score > 0.25, POSITIVE)
        .when(score > 0, WEAK_POSITIVE)
        .when(score <= -0.75, STRONG_NEGATIVE)
        .when(score < -0.25, NEGATIVE)
        .otherwise(WEAK_NEGATIVE)
    )


def overall_class(total: Column) -> Column:
    """Sentence class 0..4 from the lexicon total of the sentence."""
    return (
        F.when(total >= 0.75, 4).when(total > 0, 3).when(total <= -0.75, 0).when(total < 0, 1).otherwise(2)
    )


def centred_class(overall: Column) -> Column:
    """Class 0..4 to -2..2; -1 means no prediction and counts as 0."""
    return F.when(overall == -1, 0).otherwise(overall - 2)
