"""Gaussian naive Bayes on the words a text holds, without wide vectors.

Every known term is a feature of value one or zero.  The mean of a term in a class is the share ``p`` of
the class's texts that hold it and its variance ``p (1 - p)``, so a model is a table of counts (by..., label, feature, n):
``n`` texts of the class hold the term, and the row of the empty feature has the number of texts of the class.  Tables merge by
adding ``n``.

A class score is a base, in which every term is absent, plus a correction for each term that is present.  Terms that a
class has not seen all have the same correction, so only counts that exist are stored and a text meets a term in one join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.operators.counts import MET, TEXTS, CountModel, class_names, count_fit, count_scores
from tonemill.operators.joins import lookup_join, store_lookup
from tonemill.operators.words import gains_from_counts
from tonemill.session import durable

# Fixed value: values are told apart to one hundredth, and a deviation is a sixth of that at least.
LEAST_VARIANCE = (0.01 / 6) ** 2
#: What an absent and a present term that the class has not seen add to its score.
UNSEEN_ABSENT = -0.5 * math.log(2 * math.pi * LEAST_VARIANCE)
UNSEEN_PRESENT = -0.5 / LEAST_VARIANCE


def presence_fit(df: DataFrame, by: list[str], terms: str = "terms", label: str = "label") -> DataFrame:
    """(by..., label, feature, n): texts of each class that hold a term, and texts of each class."""
    return count_fit(df.withColumn(terms, F.array_distinct(terms)), terms, by, label)


def select_counts(stats: DataFrame, by: list[str], min_gain: float = 0.0) -> DataFrame:
    """The rows of terms that tell something about the class, by the counts alone; texts are not read again."""
    is_text = F.col("feature") == TEXTS
    totals = stats.filter(is_text).select(*by, "label", F.col("n").cast("double").alias("n_c"))
    cells = stats.filter(~is_text).select(*by, F.col("feature").alias("term"), "label", F.col("n").cast("double").alias("n_tc"))
    gains = gains_from_counts(cells, totals, by)
    kept = gains.filter(F.col("gain") > min_gain) if min_gain > 0 else gains
    chosen = stats.filter(~is_text).join(kept.select(*by, F.col("term").alias("feature")), [*by, "feature"], "left_semi")
    return chosen.select(stats.columns).union(stats.filter(is_text))


def _absent(p: Column, var: Column) -> Column:
    return -0.5 * F.log(2 * math.pi * var) - p * p / (2 * var)


def prepare_presence(stats: DataFrame, by: list[str]) -> CountModel:
    """The stored scoring form: corrections per term, bases per model."""
    stored = durable(stats, "presence")
    labels = class_names(stored)
    is_text = F.col("feature") == TEXTS
    sizes = stored.filter(is_text).groupBy(*by, "label").agg(F.sum("n").cast("double").alias("n_c"))
    cells = lookup_join(stored.filter(~is_text), sizes, [*by, "label"], "inner", spread=["feature"])
    p = F.col("n") / F.col("n_c")
    var = F.greatest(p * (1 - p), F.lit(LEAST_VARIANCE))
    cells = cells.select(*by, "label", "feature", "n", p.alias("p"), var.alias("var"))
    correction = (2 * F.col("p") - 1) / (2 * F.col("var")) - UNSEEN_PRESENT
    gains = [F.coalesce(F.sum(F.when(F.col("label") == name, correction)), F.lit(0.0)).alias(f"_g{i}") for i, name in enumerate(labels)]
    terms = store_lookup(cells.groupBy(*by, F.col("feature").alias("term")).agg(F.lit(1).alias("_known"), F.sum("n").alias(MET), *gains), "terms", MET)

    seen = cells.groupBy(*by, "label").agg(F.sum(_absent(F.col("p"), F.col("var")) - UNSEEN_ABSENT).alias("seen"))
    known = terms.table.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("v"))
    model = Window.partitionBy(*by)
    base = F.log(F.col("n_c") / F.sum("n_c").over(model)) + F.coalesce("seen", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)) * UNSEEN_ABSENT
    entry = F.struct("label_idx", "label", F.col("base").alias("prior"), F.lit(-UNSEEN_PRESENT).alias("log_total"))
    classes = (
        sizes.join(seen, [*by, "label"], "left").join(known, by, "left").withColumn("base", base)
        .withColumn("label_idx", F.row_number().over(model.orderBy("label")) - 1)
        .groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("classes"))
    )
    return CountModel(labels, terms, store_lookup(classes, "classes"), by, 1.0, True)


def presence_scores(df: DataFrame, model: CountModel, key: list[str], terms: str = "terms", keep: list[str] | None = None) -> DataFrame:
    """Score texts; adds ``dist``, ``predicted`` and ``prob`` per key."""
    return count_scores(df.withColumn(terms, F.array_distinct(terms)), model, key, terms, keep)
