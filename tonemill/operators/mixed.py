"""Naive Bayes on numeric and nominal attributes together.

Numeric attributes have Gaussian moments per class, nominal ones smoothed counts per value and class: ``(n + 1) / (n_c + v)``
with ``n_c`` rows of the class that have a value and ``v`` values of the attribute in the domain.  A value that is missing
says nothing; one that was never seen counts as seen zero times.  A model is a table (by..., label, feature, value, n, mean, m2);
numeric rows have no value, nominal ones no moments, and both merge: counts add up, moments as in ``bayes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.operators.bayes import class_scores, class_terms, gaussian_fit, merge_gaussian, pick_class, raised_scores, scaled, sum_of, top_of
from tonemill.operators.joins import lookup_join, store_lookup
from tonemill.session import durable

COLUMNS = ["label", "feature", "value", "n", "mean", "m2"]


def mixed_fit(df: DataFrame, numeric: list[str], nominal: list[str], by: list[str], label: str = "label") -> DataFrame:
    """One row per class and numeric attribute, and per class and nominal value that occurs."""
    none = lambda kind: F.lit(None).cast(kind)
    moments = gaussian_fit(df, numeric, by, label).withColumn("value", none("string"))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in nominal]
    long = df.select(*by, F.col(label).alias("label"), F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    counts = long.groupBy(*by, "label", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumns({"mean": none("double"), "m2": none("double")})
    return moments.select(*by, *COLUMNS).unionByName(counts.select(*by, *COLUMNS))


def merge_mixed(stats: DataFrame, by: list[str]) -> DataFrame:
    """Models of separate row sets as one."""
    numeric, nominal = stats.filter("value is null"), stats.filter("value is not null")
    moments = merge_gaussian(numeric, by).withColumn("value", F.lit(None).cast("string"))
    counts = nominal.groupBy(*by, "label", "feature", "value").agg(F.sum("n").alias("n")).withColumns({"mean": F.lit(None).cast("double"), "m2": F.lit(None).cast("double")})
    return moments.select(*by, *COLUMNS).unionByName(counts.select(*by, *COLUMNS))


def mixed_classify(
    df: DataFrame, stats: DataFrame, numeric: list[str], nominal: list[str], by: list[str], weights: dict[str, float] | None = None,
    spread: list[str] | None = None,
) -> DataFrame:
    """Score rows; adds ``dist``, ``predicted`` and ``prob``; a row whose domain has no model gets a null class.

    Every nominal attribute is one join with the values it has, so a row is not moved while they are few.
    """
    stats = durable(stats, "mixed-model")
    packed = store_lookup(class_terms(stats.filter("value is null"), numeric, by, weights), "mixed-classes")
    scored = lookup_join(df, packed, by, "left", spread=spread).withColumn("_s", class_scores(F.col("classes"), numeric)).drop("classes")
    for i, attribute in enumerate(nominal):
        mine = stats.filter((F.col("value").isNotNull()) & (F.col("feature") == attribute)).select(*by, "label", "value", "n")
        sizes = mine.groupBy(*by, "label").agg(F.sum("n").alias("n_c"))
        kinds = mine.groupBy(*by).agg(F.countDistinct("value").alias("v"))
        every = stats.filter("value is null").select(*by, "label").distinct().join(kinds, by, "left").join(sizes, [*by, "label"], "left")
        unseen = every.withColumn("loss", -F.log((F.coalesce("n_c", F.lit(0)) + F.coalesce("v", F.lit(0))).cast("double")))
        # What a class loses for any value, and what it gains back for a value it has seen.
        losses = unseen.filter("v is not null").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", "loss"))).alias("_losses"))
        gains = mine.groupBy(*by, "value").agg(F.map_from_entries(F.collect_list(F.struct("label", F.log(F.col("n") + 1.0)))).alias("_gains"))
        asked = scored.withColumn(f"_v{i}", F.col(attribute).cast("string"))
        met = lookup_join(asked, losses, by, "left", spread=spread)
        met = lookup_join(met, gains.withColumnRenamed("value", f"_v{i}"), [*by, f"_v{i}"], "left", spread=spread)
        more = lambda s: F.coalesce(F.try_element_at("_losses", s["label"]), F.lit(0.0)) + F.coalesce(F.try_element_at("_gains", s["label"]), F.lit(0.0))  # noqa: B023, E731
        added = F.transform("_s", lambda s: F.struct(s["label_idx"].alias("label_idx"), s["label"].alias("label"), (s["score"] + more(s)).alias("score")))  # noqa: B023
        scored = met.withColumn("_s", F.when(F.col(f"_v{i}").isNull(), F.col("_s")).otherwise(added)).drop(f"_v{i}", "_losses", "_gains")
    staged = scored.withColumn("_e", raised_scores(F.col("_s"), top_of(F.col("_s"), "score")))
    return pick_class(staged.withColumn("dist", scaled(F.col("_e"), sum_of(F.col("_e"), "prob")))).drop("_s", "_e")
