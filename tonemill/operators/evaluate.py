"""Confusion counts, quality measures, cross-validation and table summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill.functions.identity import DEFAULT_DOMAIN
from tonemill.operators.bayes import classify_vectors, gaussian_fit, merge_gaussian
from tonemill.session import durable


def confusion(scored: DataFrame, by: list[str] | None = None, label: str = "label") -> DataFrame:
    """(by..., label, predicted, n)."""
    return scored.groupBy(*(by or []), F.col(label).alias("label"), "predicted").agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(scored: DataFrame, classes: list[str], by: list[str] | None = None, label: str = "label") -> DataFrame:
    """One row per true class and one column per predicted class."""
    counts = scored.groupBy(*(by or []), F.col(label).alias("label")).pivot("predicted", classes).count()
    return counts.na.fill(0, classes)


def row_errors(label: Column, dist: Column) -> tuple[Column, Column, Column]:
    """Absolute error, squared error and class count of one row's distribution.

    A true class that the model does not know counts as an error of one.
    """
    truth = lambda s: F.when(s["label"] == label, 1.0).otherwise(0.0)
    absolute = F.aggregate(dist, F.lit(0.0), lambda acc, s: acc + F.abs(s["prob"] - truth(s)))
    squared = F.aggregate(dist, F.lit(0.0), lambda acc, s: acc + (s["prob"] - truth(s)) * (s["prob"] - truth(s)))
    missed = F.when(F.exists(dist, lambda s: s["label"] == label), 0.0).otherwise(1.0)
    return absolute + missed, squared + missed, F.size(dist)


def evaluate(scored: DataFrame, by: list[str] | None = None, label: str = "label") -> DataFrame:
    """(by..., n, n_unscored, accuracy, kappa, mean_abs_err, root_mean_sq_err, pct_incorrect).

    A row that no model has scored counts as wrong; the mean errors, which need a
    distribution, are those of the scored rows.  The rows are read once, into one stored row per true and predicted class; all
    measures follow from that.
    """
    keys = by or ["_all"]
    rows = scored.withColumn("label", F.col(label))
    rows = rows if by else rows.withColumn("_all", F.lit("all"))
    absolute, squared, classes = row_errors(F.col("label"), F.col("dist"))
    cells = durable(
        rows.groupBy(*keys, "label", "predicted")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("dist").isNull()).alias("n_unscored"), F.sum(absolute).alias("absolute"),
            F.sum(squared).alias("squared"), F.sum(F.when(F.col("dist").isNotNull(), classes)).alias("classes"),
        ),
        "cells",
    )
    side = lambda c, name: cells.groupBy(*keys, F.col(c).alias("class")).agg(F.sum("n").alias(name))
    chance = (
        side("label", "n_true").join(side("predicted", "n_pred"), [*keys, "class"])
        .groupBy(*keys).agg(F.sum(F.col("n_true").cast("double") * F.col("n_pred")).alias("by_chance"))
    )
    totals = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_unscored").alias("n_unscored"),
        F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"),
        (F.sum("absolute") / F.sum("classes")).alias("mean_abs_err"),
        F.sqrt(F.sum("squared") / F.sum("classes")).alias("root_mean_sq_err"),
    )
    n = F.col("n")
    po = F.col("right") / n
    pe = F.coalesce(F.col("by_chance"), F.lit(0.0)) / (n.cast("double") * n)
    return totals.join(chance, keys, "left").select(
        *(by or []), "n", "n_unscored", po.alias("accuracy"),
        F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(0.0).alias("kappa"),
        "mean_abs_err", "root_mean_sq_err", ((1 - po) * 100).alias("pct_incorrect"),
    )


def fold_of(key: Column, k: int) -> Column:
    return F.pmod(key, F.lit(k)).cast("int")


def cross_validate(
    rows: DataFrame, features: list[str], k: int = 10, key: str = "doc_id", domain: str = "domain",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Score every row with the model of the other folds.

    The statistics of each fold are taken once; the model for a fold is the
    merge of the statistics of all others, so the rows are read once for training
    however many folds there are.
    """
    folded = rows.withColumn("fold", fold_of(F.col(key), k))
    parts = gaussian_fit(folded, features, [domain, "fold"])
    held_out = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold")))
    others = merge_gaussian(parts.withColumn("_for", held_out).drop("fold").withColumnRenamed("_for", "fold"), [domain, "fold"])
    pair = F.concat_ws("#", F.col(domain), F.col("fold").cast("string"))
    return classify_vectors(
        folded.withColumn("_model", pair), others.withColumn("_model", pair).drop(domain, "fold"),
        features, weights, domain="_model", spread=[key],
    ).drop("_model")


def evaluation_domains(spark, names: DataFrame, domain: str = "domain") -> DataFrame:
    """The distinct named domains and the default one."""
    default = spark.range(1).select(F.lit(DEFAULT_DOMAIN).alias(domain))
    return names.select(domain).union(default).distinct()


def table_summary(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Row count, attribute count, place of the class and the attribute names of a labelled table."""
    others = [c for c in df.columns if c != label and c not in (by or [])]
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(others) + 1).alias("n_columns"),
        F.lit(len(others)).alias("class_place"),
        F.lit(",".join(others)).alias("other_columns"),
    )


def ingest_audit(rows: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """Files found against rows made, with a flag where they differ."""
    counted = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(file).alias("n_files_used"))
    found = files.agg(F.count(F.lit(1)).alias("n_files"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    return (
        one(counted).join(one(found), "_k").drop("_k")
        .withColumn("differs", F.col("n_rows") != F.col("n_files"))
    )


def line_audit(n_read: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """(n_read, n_kept, n_rejected, n_lost, differs) of a load.

    ``n_read`` holds the lines or rows as they were read.  Rows that were rejected are accounted for;
    a difference means that rows were neither kept nor rejected.
    """
    sizes = [
        df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))
        for df, name in ((n_read, "n_read"), (kept, "n_kept"), (rejected, "n_rejected"))
    ]
    one = sizes[0].join(sizes[1], "_k").join(sizes[2], "_k").drop("_k")
    lost = F.col("n_read") - F.col("n_kept") - F.col("n_rejected")
    return one.withColumn("n_lost", lost).withColumn("differs", lost != 0)


def observed_load(lines: DataFrame, split: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, rejected rows, audit) of a load whose counts are taken while it is written.

    ``split`` turns lines into rows with a ``reason`` where one is rejected.  The lines are read once: they are counted
    before the split, its rows after it, and both kinds are stored in the same job.  The audit is like that of ``line_audit``.
    """
    spark = lines.sparkSession
    before, after = Observation(), Observation()
    rows = split(lines.observe(before, F.count(F.lit(1)).alias("n_read")))
    rejected = F.col("reason").isNotNull()
    counted = rows.observe(after, F.count_if(~rejected).alias("n_kept"), F.count_if(rejected).alias("n_rejected"))
    counted.withColumn("_rejected", rejected).write.mode("overwrite").partitionBy("_rejected").parquet(path)
    n = before.get | after.get
    lost = n["n_read"] - n["n_kept"] - n["n_rejected"]
    audit = spark.createDataFrame(
        [(n["n_read"], n["n_kept"], n["n_rejected"], lost, lost != 0)], "n_read long, n_kept long, n_rejected long, n_lost long, differs boolean"
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("_rejected", T.BooleanType())])
    stored = spark.read.schema(schema).parquet(path)
    return stored.filter(~F.col("_rejected")).drop("_rejected", "reason"), stored.filter("_rejected").drop("_rejected"), audit
