"""Combining models: an averaged vote of all members, or the member with the lowest error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions.text import unnest
from tonemill.operators.bayes import score_members
from tonemill.operators.evaluate import row_errors


class NoTrainedModel(ValueError):
    """Nothing to combine: there is no model, or none has seen a row."""


def union_members(*models: DataFrame) -> DataFrame:
    """Model tables of several builders in one.

    A member that several tables have is taken whole from the first of them, so two
    snapshots of one member never mix.
    """
    merged, *rest = models
    keys = [c for c in ("domain", "model_id") if c in merged.columns]
    for m in rest:
        merged = merged.unionByName(m.join(merged.select(*keys).distinct(), keys, "left_anti"))
    return merged.dropDuplicates([*keys, *[c for c in ("label", "feature") if c in merged.columns]])


def trained_only(models: DataFrame) -> DataFrame:
    return models.filter(F.col("n") > 0)


def check_trained(models: DataFrame) -> DataFrame:
    kept = trained_only(models)
    if kept.limit(1).count() == 0:
        raise NoTrainedModel("no trained model to combine")
    return kept


def member_errors(
    rows: DataFrame, models: DataFrame, features: list[str], weights: dict[str, float] | None = None,
    domain: str = "domain", label: str = "label", spread: list[str] | None = None,
) -> DataFrame:
    """(domain, model_id, n, root_mean_sq_err) of every member on the rows of its domain."""
    voted = score_members(rows, models, features, weights, domain, "model_id", spread)
    each = unnest(voted, F.col("votes"), [domain, label], "_v").select(
        domain, label, F.col("_v.model_id").alias("model_id"), F.col("_v.dist").alias("dist")
    )
    _, squared, classes = row_errors(F.col(label), F.col("dist"))
    return each.groupBy(domain, "model_id").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(squared) / F.sum(classes)).alias("root_mean_sq_err")
    )


def best_of(errors: DataFrame, domain: str = "domain") -> DataFrame:
    """The member with the lowest error per domain; equal errors go to the first id."""
    key = F.struct(F.round("root_mean_sq_err", 9), "model_id")
    best = F.min_by(F.struct("model_id", "root_mean_sq_err"), key)
    return errors.groupBy(domain).agg(best.alias("_b")).select(domain, "_b.model_id", "_b.root_mean_sq_err")


def ensemble(
    models: DataFrame, combiner: str = "voting", evaluation: DataFrame | None = None,
    features: list[str] | None = None, weights: dict[str, float] | None = None, domain: str = "domain",
) -> DataFrame:
    """The member rows that make up the combined model of each domain."""
    members = check_trained(models)
    if combiner == "voting":
        return members
    if combiner == "best":
        if evaluation is None or features is None:
            raise ValueError("the best-of combiner needs evaluation rows and the feature names")
        chosen = best_of(member_errors(evaluation, members, features, weights, domain), domain)
        return members.join(chosen.select(domain, "model_id"), [domain, "model_id"], "left_semi")
    raise ValueError(f"unknown combiner {combiner!r}; choose voting or best")
