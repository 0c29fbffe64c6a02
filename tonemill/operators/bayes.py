"""Gaussian naive Bayes on numeric features, kept as sums that can be merged.

A model is a long table (keys..., label, feature, n, mean, m2) with ``m2`` the sum
of squared differences from the mean.  Two tables of the same keys merge without
looking at the rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.operators.joins import Lookup, lookup_join, store_lookup

VARIANCE_FLOOR = 1e-9


def gaussian_fit(
    df: DataFrame, features: list[str], by: list[str] | None = None, label: str = "label"
) -> DataFrame:
    """One pass over the rows; each task sends one row per key and class."""
    by = by or []
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_mean"), (F.var_pop(f) * F.count(f)).alias(f"{f}_m2")]
    wide = df.groupBy(*by, F.col(label).alias("label")).agg(*aggs)
    cells = [
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_mean").alias("mean"), F.col(f"{f}_m2").alias("m2"))
        for f in features
    ]
    return wide.select(*by, "label", "n", F.inline(F.array(*cells))).select(
        *by, "label", "feature", "n", "mean", "m2"
    )


def merge_gaussian(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add up statistics of separate row sets that share the same keys.

    The pairwise formula in its many-sided form: squared differences inside each
    part plus those of the part means around the common mean.
    """
    keys = [*(by or []), "label", "feature"]
    trained = stats.filter(F.col("n") > 0)
    whole = trained.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")
    )
    parts = trained.select(*keys, F.col("n").alias("n_i"), F.col("mean").alias("mean_i"), "m2")
    joined = parts.join(whole, keys)
    spread = F.col("m2") + F.col("n_i") * F.pow(F.col("mean_i") - F.col("mean"), 2)
    return joined.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(spread).alias("m2")
    )


def class_terms(
    stats: DataFrame,
    features: list[str],
    by: list[str],
    weights: dict[str, float] | None = None,
    index_by: list[str] | None = None,
) -> DataFrame:
    """(by..., classes): the scoring terms of every class, packed into one array per model.

    A class score is ``base - sum_f k_f (x_f - mean_f)^2``.  The array holds the
    classes of one model, which are few; the rows of the data are not touched.
    """
    weights = weights or {}
    trained = stats.filter(F.col("n") > 0)

    def cell(f: str, column: str) -> Column:
        return F.max(F.when(F.col("feature") == f, F.col(column)))

    aggs = [F.max("n").cast("double").alias("n")]
    for f in features:
        aggs += [cell(f, "mean").alias(f"{f}_mean"), (cell(f, "m2") / cell(f, "n")).alias(f"{f}_var")]
    wide = trained.groupBy(*by, "label").agg(*aggs)
    return pack_classes(wide, features, by, weights, index_by)


def pack_classes(
    wide: DataFrame,
    features: list[str],
    by: list[str],
    weights: dict[str, float],
    index_by: list[str] | None = None,
) -> DataFrame:
    """Pack (by..., label, n, f_mean, f_var...) rows into one array of classes per ``by``."""
    model = Window.partitionBy(*by)
    per_var = [F.col(f"{f}_var") for f in features]
    highest = F.max(F.greatest(*per_var) if len(per_var) > 1 else per_var[0]).over(model)
    # Without any spread the floor itself is the variance.
    floor = F.when(highest > 0, highest * VARIANCE_FLOOR).otherwise(VARIANCE_FLOOR)
    ranked = wide.withColumn("_floor", floor).withColumn("_prior", F.log(F.col("n") / F.sum("n").over(model)))
    indexed = ranked.withColumn(
        "label_idx", F.dense_rank().over(Window.partitionBy(*(index_by or by)).orderBy("label")) - 1
    )
    base = F.col("_prior")
    for f in features:
        w = weights.get(f, 1.0)
        base = base - F.lit(0.5 * w) * F.log(F.lit(2 * math.pi) * (F.col(f"{f}_var") + F.col("_floor")))
    packed = F.struct(
        "label_idx",
        "label",
        base.alias("base"),
        F.array(*[F.col(f"{f}_mean") for f in features]).alias("means"),
        F.array(
            *[F.lit(0.5 * weights.get(f, 1.0)) / (F.col(f"{f}_var") + F.col("_floor")) for f in features]
        ).alias("pulls"),
    )
    return indexed.groupBy(*by).agg(F.array_sort(F.collect_list(packed)).alias("classes"))


def pack_members(packed: DataFrame, domain: str, member: str) -> DataFrame:
    """(domain, members): all models of a domain in one array, in id order."""
    entry = F.struct(F.col(member).cast("string").alias("model_id"), "classes")
    return packed.groupBy(domain).agg(F.array_sort(F.collect_list(entry)).alias("members"))


def class_scores(classes: Column, features: list[str]) -> Column:
    """array<struct<label_idx, label, score>> of one row under one model."""

    def score(c: Column) -> Column:
        total = c["base"]
        for i, f in enumerate(features):
            gap = F.col(f) - c["means"][i]
            total = total - c["pulls"][i] * gap * gap
        return F.struct(c["label_idx"].alias("label_idx"), c["label"].alias("label"), total.alias("score"))

    return F.transform(classes, score)


def raised_scores(scores: Column, top: Column) -> Column:
    """Scores to weights that are still to be divided by their sum; ``top`` is the highest score."""
    return F.transform(
        scores,
        lambda s: F.struct(
            s["label_idx"].alias("label_idx"), s["label"].alias("label"),
            F.exp(s["score"] - top).alias("prob"),
        ),
    )


def scaled(parts: Column, total: Column) -> Column:
    return F.transform(
        parts,
        lambda s: F.struct(
            s["label_idx"].alias("label_idx"), s["label"].alias("label"), (s["prob"] / total).alias("prob")
        ),
    )


def sum_of(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + s[field])


def top_of(items: Column, field: str) -> Column:
    return F.array_max(F.transform(items, lambda s: s[field]))


def member_distributions(df: DataFrame, features: list[str]) -> DataFrame:
    """Turn ``members`` into ``votes``: array<struct<model_id, dist>>, one entry per member.

    All of it happens inside the row, so scoring neither shuffles nor needs state.
    """
    scored = df.withColumn(
        "_s",
        F.transform(
            "members",
            lambda m: F.struct(m["model_id"].alias("model_id"), class_scores(m["classes"], features).alias("s")),
        ),
    )
    raised = scored.withColumn(
        "_e",
        F.transform(
            "_s",
            lambda m: F.struct(m["model_id"].alias("model_id"), raised_scores(m["s"], top_of(m["s"], "score")).alias("e")),
        ),
    )
    votes = F.transform(
        "_e",
        lambda m: F.struct(
            m["model_id"].alias("model_id"), scaled(m["e"], sum_of(m["e"], "prob")).alias("dist")
        ),
    )
    return raised.withColumn("votes", votes).drop("_s", "_e", "members")


def average_votes(df: DataFrame) -> DataFrame:
    """Turn ``votes`` into ``dist``: the mean of the members' class distributions.

    A class that a member never saw has probability 0 with that member.
    """
    flat = F.flatten(F.transform("votes", lambda v: v["dist"]))
    names = F.array_sort(
        F.array_distinct(
            F.transform("_flat", lambda x: F.struct(x["label_idx"].alias("label_idx"), x["label"].alias("label")))
        )
    )

    def mean(name: Column) -> Column:
        mine = F.filter(F.col("_flat"), lambda x: x["label_idx"] == name["label_idx"])
        return F.struct(
            name["label_idx"].alias("label_idx"),
            name["label"].alias("label"),
            (sum_of(mine, "prob") / F.size("votes")).alias("prob"),
        )

    return (
        df.withColumn("_flat", flat)
        .withColumn("_names", names)
        .withColumn("dist", F.transform("_names", mean))
        .drop("_flat", "_names", "votes")
    )


def pick_class(df: DataFrame) -> DataFrame:
    """Add ``predicted`` and ``prob``; equal probabilities go to the lowest class index."""
    best = F.array_max(
        F.transform(
            "dist",
            lambda s: F.struct(s["prob"].alias("prob"), (-s["label_idx"]).alias("order"), s["label"].alias("label")),
        )
    )
    return (
        df.withColumn("_best", best)
        .withColumn("predicted", F.col("_best.label"))
        .withColumn("prob", F.col("_best.prob"))
        .drop("_best")
    )


def prepare_members(
    stats: DataFrame, features: list[str], weights: dict[str, float] | None = None,
    domain: str = "domain", member: str | None = None,
) -> Lookup:
    """The stored scoring form of a model table, one row per domain."""
    if member is None:
        member = "_member"
        stats = stats.withColumn(member, F.lit("model"))
    packed = class_terms(stats, features, [domain, member], weights, index_by=[domain])
    return store_lookup(pack_members(packed, domain, member), "members")


def score_members(
    df: DataFrame,
    model: DataFrame | Lookup,
    features: list[str],
    weights: dict[str, float] | None = None,
    domain: str = "domain",
    member: str | None = None,
    spread: list[str] | None = None,
) -> DataFrame:
    """Join the packed models of the domain and add ``votes``."""
    members = model if isinstance(model, Lookup) else prepare_members(model, features, weights, domain, member)
    return member_distributions(lookup_join(df, members, [domain], "left", spread=spread), features)


def classify_vectors(
    df: DataFrame,
    model: DataFrame | Lookup,
    features: list[str],
    weights: dict[str, float] | None = None,
    domain: str = "domain",
    member: str | None = None,
    spread: list[str] | None = None,
) -> DataFrame:
    """Score rows with the models of their domain; adds ``dist``, ``predicted`` and ``prob``.

    With several members per domain the distributions are averaged.  A row whose
    domain has no model gets a null class.
    """
    voted = score_members(df, model, features, weights, domain, member, spread)
    return pick_class(average_votes(voted))
