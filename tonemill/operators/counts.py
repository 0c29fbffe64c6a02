"""Count-based classifiers: multinomial naive Bayes on words, a character n-gram model.

A model is a long table (by..., label, feature, n).  The row with the empty feature
holds the number of training texts of the class; no term is empty.  Only counts that
occur are stored, and tables merge by adding ``n``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.functions.text import char_ngrams, unnest
from tonemill.operators.bayes import pick_class, raised_scores, scaled, sum_of, top_of
from tonemill.operators.joins import Lookup, lookup_join, store_lookup
from tonemill.operators.runs import run_sums
from tonemill.session import durable

TEXTS = ""
#: How often a term was met in training.
MET = "_met"


def count_fit(df: DataFrame, terms: str = "terms", by: list[str] | None = None, label: str = "label") -> DataFrame:
    """Term counts by class; repeats inside a task are added up before the shuffle."""
    by = by or []
    with_text_mark = F.concat(F.array(F.lit(TEXTS)), F.col(terms))
    rows = unnest(df.withColumn("label", F.col(label)), with_text_mark, [*by, "label"], "feature")
    return rows.groupBy(*by, "label", "feature").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    return stats.groupBy(*(by or []), "label", "feature").agg(F.sum("n").alias("n"))


def class_table(stats: DataFrame, by: list[str], alpha: float, prior: bool) -> DataFrame:
    """(by..., classes): per class the prior and the log of its smoothed total."""
    is_text = F.col("feature") == TEXTS
    totals = stats.groupBy(*by, "label").agg(
        F.sum(F.when(is_text, F.col("n")).otherwise(0)).cast("double").alias("n_texts"),
        F.sum(F.when(is_text, 0).otherwise(F.col("n"))).cast("double").alias("n_terms"),
    )
    sizes = (
        stats.filter(~is_text).groupBy(*by, "feature").agg(F.lit(1).alias("_one"))
        .groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("v"))
    )
    joined = totals.join(sizes, by, "left") if by else totals.withColumn("v", F.lit(float(_first(sizes))))
    model = Window.partitionBy(*by)
    log_prior = F.log((F.col("n_texts") + 1) / (F.sum("n_texts").over(model) + F.count(F.lit(1)).over(model)))
    order = Window.partitionBy(*by).orderBy("label")
    entry = F.struct(
        "label_idx", "label", F.col("_prior").alias("prior"),
        F.log(F.col("n_terms") + alpha * F.coalesce(F.col("v"), F.lit(0.0))).alias("log_total"),
    )
    return (
        joined.withColumn("_prior", log_prior if prior else F.lit(0.0))
        .withColumn("label_idx", F.row_number().over(order) - 1)
        .groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("classes"))
    )


def _first(sizes: DataFrame) -> float:
    row = sizes.first()
    return row["v"] if row else 0.0


def class_names(stats: DataFrame) -> list[str]:
    """The declared classes of a model; a schema-sized list."""
    rows = stats.filter(F.col("feature") == TEXTS).select("label").distinct().orderBy("label").collect()
    return [r["label"] for r in rows]


@dataclass(frozen=True)
class CountModel:
    """The stored scoring form: one row per term, one row of classes per model.

    A single model for all rows needs no join for its classes; they are few and
    become a constant.
    """

    labels: list[str]
    terms: Lookup
    classes: Lookup | Column
    by: list[str]
    alpha: float
    known_only: bool


def prepare_counts(
    stats: DataFrame, by: list[str] | None = None, alpha: float = 1.0, prior: bool = True, known_only: bool = True
) -> CountModel:
    """Store the statistics once and lay them out for scoring."""
    by = by or []
    stored = durable(stats, "counts")
    labels = class_names(stored)
    floor = math.log(alpha)
    gains = [
        F.coalesce(
            F.sum(F.when(F.col("label") == name, F.log(F.col("n") + F.lit(alpha)) - floor)), F.lit(0.0)
        ).alias(f"_g{i}")
        for i, name in enumerate(labels)
    ]
    seen = stored.filter(F.col("feature") != TEXTS)
    terms = seen.groupBy(*by, F.col("feature").alias("term")).agg(F.lit(1).alias("_known"), F.sum("n").alias(MET), *gains)
    table = class_table(stored, by, alpha, prior)
    classes = store_lookup(table, "classes") if by else _constant(table)
    return CountModel(labels, store_lookup(terms, "terms", MET), classes, by, alpha, known_only)


def _constant(table: DataFrame) -> Column:
    row = table.first()
    return F.array(
        *[
            F.struct(
                F.lit(c["label_idx"]).alias("label_idx"), F.lit(c["label"]).alias("label"),
                F.lit(c["prior"]).alias("prior"), F.lit(c["log_total"]).alias("log_total"),
            )
            for c in (row["classes"] if row else [])
        ]
    )


def count_scores(
    df: DataFrame, model: CountModel, key: list[str], terms: str = "terms", keep: list[str] | None = None
) -> DataFrame:
    """Score texts; adds ``dist``, ``predicted`` and ``prob`` per key.

    A class score is the prior plus ``sum count * log((n + alpha) / (total + alpha v))``.
    It is split into a part that every counted term shares (``log alpha - log total``)
    and a part only for terms the class has seen, so each term needs one join with
    the terms that exist, and each text leaves its task as one row.
    """
    by, keep, labels = model.by, keep or [], model.labels
    floor = math.log(model.alpha)
    rows = df.select(*key, *by, *keep, F.explode_outer(terms).alias("term"))
    summed = _gains_by_text(rows, model, key, keep)
    if isinstance(model.classes, Lookup):
        with_classes = lookup_join(summed, model.classes, by, "left", spread=key)
    else:
        with_classes = summed.withColumn("classes", model.classes)
    return _scored(with_classes, labels, floor).select(*key, *by, *keep, "dist", "predicted", "prob")


def _scored(summed: DataFrame, labels: list[str], floor: float) -> DataFrame:
    """Add ``dist``, ``predicted`` and ``prob`` to rows (_n, _g0..., classes)."""
    gain_by_class = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.col(f"_g{i}"))])

    def score(c: Column) -> Column:
        shared = F.col("_n") * (F.lit(floor) - c["log_total"])
        return F.struct(
            c["label_idx"].alias("label_idx"), c["label"].alias("label"),
            (c["prior"] + shared + F.col("_gains")[c["label"]]).alias("score"),
        )

    staged = (
        summed.withColumn("_gains", gain_by_class)
        .withColumn("_s", F.transform("classes", score))
        .withColumn("_e", raised_scores(F.col("_s"), top_of(F.col("_s"), "score")))
        .withColumn("dist", scaled(F.col("_e"), sum_of(F.col("_e"), "prob")))
    )
    return pick_class(staged)


def _gains_by_text(rows: DataFrame, model: CountModel, key: list[str], keep: list[str]) -> DataFrame:
    """(key..., by..., keep..., _n, _g0...): counted terms of each text and what they add to each class.

    Terms beyond a broadcast meet their rows in two steps.  The head of the terms met most often in training is
    broadcast, and what it adds is summed up where the text is read; only terms that it does not have, once per text with their
    number, are shuffled to the tail.  So a frequent term, be it a third of all, never moves.
    """
    by, known_only, lookup = model.by, model.known_only, model.terms
    gains = [f"_g{i}" for i in range(len(model.labels))]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    if lookup.head is None:
        joined = lookup_join(rows, lookup, [*by, "term"], "left", spread=key)
        counted = F.col("_known" if known_only else "term").isNotNull()
        return joined.groupBy(*key, *by, *keep).agg(F.count(F.when(counted, 1)).alias("_n"), *[total(g).alias(g) for g in gains])
    met = rows.join(F.broadcast(lookup.head), [*by, "term"], "left")
    missed = F.when(F.col("_known").isNull(), F.col("term"))
    in_place = met.groupBy(*key, *by, *keep, missed.alias("term")).agg(F.count("_known").alias("_n"), F.count("term").alias("_all"), *[total(g).alias(g) for g in gains])
    # The one row of a text without a missed term is dealt by its text, so that these rows do not meet.
    own = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    dealt = in_place.select(*key, *by, *keep, F.col("term").isNotNull().alias("_missed"), F.coalesce("term", own).alias("term"), "_n", "_all", *gains)
    tail = lookup.tail.select(*by, "term", F.lit(True).alias("_missed"), "_known", *[F.col(g).alias(f"_t{g}") for g in gains])
    both = dealt.join(tail, [*by, "term", "_missed"], "left")
    counted = F.when(F.col("_missed"), F.when(F.col("_known").isNotNull() | F.lit(not known_only), F.col("_all")).otherwise(0)).otherwise(F.col("_n"))
    added = [total(F.when(F.col("_missed"), F.col("_all") * F.coalesce(f"_t{g}", F.lit(0.0))).otherwise(F.col(g))).alias(g) for g in gains]
    return both.groupBy(*key, *by, *keep).agg(F.sum(counted).alias("_n"), *added)


# The character model of the language classifier.
CHAR_ORDER = 8
CHAR_ALPHA = 0.5
#: What the metadata of a column of character runs names: how long these are and the column they are cut from.
RUNS, RUNS_OF = "tonemill.runs", "tonemill.runsOf"


def with_char_grams(df: DataFrame, order: int = CHAR_ORDER, text: str = "text", name: str = "terms") -> DataFrame:
    """Add the runs of ``order`` characters; the column says so, and beside it stands the text that they are cut from.

    Runs that are only counted can then be cut where they are counted.
    """
    if not 1 <= order <= CHAR_ORDER:
        raise ValueError(f"the order has to be between 1 and {CHAR_ORDER}")
    of = f"_{name}_of"
    return df.withColumns({of: F.col(text), name: char_ngrams(F.col(text), order, order).alias(name, metadata={RUNS: order, RUNS_OF: of})})


def prepare_char_model(stats: DataFrame) -> CountModel:
    """Summed log-likelihood under each class's n-gram counts, without class priors."""
    return prepare_counts(stats, alpha=CHAR_ALPHA, prior=False, known_only=False)


def _sums_of_terms(df: DataFrame, others: list[str], label: str, terms: str, names: list[str]) -> DataFrame:
    """(others..., _label, _n, _new, _g0...) of any terms: a row per term is shuffled."""
    runs = df.select(*others, F.col(label).alias("_label"), F.explode_outer(terms).alias("term"))
    # The one row of a text without a run is dealt by its text, so that these rows do not meet.
    runs = runs.withColumn("_own", F.when(F.col("term").isNull(), F.xxhash64(*others)))
    alike = Window.partitionBy("term", "_own")
    counted = runs.withColumns({f"_c{i}": F.count(F.when(F.col("_label") == name, F.col("term"))).over(alike) for i, name in enumerate(names)})
    first = F.col("term").isNotNull() & (F.row_number().over(alike.orderBy("term")) == 1)
    known = F.lit(False)
    for i in range(len(names)):
        known = known | (F.col(f"_c{i}") > 0)
    floor = math.log(CHAR_ALPHA)
    gains = {f"_g{i}": F.log(F.col(f"_c{i}") + F.lit(CHAR_ALPHA)) - floor for i in range(len(names))}
    return counted.withColumn("_first", first).withColumn("_known", known).withColumns(gains).groupBy(*others, "_label").agg(
        F.count("term").alias("_n"), F.count_if(F.col("_first") & F.col("_known")).alias("_new"),
        *[F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col(g))), F.lit(0.0)).alias(g) for g in gains],
    )


def char_scores_among(df: DataFrame, key: list[str], label: str = "label", terms: str = "terms", keep: list[str] | None = None) -> DataFrame:
    """The answers of a character model that is trained on those of the rows that have a class, for all rows.

    The model has nearly as many runs as the texts and is asked for every one of them, so it is not laid out as a table
    that the texts meet again: each run of each text is shuffled once, to where all its like are counted by class, and what
    these counts add is summed up there by text.  Runs of ``with_char_grams`` travel as fragments of their texts, other terms one by one.
    """
    keep = keep or []
    names = sorted(r["_l"] for r in df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_l")).distinct().collect())
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    others = [*key, *[c for c in keep if c != label]]
    made_of = df.schema[terms].metadata
    if made_of.get(RUNS_OF) in df.columns:
        number = F.coalesce(*[F.when(F.col(label) == name, F.lit(i)) for i, name in enumerate(names)], F.lit(-1))
        texts = df.select(*others, F.col(label).alias("_label"), number.alias("_no"), F.col(made_of[RUNS_OF]).alias("_text"))
        sums = run_sums(texts, [*others, "_label"], made_of[RUNS], len(names), CHAR_ALPHA)
        per_text = sums.groupBy(*others, "_label").agg(*[F.sum(c).alias(c) for c in ("_n", "_new", *[f"_g{i}" for i in range(len(names))])])
    else:
        per_text = _sums_of_terms(df, others, label, terms, names)
    stored = durable(per_text, "char-scores")
    sizes = {r["_label"]: r for r in stored.groupBy("_label").agg(total("_n").alias("n"), total("_new").alias("v")).collect()}  # one per class
    v = sum(r["v"] for r in sizes.values())
    classes = [
        F.struct(F.lit(i).alias("label_idx"), F.lit(name).alias("label"), F.lit(0.0).alias("prior"), F.lit(math.log(sizes[name]["n"] + CHAR_ALPHA * v)).alias("log_total"))
        for i, name in enumerate(names)
    ]
    answers = _scored(stored.withColumn("classes", F.array(*classes)), names, math.log(CHAR_ALPHA))
    return answers.withColumn(label, F.col("_label")).select(*key, *keep, "dist", "predicted", "prob")
