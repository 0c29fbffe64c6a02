"""Learners that go on from a stored model: a Hoeffding tree and a linear support vector machine.

Both keep their models as rows (domain, label, feature, n, mean) of the registry, learn all domains in the same jobs,
and send only sums per domain through a shuffle.

**Hoeffding tree.**  Numeric features are counted in bins of one width, by leaf and class; counts of several row sets
merge by adding.  A leaf is split at the bin edge of the highest information gain when the best feature leads the second best by
more than the Hoeffding bound for the rows the leaf has seen, or when the bound is so small that they are as
good as equal.  Nodes are numbered like a heap: the children of ``i`` are ``2 i`` (below the cut) and ``2 i + 1``.

**Support vector machine.**  One vector of weights per class against all others, by subgradient steps of the
mean hinge loss with a squared penalty, the step of round ``t`` being ``1 / (penalty * t)``.  A round is one aggregate over
the rows; a later increment goes on with the next round's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.operators.bayes import raised_scores, scaled, sum_of, top_of
from tonemill.operators.counts import TEXTS
from tonemill.operators.joins import Lookup, lookup_join, store_lookup
from tonemill.session import durable

BIN_WIDTH = 1 / 16
#: The chance of a wrong split, the bound from which features count as equal, and the depth beyond which leaves stay.
DELTA, TIE, MAX_DEPTH = 1e-4, 0.05, 10
SEP = "|"

# ---- tree: parameter rows --------------------------------------------------------------------------
# ``<node>|<feature>|<bin>`` counts rows of a class, ``<node>||`` all rows of a class at a node, ``<node>|<feature>`` of
# the empty class is a split with its cut in ``mean``, and the empty feature has the rows of a class in the model.


def _cells(params: DataFrame) -> DataFrame:
    """(domain, label, node, feature, bin, n) of the counts at leaves; the empty feature counts all rows of a node."""
    parts = F.split("feature", r"\|")
    counts = params.filter((F.col("feature") != TEXTS) & (F.col("label") != ""))
    return counts.select(
        "domain", "label", parts[0].cast("long").alias("node"), parts[1].alias("feature"), F.nullif(parts[2], F.lit("")).cast("long").alias("bin"), "n"
    )


def _splits(params: DataFrame) -> DataFrame:
    """(domain, node, feature, cut)"""
    parts = F.split("feature", r"\|")
    return params.filter(F.col("label") == "").select("domain", parts[0].cast("long").alias("node"), parts[1].alias("feature"), F.col("mean").alias("cut"))


def _params(cells: DataFrame, splits: DataFrame, texts: DataFrame) -> DataFrame:
    name = F.concat_ws(SEP, F.col("node").cast("string"), "feature", F.coalesce(F.col("bin").cast("string"), F.lit("")))
    none = F.lit(None).cast("double").alias("mean")
    counted = cells.select("domain", "label", name.alias("feature"), "n", none)
    cut = splits.select("domain", F.lit("").alias("label"), F.concat_ws(SEP, F.col("node").cast("string"), "feature").alias("feature"), F.lit(0).cast("long").alias("n"), F.col("cut").alias("mean"))
    return counted.unionByName(cut).unionByName(texts.select("domain", "label", F.lit(TEXTS).alias("feature"), "n", none))


# ---- tree: learning ----------------------------------------------------------------------------------


def _ways(splits: DataFrame) -> DataFrame:
    """(domain, ways): the splits of a domain as one map; a tree has 2 ** MAX_DEPTH of them at most."""
    entry = F.struct("node", F.struct("feature", "cut").alias("split"))
    return splits.groupBy("domain").agg(F.map_from_entries(F.collect_list(entry)).alias("ways"))


def routed(rows: DataFrame, splits: DataFrame | Lookup, features: list[str]) -> DataFrame:
    """Adds ``node``, the leaf of each row, worked out inside the row."""
    ways = splits if isinstance(splits, Lookup) else store_lookup(_ways(splits), "tree-splits")
    met = lookup_join(rows, ways, ["domain"], "left", spread=features)
    values = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])

    def step(node: Column, _: Column) -> Column:
        split = F.try_element_at(F.col("ways"), node)
        down = 2 * node + F.when(F.try_element_at(F.col("_x"), split["feature"]) < split["cut"], 0).otherwise(1)
        return F.when(split.isNull(), node).otherwise(down)

    levels = F.sequence(F.lit(1), F.lit(MAX_DEPTH))
    placed = met.withColumn("_x", values).withColumn("node", F.aggregate(levels, F.lit(1).cast("long"), step))
    return placed.drop("_x", "ways")


def leaf_counts(rows: DataFrame, features: list[str], width: float = BIN_WIDTH) -> DataFrame:
    """(domain, label, node, feature, bin, n) of rows that know their leaf; null values are in no bin."""
    cells = [F.struct(F.lit(f).alias("feature"), F.floor(F.col(f) / width).alias("bin")) for f in features]
    whole = F.struct(F.lit("").alias("feature"), F.lit(None).cast("long").alias("bin"))
    long = rows.select("domain", "label", "node", F.inline(F.array(whole, *cells)))
    return long.filter((F.col("feature") == "") | F.col("bin").isNotNull()).groupBy("domain", "label", "node", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def _entropy(counts: list[Column]) -> Column:
    total = sum(counts[1:], counts[0])
    part = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    return F.when(total > 0, F.log2(total) - sum((part(n) for n in counts[1:]), part(counts[0])) / total).otherwise(0.0)


def split_candidates(cells: DataFrame, labels: list[str], width: float = BIN_WIDTH) -> DataFrame:
    """(domain, node, feature, cut, gain, second, n, bound, splits): the best cut of each leaf and whether it is made.

    ``second`` is the gain of the best other feature, 0 if there is none.  Gains are compared to nine places; equal
    ones go by the name of the feature and the lower cut.
    """
    names = [f"_c{i}" for i in range(len(labels))]
    binned = cells.filter(F.col("feature") != "").groupBy("domain", "node", "feature", "bin").agg(
        *[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)).cast("double").alias(c) for x, c in zip(labels, names, strict=True)]
    )
    whole = Window.partitionBy("domain", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = binned.select(
        "domain", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in names], *[F.sum(c).over(whole).alias(f"{c}t") for c in names]
    )
    left, both = [F.col(f"{c}l") for c in names], [F.col(f"{c}t") for c in names]
    right = [t - x for x, t in zip(left, both, strict=True)]
    count = lambda columns: sum(columns[1:], columns[0])
    gain = _entropy(both) - (count(left) * _entropy(left) + count(right) * _entropy(right)) / count(both)
    kinds = sum((F.when(t > 0, 1).otherwise(0) for t in both[1:]), F.when(both[0] > 0, 1).otherwise(0))
    cuts = summed.filter(count(right) > 0).select(
        "domain", "node", "feature", ((F.col("bin") + 1) * width).alias("cut"), F.round(gain, 9).alias("gain"), count(both).alias("n"), kinds.alias("kinds")
    )
    per_feature = cuts.groupBy("domain", "node", "feature").agg(F.min(F.struct((-F.col("gain")).alias("less"), "cut", "n", "kinds")).alias("b"))
    ordered = per_feature.groupBy("domain", "node").agg(F.array_sort(F.collect_list(F.struct("b.less", "feature", "b.cut", "b.n", "b.kinds"))).alias("f"))  # a few features
    best, other = F.col("f")[0], F.try_element_at("f", F.lit(2))
    first = ordered.select(
        "domain", "node", best["feature"].alias("feature"), best["cut"].alias("cut"), (-best["less"] + 0.0).alias("gain"),
        F.coalesce(-other["less"] + 0.0, F.lit(0.0)).alias("second"), best["n"].cast("long").alias("n"), best["kinds"].alias("kinds"),
    )
    scale = F.log2(F.greatest(F.col("kinds"), F.lit(2)).cast("double"))
    bound = scale * F.sqrt(F.log(F.lit(1 / DELTA)) / (2 * F.col("n")))
    made = (F.col("gain") > 0) & ((F.col("gain") - F.col("second") > F.col("bound")) | (F.col("bound") < TIE))
    return first.withColumn("bound", bound).withColumn("splits", made).drop("kinds")


def _grown(cells: DataFrame, splits: DataFrame, labels: list[str], width: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, splits, new splits) after the leaves that may split have done so.

    The children of a split begin with the class counts of its sides and no counts of features.
    """
    found = split_candidates(cells, labels, width).filter(F.col("splits") & (F.col("node") < (1 << MAX_DEPTH)))
    new = durable(found.select("domain", "node", "feature", "cut"), "tree-splits")
    here = cells.join(new.select("domain", "node", F.col("feature").alias("_f"), "cut"), ["domain", "node"])
    sides = here.filter((F.col("feature") == F.col("_f")) & F.col("bin").isNotNull())
    child = 2 * F.col("node") + F.when((F.col("bin") + 1) * width <= F.col("cut"), 0).otherwise(1)
    begun = sides.groupBy("domain", "label", child.alias("node")).agg(F.sum("n").alias("n"))
    begun = begun.select("domain", "label", "node", F.lit("").alias("feature"), F.lit(None).cast("long").alias("bin"), "n")
    kept = cells.join(new.select("domain", "node"), ["domain", "node"], "left_anti").select(begun.columns)
    return durable(kept.unionByName(begun), "tree-counts"), splits.unionByName(new), new


def tree_fit(rows: DataFrame, features: list[str], stored: DataFrame | None = None, width: float = BIN_WIDTH) -> DataFrame:
    """Parameter rows of a tree per domain, learned from rows (domain, label, features...), going on from a stored one.

    A first build reads the rows once per level, so that new leaves learn from all of them; an increment reads its rows once,
    and what it splits learns from the next one.
    """
    spark = rows.sparkSession
    rows = durable(rows.select("domain", "label", *[F.col(f).cast("double").alias(f) for f in features]), "tree-rows")
    texts = rows.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n"))
    cells = splits = None
    if stored is not None:
        stored = durable(stored.select("domain", "label", "feature", "n", "mean"), "tree-params")
        cells, splits = _cells(stored), _splits(stored)
        texts = texts.unionByName(stored.filter(F.col("feature") == TEXTS).select("domain", "label", "n")).groupBy("domain", "label").agg(F.sum("n").alias("n"))
    texts = durable(texts, "tree-texts")
    labels = [r["label"] for r in texts.select("label").distinct().orderBy("label").collect()]  # the declared classes
    if not labels:  # nothing has been seen yet
        return spark.createDataFrame([], "domain string, label string, feature string, n long, mean double")
    if splits is None:
        splits = spark.createDataFrame([], "domain string, node long, feature string, cut double")
    seen = leaf_counts(routed(rows, splits, features), features, width)
    if cells is not None:
        seen = seen.unionByName(cells.select(seen.columns)).groupBy("domain", "label", "node", "feature", "bin").agg(F.sum("n").alias("n"))
    cells, splits, new = _grown(durable(seen, "tree-counts"), splits, labels, width)
    while stored is None and new.limit(1).count():
        # The leaves made last count the features of their rows; their class counts they have.
        children = new.select("domain", F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("node"))
        placed = routed(rows, splits, features).join(F.broadcast(children), ["domain", "node"], "left_semi")
        fresh = leaf_counts(placed, features, width).filter(F.col("feature") != "")
        cells, splits, new = _grown(durable(cells.unionByName(fresh.select(cells.columns)), "tree-counts"), splits, labels, width)
    return durable(_params(cells, splits, texts), "tree-params")


def tree_scores(rows: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``dist``: the shares of the classes at the row's leaf; null if the domain has no tree."""
    cells = _cells(params).filter(F.col("feature") == "")
    at_node = Window.partitionBy("domain", "node")
    order = F.dense_rank().over(Window.partitionBy("domain").orderBy("label")) - 1
    shares = cells.withColumn("prob", F.col("n") / F.sum("n").over(at_node)).withColumn("label_idx", order)
    dist = shares.groupBy("domain", "node").agg(F.array_sort(F.collect_list(F.struct("label_idx", "label", "prob"))).alias("dist"))
    return lookup_join(routed(rows, _splits(params), features), dist, ["domain", "node"], "left", spread=features).drop("node")


# ---- support vector machine ---------------------------------------------------------------------------

ROUNDS, PENALTY = 20, 0.1


def _weights(params: DataFrame, features: list[str]) -> DataFrame:
    """(domain, models): per class its weights, the bias last, as one array per domain."""
    names = [*features, "bias"]
    cells = [F.coalesce(F.max(F.when(F.col("feature") == f, F.col("mean"))), F.lit(0.0)) for f in names]
    wide = params.groupBy("domain", "label").agg(F.array(*cells).alias("w"))
    return wide.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("label", "w"))).alias("models"))


def _margin(w: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def svm_fit(
    rows: DataFrame, features: list[str], stored: DataFrame | None = None, rounds: int = ROUNDS, penalty: float = PENALTY
) -> DataFrame:
    """Parameter rows: the weight of each feature and the bias in ``mean``; the empty feature has the class's rows and the rounds made.

    The number of jobs is that of the rounds, whatever the number of domains.
    """
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], F.lit(1.0))
    data = durable(rows.select("domain", "label", x.alias("x")), "svm-rows")
    own = data.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n"))
    if stored is None:
        start = own.select("domain", "label", "n", F.lit(0.0).alias("made"))
        weights = start.select("domain", "label", F.explode(F.array(*[F.lit(f) for f in [*features, "bias"]])).alias("feature"), F.lit(0.0).alias("mean"))
    else:
        stored = durable(stored.select("domain", "label", "feature", "n", "mean"), "svm-params")
        before = stored.filter(F.col("feature") == TEXTS).select("domain", "label", F.col("n").alias("n_was"), F.col("mean").alias("was"))
        # A class that is new in a domain begins with the round of the others.
        at = before.groupBy("domain").agg(F.max("was").alias("at"))
        start = own.join(before, ["domain", "label"], "full").join(at, "domain", "left").select(
            "domain", "label", (F.coalesce("n", F.lit(0)) + F.coalesce("n_was", F.lit(0))).alias("n"), F.coalesce("was", "at", F.lit(0.0)).alias("made")
        )
        every = start.select("domain", "label", F.explode(F.array(*[F.lit(f) for f in [*features, "bias"]])).alias("feature"))
        weights = every.join(stored.select("domain", "label", "feature", "mean"), ["domain", "label", "feature"], "left").fillna(0.0, ["mean"])
    start, weights = durable(start, "svm-start"), durable(weights, "svm-weights")
    sizes = data.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))
    known = durable(start.groupBy("domain").agg(F.max("made").alias("made")).join(sizes, "domain", "left"), "svm-sizes")
    names = [*features, "bias"]
    for i in range(1, rounds + 1):
        met = lookup_join(data, _weights(weights, features), ["domain"], "inner", spread=["x"])
        each = met.select("domain", F.col("label").alias("truth"), "x", F.inline("models"))
        y = F.when(F.col("truth") == F.col("label"), 1.0).otherwise(-1.0)
        inside = each.withColumn("y", y).filter(F.col("y") * _margin(F.col("w"), F.col("x")) < 1)
        pulls = inside.groupBy("domain", "label").agg(*[F.sum(F.col("y") * F.col("x")[k]).alias(f"_p{k}") for k in range(len(names))])
        long = pulls.select("domain", "label", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_p{k}").alias("pull")) for k, f in enumerate(names)])))
        step = 1 / (F.lit(penalty) * (F.col("made") + i))
        after = (1 - step * penalty) * F.col("mean") + step * F.coalesce("pull", F.lit(0.0)) / F.col("rows")
        # A domain without new rows keeps its weights.
        stepped = weights.join(long, ["domain", "label", "feature"], "left").join(known, "domain")
        weights = durable(stepped.select("domain", "label", "feature", F.when(F.col("rows") > 0, after).otherwise(F.col("mean")).alias("mean")), "svm-weights")
    counted = start.join(known.select("domain", "rows"), "domain").select(
        "domain", "label", F.lit(TEXTS).alias("feature"), "n", (F.col("made") + F.when(F.col("rows") > 0, rounds).otherwise(0)).alias("mean")
    )
    rows_of = start.select("domain", "label", "n")
    return durable(weights.join(rows_of, ["domain", "label"]).select("domain", "label", "feature", "n", "mean").unionByName(counted), "svm-params")


def svm_scores(rows: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``dist``: the margins raised and divided by their sum, in the order of the margins; not calibrated."""
    models = _weights(params.filter(F.col("feature") != TEXTS), features)
    met = lookup_join(rows, models, ["domain"], "left", spread=features)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], F.lit(1.0))
    score = lambda m, i: F.struct(i.alias("label_idx"), m["label"].alias("label"), _margin(m["w"], F.col("_x")).alias("score"))
    staged = met.withColumn("_x", x).withColumn("_s", F.transform("models", score)).withColumn("_e", raised_scores(F.col("_s"), top_of(F.col("_s"), "score")))
    return staged.withColumn("dist", scaled(F.col("_e"), sum_of(F.col("_e"), "prob"))).drop("_x", "_s", "_e", "models")


#: name -> (fit, scores) of the learners of this module.
LEARNERS: dict[str, tuple[Callable[..., DataFrame], Callable[..., DataFrame]]] = {"hoeffding_tree": (tree_fit, tree_scores), "pegasos_svm": (svm_fit, svm_scores)}
