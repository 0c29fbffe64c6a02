"""Composite models: members of any learner gathered, stored as a set, loaded again and asked together.

The parameters of the members lie in a registry of their own below the path; a composite is a row per domain that
names a set of members by an id of the set, so gathering the same members again is recognised.  Members that
learned the same model count as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemill.functions.identity import registry_key, row_digest
from tonemill.functions.text import unnest
from tonemill.operators import bayes, counts, presence
from tonemill.operators.ensemble import best_of
from tonemill.operators.evaluate import row_errors
from tonemill.operators.joins import Lookup, lookup_join, store_lookup
from tonemill.operators.rows import usable_rows, with_domain
from tonemill.operators.vectors import FEATURE_WEIGHTS, FEATURES
from tonemill.plans.training import OF_WORDS, FeatureOptions, TextModel, _described, _terms, _vectors, described_features
from tonemill.session import durable
from tonemill.sources import registry

#: Members of a learner that are scored within one row; a domain with more is scored in several groups.
GROUP = 16

SET_SCHEMA = "registry_key string, combiner string, model_id string, n_rows long, n_members long, generated_on long, domain string"
LIST_SCHEMA = "algorithm string, features string, member string, model_id string, domain string, set_id string"
COMBINERS = ("voting", "best")


@dataclass(frozen=True)
class Kind:
    """All members of one learner with the same features, as parameter rows (domain, member, label, feature, n, mean, m2)."""

    learner: str
    features: FeatureOptions
    params: DataFrame


@dataclass(frozen=True)
class Composite:
    kinds: list[Kind]

    def members(self) -> DataFrame:
        """(domain, n_members)"""
        each = [k.params.select("domain", F.lit(i).alias("kind"), "member") for i, k in enumerate(self.kinds)]
        every = each[0]
        for more in each[1:]:
            every = every.union(more)
        return every.distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("n_members"))


def _kind(model: TextModel) -> Kind:
    if model.params is None:
        raise ValueError(f"{model.learner} has no parameter table to combine")
    params = model.params
    if "model_id" not in params.columns:
        params = params.withColumn("model_id", F.lit("model"))
    for name in ("mean", "m2"):
        if name not in params.columns:
            params = params.withColumn(name, F.lit(None).cast("double"))
    return Kind(model.learner, model.features, params.select("domain", F.col("model_id").alias("member"), "label", "feature", "n", "mean", "m2"))


def composite_of(models: list[TextModel]) -> Composite:
    """Models in hand as members; those of ``train_shards`` carry a ``model_id`` per member."""
    return Composite([_kind(m) for m in models])


def _grouped_members(kind: Kind) -> Lookup:
    """(domain, members): the packed models of a domain in rows of ``GROUP`` members at most."""
    packed = bayes.class_terms(kind.params, FEATURES, ["domain", "member"], FEATURE_WEIGHTS, index_by=["domain"])
    number = F.row_number().over(Window.partitionBy("domain").orderBy("member")) - 1
    placed = packed.withColumn("_group", F.floor(number / GROUP))
    entry = F.struct(F.col("member").alias("model_id"), "classes")
    rows = placed.groupBy("domain", "_group").agg(F.array_sort(F.collect_list(entry)).alias("members"))
    return store_lookup(rows.drop("_group"), "members")


def member_votes(df: DataFrame, composite: Composite, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(key, domain, keep..., kind, member, dist): the class distribution of every text under every member of its domain."""
    keep = keep or []
    rows, columns = with_domain(df), [key, "domain", *keep]
    votes = None
    for i, kind in enumerate(composite.kinds):
        if kind.learner in OF_WORDS:
            asked = lookup_join(_terms(rows, kind.features, key), kind.params.select("domain", "member").distinct(), ["domain"], "inner", spread=[key])
            prepare, score = (counts.prepare_counts, counts.count_scores) if kind.learner == "multinomial_nb" else (presence.prepare_presence, presence.presence_scores)
            model = prepare(kind.params.select("domain", "member", "label", "feature", "n"), ["domain", "member"])
            part = score(asked, model, [key], keep=keep)
        else:
            vectors = _vectors(rows, kind.features, key, ["domain", *keep])
            met = lookup_join(vectors, _grouped_members(kind), ["domain"], "inner", spread=[key])
            each = unnest(bayes.member_distributions(met, FEATURES), F.col("votes"), columns, "_v")
            part = each.select(*columns, F.col("_v.model_id").alias("member"), F.col("_v.dist").alias("dist"))
        part = part.filter(F.col("dist").isNotNull()).select(*columns, F.lit(i).alias("kind"), "member", "dist")
        votes = part if votes is None else votes.union(part)
    return votes


def classify_composite(df: DataFrame, composite: Composite, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(key, domain, keep..., dist, predicted, prob): the mean of all members' class distributions.

    Votes are added up where they arise, so a text is one row per class when it is shuffled, however many members
    there are.  A class that a member never saw has probability 0 with it; a text whose domain has no member
    gets a null class.
    """
    keep = keep or []
    columns = [key, "domain", *keep]
    votes = member_votes(df, composite, key, keep)
    each = unnest(votes, F.col("dist"), columns, "_c").groupBy(*columns, F.col("_c.label").alias("label")).agg(F.sum("_c.prob").alias("prob"))
    sized = store_lookup(composite.members(), "composite-sizes")
    shared = lookup_join(each, sized, ["domain"], "inner", spread=[key]).withColumn("prob", F.col("prob") / F.col("n_members"))
    listed = shared.groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("label", "prob"))).alias("_l"))
    dist = F.transform("_l", lambda x, i: F.struct(i.alias("label_idx"), x["label"].alias("label"), x["prob"].alias("prob")))
    answered = bayes.pick_class(listed.withColumn("dist", dist)).select(*columns, "dist", "predicted", "prob")
    others = lookup_join(with_domain(df).select(columns), sized, ["domain"], "left_anti")
    return answered.unionByName(others, allowMissingColumns=True)


def composite_errors(rows: DataFrame, composite: Composite, key: str = "doc_id") -> DataFrame:
    """(domain, model_id, n, root_mean_sq_err): every member on the labelled rows of its domain, as ``kind/member``."""
    votes = member_votes(usable_rows(rows), composite, key, ["label"])
    _, squared, classes = row_errors(F.col("label"), F.col("dist"))
    named = votes.withColumn("model_id", F.concat_ws("/", "kind", "member"))
    return named.groupBy("domain", "model_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(squared) / F.sum(classes)).alias("root_mean_sq_err"))


def _best_only(composite: Composite, evaluation: DataFrame, key: str) -> Composite:
    best = durable(best_of(composite_errors(evaluation, composite, key)).select("domain", "model_id"), "best-members")
    kept = []
    for i, kind in enumerate(composite.kinds):
        named = kind.params.withColumn("model_id", F.concat_ws("/", F.lit(i).cast("string"), "member"))
        kept.append(Kind(kind.learner, kind.features, named.join(best, ["domain", "model_id"], "left_semi").drop("model_id")))
    return Composite(kept)


def _sets(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/composites/sets", SET_SCHEMA)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def gather(
    models: list[TextModel], path: str, generated_on: int, combiner: str = "voting", domains: DataFrame | None = None,
    evaluation: DataFrame | None = None, key: str = "doc_id",
) -> DataFrame:
    """Store the trained members of every domain as one composite; returns (domain, model_id, n_members, status).

    ``CREATED``: a new set of members; ``EXISTS``: the set is stored already, and becomes the newest again if it is not;
    ``IGNORED``: the domain, one of ``domains`` or of the members, has no trained member.  ``best`` keeps the member
    with the lowest error on the labelled ``evaluation`` rows.  Members are written before the set that names them.
    """
    if combiner not in COMBINERS:
        raise ValueError(f"unknown combiner {combiner!r}; choose from {COMBINERS}")
    spark, root = models[0].params.sparkSession, f"{path}/composites"
    known = composite_of(models)
    if combiner == "best":
        if evaluation is None:
            raise ValueError("the best-of combiner needs labelled rows to choose by")
        known = _best_only(known, with_domain(evaluation), key)
    named = None
    for model, kind in zip(models, known.kinds, strict=True):
        said = _described(model, path)
        saved = registry.save_models(durable(kind.params, "member-params"), root, kind.learner, generated_on, features=said, keys=["domain", "member"])
        part = saved.select("domain", F.lit(kind.learner).alias("algorithm"), F.lit(said).alias("features"), "model_id", "member", "n_rows", "status")
        named = part if named is None else named.unionByName(part)
    named = durable(named, "members")
    trained = named.filter(F.col("status") != registry.IGNORED).groupBy("domain", "algorithm", "features", "model_id")
    distinct = trained.agg(F.min("member").alias("member"), F.max("n_rows").alias("n_rows"))
    digest = F.sum(row_digest([F.col("algorithm"), F.col("features"), F.col("model_id")])).cast("string")
    sets = distinct.groupBy("domain").agg(F.md5(F.concat_ws("|", F.lit(combiner), digest)).alias("model_id"), F.count(F.lit(1)).alias("n_members"), F.sum("n_rows").alias("n_rows"))
    asked = named.select("domain") if domains is None else named.select("domain").union(domains.select("domain"))
    every = asked.distinct().join(sets, "domain", "left").fillna(0, ["n_rows", "n_members"]).fillna("", ["model_id"])
    headers = every.withColumns({
        "combiner": F.lit(combiner), "generated_on": F.lit(generated_on).cast("long"), "registry_key": registry_key(F.lit("composite"), F.col("domain"), F.lit(combiner)),
    })
    status = durable(registry.save_status(headers, _sets(spark, path)), "status")
    fresh = status.filter(F.col("status") == registry.CREATED).select("domain", F.col("model_id").alias("set_id"))
    body = distinct.join(fresh, "domain").select("algorithm", "features", "member", "model_id", "domain", "set_id")
    writer = body.repartition("domain", "set_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("domain", "set_id").parquet(f"{root}/set_members")
    columns = [f.split()[0] for f in SET_SCHEMA.split(", ")]
    new = status.filter((F.col("status") == registry.CREATED) | F.col("_renew")).select(columns)
    new.repartition("domain").write.mode("append").partitionBy("domain").parquet(f"{root}/sets")
    return status.select("domain", "model_id", "n_members", "status")


def load_composite(spark: SparkSession, path: str, combiner: str = "voting", domain: str | None = None) -> Composite:
    """The newest stored composite of every domain, or of one, all of whose members can be read.

    A composite of which a member is damaged is left out, and the one before it answers.
    """
    root = f"{path}/composites"
    sets = _sets(spark, path).filter(F.col("combiner") == combiner)
    lists = _stored(spark, f"{root}/set_members", LIST_SCHEMA)
    params = registry.load_models(spark, root)
    heads = registry.load_headers(spark, root)
    if domain is not None:
        sets, lists, params, heads = (t.filter(F.col("domain") == domain) for t in (sets, lists, params, heads))
    sound = registry.complete_headers(heads, params).select("domain", "model_id").distinct()
    readable = lists.join(sound, ["domain", "model_id"], "left_semi").groupBy("domain", "set_id").agg(F.count(F.lit(1)).alias("_read"))
    whole = sets.join(readable.withColumnRenamed("set_id", "model_id"), ["domain", "model_id"]).filter(F.col("_read") == F.col("n_members")).drop("_read")
    newest = registry.latest_headers(whole).select("domain", F.col("model_id").alias("set_id"))
    chosen = durable(lists.join(newest, ["domain", "set_id"], "left_semi"), "composite-members")
    kinds = []
    for row in chosen.select("algorithm", "features").distinct().orderBy("algorithm", "features").collect():  # a few learners and feature settings
        mine = chosen.filter((F.col("algorithm") == row["algorithm"]) & (F.col("features") == row["features"])).select("domain", "model_id", F.col("model_id").alias("member"))
        body = params.join(mine, ["domain", "model_id"]).select("domain", "member", "label", "feature", "n", "mean", "m2")
        kinds.append(Kind(row["algorithm"], described_features(spark, path, row["features"]), body))
    if not kinds:
        raise ValueError(f"no {combiner} composite at {path}")
    return Composite(kinds)
