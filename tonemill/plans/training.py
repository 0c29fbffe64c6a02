"""Train and classify with options chosen by name."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.functions.identity import row_digest
from tonemill.operators import bayes, counts, increments, mllib, neighbours, presence
from tonemill.operators.ensemble import ensemble
from tonemill.operators.joins import Lookup, as_lookup
from tonemill.operators.rows import usable_rows, with_domain
from tonemill.operators.vectors import FEATURE_WEIGHTS, FEATURES, Tagger, sentiment_vectors
from tonemill.operators.words import information_gain, with_terms
from tonemill.session import durable
from tonemill.sources.lexicon import prepare_lexicon
from tonemill.sources.registry import latest_headers, latest_model, load_headers, save_models

LEARNERS = ["gaussian_nb", "multinomial_nb", "presence_nb", *increments.LEARNERS, "nearest", "local", *mllib.ESTIMATORS]
#: Learners whose models are tables of counts of terms.
OF_WORDS = ("multinomial_nb", "presence_nb")


@dataclass(frozen=True)
class FeatureOptions:
    """How a text becomes features; kept with the model so that scoring does the same."""

    lexicon: DataFrame | Lookup | None = None
    tokenizer: str | Callable[[Column], Column] = "words"
    tagger: Tagger | None = None
    feature_select: bool = True
    lemmas: DataFrame | None = None


@dataclass(frozen=True)
class TextModel:
    """A trained model: a parameter table, or training rows for the lazy learners."""

    learner: str
    features: FeatureOptions
    params: DataFrame | Lookup | counts.CountModel | None = None
    fitted: Any = None
    options: dict = field(default_factory=dict)


def _vectors(df: DataFrame, features: FeatureOptions, key: str, keep: list[str]) -> DataFrame:
    if set(FEATURES) <= set(df.columns):
        return df.select(key, *keep, *FEATURES)
    if features.lexicon is None:
        raise ValueError("sentiment features need a scored lexicon")
    return sentiment_vectors(df, features.lexicon, key, "text", keep, features.tagger)


def with_vectors(df: DataFrame, features: FeatureOptions, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Rows (key, domain, keep..., text) with their sentiment vectors, made and stored once for ``train`` and ``classify``.

    A text is emptied, as it is not read again; a row without one stays without.
    """
    emptied = with_domain(df).withColumn("_text", F.when(F.col("text").isNotNull(), ""))
    made = _vectors(emptied, features, key, ["domain", *(keep or []), "_text"])
    return durable(made.withColumnRenamed("_text", "text"), "vectors")


def _terms(df: DataFrame, features: FeatureOptions, key: str) -> DataFrame:
    return with_terms(df, features.tokenizer, lemmas=features.lemmas, key=key)


def train(
    df: DataFrame, learner: str | Any = "gaussian_nb", features: FeatureOptions | None = None,
    key: str = "doc_id", **options,
) -> TextModel:
    """Train on rows (key, domain, text, label); one model per domain."""
    features = features or FeatureOptions()
    rows = with_domain(usable_rows(df))
    if learner == "multinomial_nb":
        words = durable(_terms(rows, features, key), "terms") if features.feature_select else _terms(rows, features, key)
        stats = counts.count_fit(words, by=["domain"])
        if features.feature_select:
            # Each domain selects its own terms; the counts of texts stand under the empty feature.
            kept = information_gain(words, by=["domain"]).select("domain", F.col("term").alias("feature"))
            texts = kept.select("domain").union(words.select("domain")).distinct().withColumn("feature", F.lit(counts.TEXTS))
            stats = stats.join(kept.union(texts), ["domain", "feature"], "left_semi").select("domain", "label", "feature", "n")
        return TextModel(learner, features, params=stats, options=options)
    if learner == "presence_nb":
        stats = presence.presence_fit(_terms(rows, features, key), ["domain"])
        if features.feature_select:
            stats = presence.select_counts(durable(stats, "presence"), ["domain"])
        return TextModel(learner, features, params=stats, options=options)
    vectors = _vectors(rows, features, key, ["domain", "label"])
    if learner == "gaussian_nb":
        return TextModel(learner, features, params=bayes.gaussian_fit(vectors, FEATURES, ["domain"]), options=options)
    if learner in increments.LEARNERS:
        return TextModel(learner, features, params=increments.LEARNERS[learner][0](vectors, FEATURES, **options), options=options)
    vectors = durable(vectors, "training-vectors")
    if learner in ("nearest", "local"):
        return TextModel(learner, features, fitted=vectors, options=options)
    name = learner if isinstance(learner, str) else type(learner).__name__
    fitted = {
        d: mllib.fit_estimator(vectors.filter(F.col("domain") == d), FEATURES, learner, **options) for d in domains_of(vectors)
    }
    return TextModel(name, features, fitted=fitted)


def domains_of(rows: DataFrame) -> list[str]:
    """The domains of training rows: each has a model of its own, so there are few."""
    return [r["domain"] for r in rows.select("domain").distinct().orderBy("domain").collect()]


def classify(df: DataFrame, model: TextModel, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Score rows (key, domain, text) with the features the model was trained on.

    Every learner answers with the model of the row's domain; a row whose domain has none
    gets a null class.  The double weight of the overall score holds for the Gaussian and the local learner.
    """
    keep = keep or []
    rows = with_domain(df)
    if model.learner == "multinomial_nb":
        words = _terms(rows, model.features, key)
        return counts.count_scores(words, prepare_model(model).params, [key], keep=keep)
    if model.learner == "presence_nb":
        return presence.presence_scores(_terms(rows, model.features, key), prepare_model(model).params, [key], keep=keep)
    vectors = _vectors(rows, model.features, key, ["domain", *keep])
    if model.learner == "gaussian_nb":
        return bayes.classify_vectors(vectors, model.params, FEATURES, FEATURE_WEIGHTS, spread=[key])
    if model.learner in increments.LEARNERS:
        return bayes.pick_class(increments.LEARNERS[model.learner][1](vectors, model.params, FEATURES))
    if model.learner == "local":
        shown = list(dict.fromkeys(["domain", *keep]))
        return neighbours.classify_local(vectors, model.fitted, FEATURES, key, weights=FEATURE_WEIGHTS, by="domain", keep=shown)
    vectors = durable(vectors, "scoring-vectors")
    lazy = model.learner == "nearest"
    known = domains_of(model.fitted) if lazy else sorted(model.fitted)
    answers = vectors.filter(~F.col("domain").isin(known)).withColumn("predicted", F.lit(None).cast("string"))
    for domain in known:
        asked = vectors.filter(F.col("domain") == domain)
        if lazy:
            trained = model.fitted.filter(F.col("domain") == domain)
            part = _nearest_answers(asked, trained, model, key)
        else:
            part = mllib.apply_estimator(model.fitted[domain], asked)
        answers = answers.unionByName(part, allowMissingColumns=True)
    return answers


def prepare_model(model: TextModel) -> TextModel:
    """The model with its parameters in the stored scoring form, to ask it several times; one that has it already stays."""
    if not isinstance(model.params, DataFrame) or model.learner in increments.LEARNERS:
        return model
    if model.learner == "multinomial_nb":
        return replace(model, params=counts.prepare_counts(model.params, ["domain"]))
    if model.learner == "presence_nb":
        return replace(model, params=presence.prepare_presence(model.params, ["domain"]))
    return replace(model, params=bayes.prepare_members(model.params, FEATURES, FEATURE_WEIGHTS))


def _nearest_answers(asked: DataFrame, trained: DataFrame, model: TextModel, key: str) -> DataFrame:
    """The class of the nearest training rows of one domain."""
    as_vector = lambda d: d.withColumn("vector", F.array(*FEATURES))
    voted = neighbours.classify_nearest(as_vector(asked), as_vector(trained), model.options.get("k", 1), key)
    return asked.join(voted, key)


def train_shards(
    df: DataFrame, shard: str, features: FeatureOptions | None = None, key: str = "doc_id"
) -> DataFrame:
    """One Gaussian model per domain and shard, all in one aggregation.

    Returns member rows (domain, model_id, label, feature, n, mean, m2), with the
    shard as the model's id, for the combiners.
    """
    features = features or FeatureOptions()
    rows = with_domain(usable_rows(df)).withColumn("model_id", F.col(shard).cast("string"))
    vectors = _vectors(rows, features, key, ["domain", "label", "model_id"])
    return bayes.gaussian_fit(vectors, FEATURES, ["domain", "model_id"])


def classify_combined(
    df: DataFrame, members: DataFrame, features: FeatureOptions, combiner: str = "voting",
    evaluation: DataFrame | None = None, key: str = "doc_id", keep: list[str] | None = None,
) -> DataFrame:
    """Score texts with the combined members of their domain.

    The best-of combiner takes labelled texts (key, domain, text, label) to choose by.
    """
    tested = None
    if evaluation is not None:
        tested = _vectors(with_domain(usable_rows(evaluation)), features, key, ["domain", "label"])
    chosen = ensemble(members, combiner, tested, FEATURES, FEATURE_WEIGHTS)
    packed = bayes.prepare_members(chosen, FEATURES, FEATURE_WEIGHTS, member="model_id")
    vectors = _vectors(with_domain(df), features, key, ["domain", *(keep or [])])
    return bayes.classify_vectors(vectors, packed, FEATURES, spread=[key])


def _described(model: TextModel, path: str) -> str:
    """The features of a model as text for its header; the lexicon is stored beside the models, once."""
    f = model.features
    if not isinstance(f.tokenizer, str) or f.tagger is not None or f.lemmas is not None:
        raise ValueError("tokenizers and taggers given as functions, and lemma tables, cannot be stored with a model")
    said: dict[str, Any] = {"tokenizer": f.tokenizer, "feature_select": f.feature_select, "lexicon": None}
    if model.learner not in OF_WORDS:
        prepared = f.lexicon if isinstance(f.lexicon, Lookup) else prepare_lexicon(f.lexicon)
        table = prepared.table
        cells = F.sum(row_digest([F.col(c).cast("string") for c in sorted(table.columns)]))
        said["lexicon"] = str(table.agg(cells.alias("d")).first()["d"])
        table.write.mode("ignore").parquet(f"{path}/lexicons/{said['lexicon']}")
    return json.dumps(said, sort_keys=True)


def described_features(spark: SparkSession, path: str, described: str) -> FeatureOptions:
    """The features that a header describes."""
    said = json.loads(described)
    lexicon = as_lookup(spark.read.parquet(f"{path}/lexicons/{said['lexicon']}")) if said["lexicon"] else None
    return FeatureOptions(lexicon=lexicon, tokenizer=said["tokenizer"], feature_select=said["feature_select"])


def load_model(spark: SparkSession, path: str, learner: str = "gaussian_nb", domain: str | None = None) -> TextModel:
    """The newest stored models of a learner, ready for ``classify``, with the features they were trained on."""
    headers = load_headers(spark, path).filter(F.col("algorithm") == learner)
    if domain is not None:
        headers = headers.filter(F.col("domain") == domain)
    kinds = [r["features"] for r in latest_headers(headers).select("features").distinct().limit(2).collect()]
    if len(kinds) != 1:
        raise ValueError(f"{'no model' if not kinds else 'models of different features'} of {learner} at {path}; name a domain")
    options = described_features(spark, path, kinds[0])
    names = ["domain", "label", "feature", "n", *([] if learner in OF_WORDS else ["mean", "m2"])]
    return TextModel(learner, options, params=latest_model(spark, path, domain, learner).select(*names))


def build(
    df: DataFrame, path: str, generated_on: int, learner: str = "gaussian_nb",
    features: FeatureOptions | None = None, key: str = "doc_id",
) -> DataFrame:
    """Train and append to the registry; returns the save status of each domain."""
    model = train(df, learner, features, key)
    if model.params is None:
        raise ValueError(f"{learner} has no parameter table to store")
    return save_models(model.params, path, learner, generated_on, features=_described(model, path))


def rebuild(
    df: DataFrame, path: str, generated_on: int, learner: str = "gaussian_nb",
    features: FeatureOptions | None = None, key: str = "doc_id",
) -> DataFrame:
    """Train on everything at once; the new model replaces earlier ones as the latest of its key."""
    return build(df, path, generated_on, learner, features, key)


def increment(
    df: DataFrame, path: str, generated_on: int, features: FeatureOptions | None = None, key: str = "doc_id",
    latest: DataFrame | None = None, learner: str = "gaussian_nb",
) -> DataFrame:
    """Train on new rows only and merge with the stored model of each domain.

    With selected terms the first model of a domain fixes its vocabulary; later rows add
    to the counts of the terms it has.
    """
    features = features or FeatureOptions()
    spark = df.sparkSession
    stored = latest if latest is not None else latest_model(spark, path, algorithm=learner)
    if learner in OF_WORDS:
        stored = stored.select("domain", "label", "feature", "n")
        every = train(df, learner, replace(features, feature_select=False), key)
        new = every.params
        if features.feature_select:
            fixed = stored.select("domain").distinct()
            first = train(df, learner, features, key).params.join(fixed, "domain", "left_anti")
            known = stored.select("domain", "feature").distinct()
            new = new.join(known, ["domain", "feature"], "left_semi").select("domain", "label", "feature", "n").unionByName(first)
        merged = counts.merge_counts(stored.unionByName(new), ["domain"])
        return save_models(merged, path, learner, generated_on, features=_described(every if not features.feature_select else replace(every, features=features), path))
    if learner in increments.LEARNERS:
        vectors = _vectors(with_domain(usable_rows(df)), features, key, ["domain", "label"])
        params = increments.LEARNERS[learner][0](vectors, FEATURES, stored if stored.limit(1).count() else None)
        return save_models(params, path, learner, generated_on, features=_described(TextModel(learner, features), path))
    if learner != "gaussian_nb":
        raise ValueError(f"{learner} cannot be trained by increments")
    model = train(df, learner, features, key)
    merged = bayes.merge_gaussian(
        stored.select("domain", "label", "feature", "n", "mean", "m2").unionByName(model.params), ["domain"]
    )
    return save_models(merged, path, learner, generated_on, features=_described(model, path))


#: The learner of requests by their ``use_sentiment_vector``.
REQUESTED = {True: "gaussian_nb", False: "presence_nb"}


def build_requests(
    rows: DataFrame, path: str, generated_on: int, features: FeatureOptions, key: str = "doc_id", increments: bool = False
) -> DataFrame:
    """Train on rows of training requests, each row with the features its request asks for.

    Rows are (key, domain, use_sentiment_vector, text, label), as ``split_requests`` gives them.  Both kinds of models
    are stored beside each other; the answer is the save status of every one.
    """
    step = increment if increments else build
    saved = [
        step(rows.filter(_asks_for(asked)), path, generated_on, features=features, key=key, learner=learner).withColumn("learner", F.lit(learner))
        for asked, learner in REQUESTED.items()
    ]
    return saved[0].unionByName(saved[1])


def classify_requests(rows: DataFrame, path: str, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Label the rows of requests (key, domain, use_sentiment_vector, text) with the newest stored models of their kind.

    The answer is (key, domain, keep..., use_sentiment_vector, predicted, prob); a kind without any model gives null classes.
    """
    spark, keep = rows.sparkSession, keep or []
    columns = [key, "domain", *keep]
    answers = []
    for asked, learner in REQUESTED.items():
        mine = rows.filter(_asks_for(asked))
        if load_headers(spark, path).filter(F.col("algorithm") == learner).limit(1).count():
            scored = classify(mine, load_model(spark, path, learner), key, keep)
        else:
            scored = with_domain(mine).withColumns({"predicted": F.lit(None).cast("string"), "prob": F.lit(None).cast("double")})
        answers.append(scored.select(*columns, F.lit(asked).alias("use_sentiment_vector"), "predicted", "prob"))
    return answers[0].union(answers[1])


def _asks_for(asked: bool) -> Column:
    return F.coalesce(F.col("use_sentiment_vector"), F.lit(True)) == asked
