"""Registered queries: the model registry, shard models and their combination."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.operators import bayes, ensemble, evaluate, rows
from tonemill.operators.vectors import FEATURE_WEIGHTS, FEATURES
from tonemill.plans.queries_text import MULTINOMIAL, PRESENCE_BEST, presence_sql  # its oracles are used here as well
from tonemill.plans import composites
from tonemill.plans import training as plans
from tonemill.plans.fixtures import (
    ARGMAX, LABELS, MEASURES, ORACLES, ROUNDED_MEASURES, TRAINING, documents, gaussian_sql, labelled_texts, lexicon, measures_sql,
    melted, query, training,
)
from tonemill.session import durable, scratch
from tonemill.sources import registry, requests

CHUNK = 50


def _rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- ids and registry -------------------------------------------------------------------------

# One parameter row as text, its digest as a number, and the id of a model.
_CELL = """label || '|' || feature || '|' || CAST(CAST(round(n, 6) AS DECIMAL(28,6)) AS VARCHAR) || '|' ||
  CAST(CAST(round(mean, 6) AS DECIMAL(28,6)) AS VARCHAR) || '|' || CAST(CAST(round(m2, 6) AS DECIMAL(28,6)) AS VARCHAR)"""


def ids_sql(params: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n_params, CAST(sum(n) FILTER (feature = 'score_all') AS BIGINT) AS n_rows,
  md5('gaussian_nb|' || CAST(sum(CAST('0x' || substring(md5({_CELL}), 1, 12) AS BIGINT)) AS VARCHAR) || '|' || count(*)) AS model_id
  FROM {params} GROUP BY ALL"""


_PARAMS = f"""{TRAINING}, long AS ({melted("train", "domain, label")}),
params AS (SELECT domain, label, feature, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS m2 FROM long GROUP BY ALL)"""


@query("f12_model_identity", f"WITH {_PARAMS} {ids_sql('params', 'domain')}")
def f12(spark, sf):
    params = durable(bayes.gaussian_fit(training(spark, sf), FEATURES, ["domain"]), "params")
    return registry.headers_of(params, "gaussian_nb").select("domain", "n_params", "n_rows", "model_id")


_VERSIONS = f"""{TRAINING},
chunked AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY doc_id) - 1) // {CHUNK} AS version FROM train),
long AS ({melted("chunked", "domain, version, label")}),
params AS (SELECT domain, version, label, feature, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS m2
           FROM long GROUP BY ALL),
headers AS ({ids_sql("params", "domain, version")})"""


def versions(spark, sf, made: DataFrame | None = None) -> DataFrame:
    """(domain, version, ...): a model of every chunk of the labelled texts of a language, which may be ``made`` already."""
    made = durable(training(spark, sf), "training") if made is None else made
    chunked = rows.chunks(made, CHUNK, ["domain"], "doc_id").withColumnRenamed("chunk", "version")
    return durable(bayes.gaussian_fit(chunked, FEATURES, ["domain", "version"]), "params")


def version_headers(params: DataFrame) -> DataFrame:
    made = registry.headers_of(params, "gaussian_nb", keys=["domain", "version"])
    return made.withColumn("generated_on", F.col("version").cast("long"))


@query("w2_latest_models", f"""WITH {_VERSIONS}
  SELECT 'gaussian_nb-' || domain || '-voting' AS registry_key, model_id, version AS generated_on, n_rows FROM headers
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY version DESC, model_id DESC) = 1""")
def w2(spark, sf):
    headers = version_headers(versions(spark, sf))
    return registry.latest_headers(headers).select("registry_key", "model_id", "generated_on", "n_rows")


@query("j6_new_models", f"""WITH {_VERSIONS},
  stored AS (SELECT model_id FROM headers WHERE version = 0)
  SELECT domain, version, model_id FROM headers ANTI JOIN stored USING (model_id)""")
def j6(spark, sf):
    """The first version of every language is stored; the others are new."""
    headers = durable(version_headers(versions(spark, sf)), "headers")
    stored = headers.filter(F.col("version") == 0)
    return registry.new_headers(headers, stored).select("domain", "version", "model_id")


@query("j6_save_status", f"""WITH {_VERSIONS}
  SELECT domain, version, model_id, CASE WHEN version = 0 THEN 'EXISTS' ELSE 'CREATED' END AS status FROM headers""")
def j6_status(spark, sf):
    """Save the first versions, then offer all of them to the registry."""
    path = scratch(spark, "registry")
    params = versions(spark, sf)
    first = params.filter(F.col("version") == 0)
    registry.save_models(first, path, "gaussian_nb", 0, keys=["domain", "version"])
    status = registry.save_models(params, path, "gaussian_nb", 1, keys=["domain", "version"])
    return status.select("domain", "version", "model_id", "status")


@query("s9_model_save", f"""WITH {_PARAMS}, ids AS ({ids_sql('params', 'domain')})
  SELECT domain, model_id, label, feature, n, round(mean, 6) AS mean, round(m2, 6) AS m2 FROM params JOIN ids USING (domain)""")
def s9(spark, sf):
    path = scratch(spark, "registry")
    params = durable(bayes.gaussian_fit(training(spark, sf), FEATURES, ["domain"]), "params")
    registry.save_models(params, path, "gaussian_nb", 1)
    stored = registry.load_models(spark, path)
    return _rounded(stored, ["mean", "m2"]).select("domain", "model_id", "label", "feature", "n", "mean", "m2")


@query("s9_model_export", f"""WITH {_PARAMS} SELECT domain, label, feature, n, round(mean, 6) AS mean FROM params""")
def s9_export(spark, sf):
    """Export the parameters as JSON text and read the text back."""
    params = bayes.gaussian_fit(training(spark, sf), FEATURES, ["domain"])
    path = scratch(spark, "export")
    registry.export_json(params).write.partitionBy("domain").text(path)
    back = spark.read.schema("domain string, label string, feature string, n long, mean double").json(f"{path}/*")
    return _rounded(back, ["mean"])


@query("s10_model_resume", f"""WITH {_VERSIONS},
  last AS (SELECT domain, model_id, version FROM headers
           QUALIFY row_number() OVER (PARTITION BY domain ORDER BY version DESC, model_id DESC) = 1)
  SELECT domain, model_id, label, feature, n, round(mean, 6) AS mean FROM params JOIN last USING (domain, version)""")
def s10(spark, sf):
    """Save the first versions, then all later ones, and load the newest of each language."""
    path = scratch(spark, "registry")
    params, keys = versions(spark, sf), ["domain", "version"]
    for part in (params.filter(F.col("version") == 0), params.filter(F.col("version") > 0)):
        registry.save_models(part, path, "gaussian_nb", F.col("version"), keys=keys)
    newest = registry.latest_model(spark, path)
    return _rounded(newest, ["mean"]).select("domain", "model_id", "label", "feature", "n", "mean")


@query("a11_rebuild", f"""WITH {_PARAMS}, ids AS ({ids_sql('params', 'domain')})
  SELECT domain, model_id, label, feature, n, round(mean, 6) AS mean FROM params JOIN ids USING (domain)""")
def a11(spark, sf):
    """A first model of the first chunks, then a full rebuild that takes its place."""
    path = scratch(spark, "registry")
    first = versions(spark, sf).filter(F.col("version") == 0).drop("version")
    registry.save_models(first, path, "gaussian_nb", 1)
    texts = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    plans.rebuild(texts, path, 2, features=plans.FeatureOptions(lexicon=lexicon(spark)))
    newest = registry.latest_model(spark, path)
    return _rounded(newest, ["mean"]).select("domain", "model_id", "label", "feature", "n", "mean")


@query("j6_equal_models_two_domains", f"""WITH {_PARAMS}, ids AS ({ids_sql('params', 'domain')}),
  twice AS (SELECT domain AS source, domain FROM ids UNION ALL SELECT domain, domain || '-copy' FROM ids)
  SELECT t.domain, model_id, label, feature, n, round(mean, 6) AS mean, 'CREATED' AS status
  FROM twice t JOIN ids ON ids.domain = t.source JOIN params ON params.domain = t.source""")
def j6_equal(spark, sf):
    """Two domains with equal parameters, saved at once, are two models."""
    path = scratch(spark, "registry")
    params = durable(bayes.gaussian_fit(training(spark, sf), FEATURES, ["domain"]), "params")
    both = params.union(params.withColumn("domain", F.concat("domain", F.lit("-copy"))))
    status = registry.save_models(both, path, "gaussian_nb", 1).select("domain", "status")
    found = _rounded(registry.latest_model(spark, path), ["mean"])
    return found.join(status, "domain").select("domain", "model_id", "label", "feature", "n", "mean", "status")


@query("a11_rebuild_back", f"""WITH {_VERSIONS}
  SELECT domain, model_id, label, feature, n, round(mean, 6) AS mean FROM params JOIN headers USING (domain, version) WHERE version = 0""")
def a11_back(spark, sf):
    """A first model, another one, and the first again: the first is the newest."""
    path, made = scratch(spark, "registry"), durable(training(spark, sf), "training")
    first = versions(spark, sf, made).filter(F.col("version") == 0).drop("version")
    other = bayes.gaussian_fit(made, FEATURES, ["domain"])
    for time, params in enumerate((first, other, first), 1):
        registry.save_models(params, path, "gaussian_nb", time)
    newest = registry.latest_model(spark, path)
    return _rounded(newest, ["mean"]).select("domain", "model_id", "label", "feature", "n", "mean")


@query("a11_increment", f"""WITH {_PARAMS}
  SELECT domain, label, feature, n, round(mean, 6) AS mean, round(m2, 6) AS m2 FROM params""")
def a11_increment(spark, sf):
    """Train on the texts of some sources, then add those of the others to the stored model."""
    path = scratch(spark, "registry")
    texts = labelled_texts(spark, sf, ["lang", "source"]).withColumnRenamed("lang", "domain")
    early = F.col("source") < "src2"
    options = plans.FeatureOptions(lexicon=lexicon(spark))
    plans.build(texts.filter(early), path, 1, features=options)
    plans.increment(texts.filter(~early), path, 2, features=options)
    newest = registry.latest_model(spark, path)
    return _rounded(newest, ["mean", "m2"]).select("domain", "label", "feature", "n", "mean", "m2")


def _resumed(spark, sf, learner: str, options: plans.FeatureOptions) -> DataFrame:
    """Build, store, load again with nothing but the path, and label every document."""
    path = scratch(spark, "registry")
    texts = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    plans.build(texts, path, 1, learner, options)
    every = documents(spark, sf).select("doc_id", F.col("lang").alias("domain"), "text")
    answers = plans.classify(every, plans.load_model(spark, path, learner))
    return answers.select("doc_id", "predicted", F.round("prob", 6).alias("prob"))


@query("e3_registry_classify", f"""WITH {TRAINING}, {gaussian_sql("train", "vd", ["domain"], ["doc_id", "domain"])
  .replace("FROM vd", "FROM (SELECT *, lang AS domain FROM vec)")}
  SELECT doc_id, {ARGMAX} AS predicted, round(max(prob), 6) AS prob FROM probs GROUP BY doc_id""")
def e3(spark, sf):
    return _resumed(spark, sf, "gaussian_nb", plans.FeatureOptions(lexicon=lexicon(spark)))


@query("e3_registry_classify_words", ORACLES["a8_multinomial_classify"])
def e3_words(spark, sf):
    return _resumed(spark, sf, "multinomial_nb", plans.FeatureOptions(feature_select=False))


@query("a8_increment", ORACLES["a8_multinomial_fit"])
def a8_increment(spark, sf):
    """Word counts of some sources, then those of the others added to the stored model."""
    path = scratch(spark, "registry")
    texts = labelled_texts(spark, sf, ["lang", "source"]).withColumnRenamed("lang", "domain")
    early, options = F.col("source") < "src2", plans.FeatureOptions(feature_select=False)
    plans.build(texts.filter(early), path, 1, "multinomial_nb", options)
    plans.increment(texts.filter(~early), path, 2, options, learner="multinomial_nb")
    return registry.latest_model(spark, path).select("domain", "label", "feature", "n")


_BY_SOURCE = f"""WITH {TRAINING}, mine AS (SELECT * FROM train WHERE source >= 'src2'),
  {gaussian_sql("mine", "vd", ["domain"], ["doc_id", "domain"]).replace("FROM vd", "FROM (SELECT *, lang AS domain FROM vec WHERE source >= 'src2')")},
  {presence_sql("source < 'src2'", "w_")}
  SELECT doc_id, domain, TRUE AS use_sentiment_vector, {ARGMAX} AS predicted, round(max(prob), 6) AS prob FROM probs GROUP BY doc_id, domain
  UNION ALL SELECT doc_id, domain, FALSE, {PRESENCE_BEST} FROM w_pr GROUP BY doc_id, domain"""


@query("x2_request_features", _BY_SOURCE)
def x2_requests(spark, sf):
    """Requests choose between sentiment vectors and selected words, in training and in scoring; here by their source."""
    path, wants = scratch(spark, "registry"), F.col("source") >= "src2"
    texts = labelled_texts(spark, sf, ["lang", "source"])
    body = F.struct(
        F.col("lang").alias("domain"), F.array(F.lit("neg"), F.lit("pos")).alias("classes"),
        F.array(F.struct("text", F.col("label").alias("textClass"))).alias("dataSet"), wants.alias("useSentimentVector"),
    )
    rows_, _ = requests.split_requests(texts.select("doc_id", F.to_json(body).alias("value")), keep=["doc_id"])
    plans.build_requests(rows_, path, 1, plans.FeatureOptions(lexicon=lexicon(spark)))
    asked = documents(spark, sf).select("doc_id", F.col("lang").alias("domain"), "text", wants.alias("use_sentiment_vector"))
    answers = plans.classify_requests(asked, path)
    return answers.select("doc_id", "domain", "use_sentiment_vector", "predicted", F.round("prob", 6).alias("prob"))


# ---- shard models -----------------------------------------------------------------------------

_MEMBERS = f"""{TRAINING.replace("lang AS domain FROM vec", "'$DEF' AS domain, source AS model_id FROM vec")},
  {gaussian_sql("train", "train", ["domain", "model_id"], ["doc_id", "domain"])}"""

_VOTED = f"""{_MEMBERS},
  nm AS (SELECT count(DISTINCT model_id) AS k FROM train),
  voted AS (SELECT doc_id, label, sum(prob) / any_value(k) AS prob FROM probs, nm GROUP BY doc_id, label),
  best AS (SELECT doc_id, {ARGMAX} AS predicted, max(prob) AS top FROM voted GROUP BY doc_id)"""


def members(spark, sf, made: DataFrame) -> DataFrame:
    """One model per source, all of the default domain."""
    return durable(bayes.gaussian_fit(made, FEATURES, ["domain", "model_id"]), "params")


def member_rows(spark, sf) -> DataFrame:
    made = training(spark, sf, "source").withColumn("model_id", F.col("source"))
    return durable(made.withColumn("domain", F.lit("$DEF")), "training")


@query("a12_voting", f"WITH {_VOTED} SELECT doc_id, predicted, round(top, 6) AS prob FROM best")
def a12(spark, sf):
    made = member_rows(spark, sf)
    voting = ensemble.ensemble(members(spark, sf, made), "voting")
    packed = bayes.prepare_members(voting, FEATURES, FEATURE_WEIGHTS, member="model_id")
    scored = bayes.classify_vectors(made, packed, FEATURES, spread=["doc_id"])
    return scored.select("doc_id", "predicted", F.round("prob", 6).alias("prob"))


_ERRORS = """cls AS (SELECT DISTINCT label FROM train),
  errs AS (SELECT p.domain, p.model_id, count(DISTINCT p.doc_id) AS n,
    sqrt(sum(power(p.prob - (p.label = t.label)::INT, 2)
             + CASE WHEN p.label = p.first AND NOT list_contains(p.known, t.label) THEN 1 ELSE 0 END) / count(*)) AS root_mean_sq_err
  FROM (SELECT *, min(label) OVER (PARTITION BY model_id, doc_id) AS first,
               list(label) OVER (PARTITION BY model_id, doc_id) AS known FROM probs) p
  JOIN train t USING (doc_id) GROUP BY ALL)"""


@query("a13_member_errors", f"""WITH {_MEMBERS}, {_ERRORS}
  SELECT domain, model_id, n, round(root_mean_sq_err, 6) AS root_mean_sq_err FROM errs""")
def a13_errors(spark, sf):
    made = member_rows(spark, sf)
    errors = ensemble.member_errors(
        made.drop("model_id"), members(spark, sf, made), FEATURES, FEATURE_WEIGHTS, spread=["doc_id"]
    )
    return _rounded(errors, ["root_mean_sq_err"])


@query("a13_best_member", f"""WITH {_MEMBERS}, {_ERRORS}
  SELECT domain, model_id, round(root_mean_sq_err, 6) AS root_mean_sq_err FROM errs
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY round(root_mean_sq_err, 9), model_id) = 1""")
def a13(spark, sf):
    made = member_rows(spark, sf)
    errors = ensemble.member_errors(
        made.drop("model_id"), members(spark, sf, made), FEATURES, FEATURE_WEIGHTS, spread=["doc_id"]
    )
    return _rounded(ensemble.best_of(errors), ["root_mean_sq_err"])


@query("x3_combiner_best", f"""WITH {_MEMBERS}, {_ERRORS},
  win AS (SELECT domain, model_id FROM errs
          QUALIFY row_number() OVER (PARTITION BY domain ORDER BY round(root_mean_sq_err, 9), model_id) = 1),
  best AS (SELECT doc_id, {ARGMAX} AS predicted, max(prob) AS top FROM probs SEMI JOIN win USING (domain, model_id) GROUP BY doc_id)
  SELECT doc_id, predicted, round(top, 6) AS prob FROM best""")
def x3(spark, sf):
    """The combiner is chosen by name; here the shard model with the lowest error answers."""
    # All sources carry the same prefix, so there is one domain.
    texts = labelled_texts(spark, sf, ["source"]).withColumn("domain", F.regexp_extract("source", "^[a-z]+", 0))
    options = plans.FeatureOptions(lexicon=lexicon(spark))
    shards = durable(plans.train_shards(texts, "source", options), "params")
    scored = plans.classify_combined(texts, shards, options, "best", texts)
    return scored.select("doc_id", "predicted", F.round("prob", 6).alias("prob"))


@query("x3_voting_measures", f"""WITH {_VOTED},
  scored AS (SELECT doc_id, domain, label, predicted FROM train JOIN best USING (doc_id)),
  {measures_sql("voted", "scored", ["domain"])} SELECT domain, n, {ROUNDED_MEASURES} FROM measures""")
def x3_measures(spark, sf):
    made = member_rows(spark, sf)
    packed = bayes.prepare_members(members(spark, sf, made), FEATURES, FEATURE_WEIGHTS, member="model_id")
    scored = bayes.classify_vectors(made, packed, FEATURES, spread=["doc_id"])
    return _rounded(evaluate.evaluate(scored, ["domain"]).drop("n_unscored"), MEASURES)


_SHARD_PARAMS = f"""{TRAINING.replace("lang AS domain FROM vec", "'$DEF' AS domain, source AS model_id FROM vec")},
  long AS ({melted("train", "domain, model_id, label")}),
  params AS (SELECT domain, model_id, label, feature, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS m2
             FROM long GROUP BY ALL)"""


@query("u1_union_members", f"""WITH {_SHARD_PARAMS}
  SELECT model_id, label, feature, n, round(mean, 6) AS mean FROM params""")
def u1(spark, sf):
    """Snapshots of two builders that share members: each member once."""
    made = members(spark, sf, member_rows(spark, sf))
    english = made.filter(~F.col("model_id").endswith("9"))
    merged = ensemble.union_members(english, made)
    return _rounded(merged, ["mean"]).select("model_id", "label", "feature", "n", "mean")


@query("u2_identical_models", f"""WITH {_SHARD_PARAMS},
  ids AS ({ids_sql("params", "domain, model_id AS member").replace("GROUP BY ALL", "GROUP BY domain, member")})
  SELECT model_id, min(member) AS member, count(*) AS copies FROM ids GROUP BY model_id""")
def u2(spark, sf):
    """Shards that learned the same model count as one."""
    made = members(spark, sf, member_rows(spark, sf)).withColumnRenamed("model_id", "member")
    headers = registry.headers_of(made, "gaussian_nb", keys=["domain", "member"])
    return headers.groupBy("model_id").agg(F.min("member").alias("member"), F.count(F.lit(1)).alias("copies"))


@query("r3_trained_models", f"""WITH {_SHARD_PARAMS},
  every AS (SELECT DISTINCT source AS model_id FROM documents)
  SELECT model_id, n_rows FROM every JOIN (SELECT model_id, CAST(sum(n) AS BIGINT) AS n_rows FROM params
    WHERE feature = 'score_all' GROUP BY model_id) USING (model_id)""")
def r3(spark, sf):
    """Members without a training row are left out of the combination."""
    made = member_rows(spark, sf)
    sources = members(spark, sf, made)
    untrained = sources.select("domain", F.concat("model_id", F.lit("-new")).alias("model_id"), "label", "feature",
                               F.lit(0).cast("long").alias("n"), "mean", "m2")
    kept = ensemble.check_trained(sources.unionByName(untrained)).filter(F.col("feature") == "score_all")
    return kept.groupBy("model_id").agg(F.sum("n").alias("n_rows"))


# ---- learners by name ----------------------------------------------------------------------------


@query("x1_learner_by_name", f"""WITH {TRAINING}, {gaussian_sql("train", "vd", ["domain"], ["doc_id", "domain"])
  .replace("FROM vd", "FROM (SELECT *, lang AS domain FROM vec)")}
  SELECT doc_id, domain, {ARGMAX} AS predicted, round(max(prob), 6) AS prob FROM probs GROUP BY doc_id, domain""")
def x1(spark, sf):
    """Train by learner name on the labelled texts and label every document."""
    texts = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    model = plans.train(texts, "gaussian_nb", plans.FeatureOptions(lexicon=lexicon(spark)))
    every = documents(spark, sf).select("doc_id", F.col("lang").alias("domain"), "text")
    answers = plans.classify(every, model)
    return answers.select("doc_id", "domain", "predicted", F.round("prob", 6).alias("prob"))


# ---- composite models of several learners --------------------------------------------------------

# Shards are sources of a language; those that learned the same model count as one.
_GATHERED = f"""{TRAINING.replace("lang AS domain FROM vec", "lang AS domain, source AS member FROM vec")},
  params AS (SELECT domain, member, label, feature, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS m2
             FROM ({melted("train", "domain, member, label")}) GROUP BY ALL),
  ids AS ({ids_sql("params", "domain, member")}),
  firsts AS (SELECT domain, min(member) AS member FROM ids GROUP BY domain, model_id),
  shards AS (SELECT domain, count(*) AS n FROM firsts GROUP BY domain)"""


def _gathered_models(spark, sf) -> list[plans.TextModel]:
    """Sentiment vectors by shard, word counts and selected words, per language; trained once, however often they are gathered."""
    texts = labelled_texts(spark, sf, ["lang", "source"]).withColumnRenamed("lang", "domain")
    options = plans.FeatureOptions(lexicon=lexicon(spark))
    shards = plans.TextModel("gaussian_nb", options, params=plans.train_shards(texts, "source", options))
    made = [shards, plans.train(texts, "multinomial_nb", plans.FeatureOptions(feature_select=False)), plans.train(texts, "presence_nb")]
    return [replace(model, params=durable(model.params, "params")) for model in made]


@query("e4_gather_status", f"""WITH {_GATHERED},
  steps(step, status, more) AS (VALUES (1, 'CREATED', 1), (2, 'EXISTS', 1), (3, 'CREATED', 2), (4, 'EXISTS', 1))
  SELECT step, domain, status, n + more AS n_members FROM shards, steps
  UNION ALL SELECT step, 'nothing yet', 'IGNORED', 0 FROM steps""")
def e4_status(spark, sf):
    """Gather, gather the same, gather one member more, and the first set again; a domain without members is passed over."""
    path, models = scratch(spark, "registry"), _gathered_models(spark, sf)
    asked = spark.createDataFrame([("nothing yet",)], "domain string")
    out = None
    for step, count in enumerate((2, 2, 3, 2), 1):
        status = composites.gather(models[:count], path, step, domains=asked)
        part = status.select(F.lit(step).alias("step"), "domain", "status", "n_members")
        out = part if out is None else out.union(part)
    return out


@query("e4_gather_classify", f"""WITH {_GATHERED},
  kept AS (SELECT train.* FROM train SEMI JOIN firsts USING (domain, member)),
  {gaussian_sql("kept", "vd", ["domain", "member"], ["doc_id", "domain"]).replace("FROM vd", "FROM (SELECT *, lang AS domain FROM vec)")},
  multi AS ({MULTINOMIAL} SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM pr),
  words AS (WITH {LABELS}, {presence_sql()} SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM pr),
  votes AS (SELECT doc_id, label, prob FROM probs UNION ALL SELECT * FROM multi UNION ALL SELECT * FROM words),
  mixed AS (SELECT doc_id, lang AS domain, label, sum(prob) / any_value(n + 2) AS e
            FROM votes JOIN documents USING (doc_id) JOIN shards ON shards.domain = lang GROUP BY ALL)
  SELECT doc_id, domain, arg_max(label, (round(e, 9), CASE WHEN label = 'neg' THEN 1 ELSE 0 END)) AS predicted, round(max(e), 6) AS prob
  FROM mixed GROUP BY doc_id, domain""")
def e4_classify(spark, sf):
    """The composite is stored, loaded by its path and asked for every document."""
    path = scratch(spark, "registry")
    composites.gather(_gathered_models(spark, sf), path, 1)
    every = documents(spark, sf).select("doc_id", F.col("lang").alias("domain"), "text")
    answers = composites.classify_composite(every, composites.load_composite(spark, path))
    return answers.select("doc_id", "domain", "predicted", F.round("prob", 6).alias("prob"))


@query("e4_member_errors", f"""WITH {_GATHERED},
  {gaussian_sql("train", "train", ["domain", "member"], ["doc_id", "domain"])},
  multi AS ({MULTINOMIAL} SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM pr),
  votes AS (SELECT doc_id, domain, '0/' || member AS model_id, label, prob FROM probs
            UNION ALL SELECT doc_id, domain, '1/model', multi.label, prob FROM multi JOIN (SELECT DISTINCT doc_id, domain FROM train) USING (doc_id)),
  known AS (SELECT doc_id, model_id, domain, list(label) AS labels, sum(power(prob - (v.label = t.truth)::INT, 2)) AS sq, count(*) AS cells, any_value(t.truth) AS truth
            FROM votes v JOIN (SELECT doc_id, label AS truth FROM train) t USING (doc_id) GROUP BY ALL),
  errs AS (SELECT domain, model_id, count(*) AS n,
             sqrt(sum(sq + CASE WHEN list_contains(labels, truth) THEN 0 ELSE 1 END) / sum(cells)) AS root_mean_sq_err FROM known GROUP BY ALL)
  SELECT domain, model_id, n, round(root_mean_sq_err, 6) AS root_mean_sq_err FROM errs""")
def e4_best(spark, sf):
    """Errors of members of two learners on the labelled texts, by which the best is chosen."""
    texts = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    errors = composites.composite_errors(texts, composites.composite_of(_gathered_models(spark, sf)[:2]))
    return _rounded(errors, ["root_mean_sq_err"])
