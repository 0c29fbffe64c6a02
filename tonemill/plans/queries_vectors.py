"""Registered queries: lexicon, sentiment vectors, Gaussian models, evaluation, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tonemill.functions import text
from tonemill.functions.identity import domain_list, domain_or_default
from tonemill.operators import bayes, evaluate, increments, mixed, mllib, neighbours, rows
from tonemill.operators.joins import lookup_join
from tonemill.operators.vectors import FEATURE_WEIGHTS, FEATURES, sentence_scores, sentiment_vectors
from tonemill.plans import training as training_plans
from tonemill.plans.fixtures import (
    LABELS, LEX, MEASURES, NB, ROUNDED_MEASURES, SENTENCE_SCORES, SENTENCES, TRAINING, VECTORS, WORD_LIST,
    ARGMAX, documents, gaussian_sql, labelled_texts, labels, lexicon, measures_sql, melted, query, table, training, vectors, with_labels,
)
from tonemill.session import durable, scratch
from tonemill.sources.lexicon import (
    lexicon_senses, parse_lines, read_lexicon, score_lexicon,
)


def _rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- a lexicon made from the labelled texts ---------------------------------------------

_LINES_SQL = f"""made AS (
  SELECT doc_id AS line_no, ['a', 'r', 'n', 'v'][(length(text) % 4) + 1] AS pos, CAST(doc_id AS VARCHAR) AS id,
         quality * CAST(0.5 AS DOUBLE) AS pos_score, toxic * CAST(0.75 AS DOUBLE) AS neg_score,
         list_filter(list_transform(list_distinct_kept, lambda w: w), lambda w: w <> '') AS ws, lang AS gloss
  FROM (SELECT *, list_filter(ws0, lambda w, i: list_position(ws0, w) = i) AS list_distinct_kept
        FROM (SELECT doc_id, text, lang, quality, toxic, {WORD_LIST} AS ws0 FROM documents JOIN labels USING (doc_id)))),
made_senses AS (
  SELECT lower(regexp_replace(w, '[^a-zA-Z\\s]', '', 'g')) AS term, pos, rank, pos_score - neg_score AS score, line_no
  FROM (SELECT *, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS rank FROM made))"""


def lines_from_texts(spark, sf) -> DataFrame:
    """One lexicon line per labelled text: its distinct words, ranked by first use."""
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    pos = F.element_at(F.array(*[F.lit(p) for p in "arnv"]), F.length("text") % 4 + 1)
    used = docs.withColumn("_w", F.array_distinct(text.words(F.col("text"))))
    ranked = F.transform("_w", lambda w, i: F.concat(w, F.lit("#"), (i + 1).cast("string")))
    return used.select(
        F.col("doc_id").alias("line_no"),
        F.concat_ws(
            "\t", pos, F.col("doc_id").cast("string"), (F.col("quality") * 0.5).cast("string"),
            (F.col("toxic") * 0.75).cast("string"), F.array_join(ranked, " "), "lang",
        ).alias("value"),
    )


@query("s11_lexicon_scan", f"""WITH {_LINES_SQL}
  SELECT term, pos, rank, score, count(*) AS n FROM made_senses WHERE term <> '' GROUP BY ALL""")
def s11(spark, sf):
    """Write the lines as a tab-separated lexicon with a comment in each file, then read it."""
    path = scratch(spark, "lexicon")
    lines = lines_from_texts(spark, sf).select("value")
    remark = spark.range(1).select(F.lit("# made from labelled texts").alias("value"))
    lines.unionByName(remark).write.text(path)
    senses = lexicon_senses(read_lexicon(spark, path))
    return senses.groupBy("term", "pos", "rank", "score").agg(F.count(F.lit(1)).alias("n"))


@query("a1_lexicon_build", f"""WITH {_LINES_SQL},
  last AS (SELECT term, pos, rank, arg_max(score, line_no) AS score FROM made_senses WHERE term <> '' GROUP BY ALL)
  SELECT term, pos, round(sum(score / rank) / sum(1.0 / rank), 6) AS score FROM last GROUP BY ALL""")
def a1(spark, sf):
    # Stored, as a lexicon is; else every test of a line would make the line again.
    lines = parse_lines(durable(lines_from_texts(spark, sf), "lexicon"), order=["line_no"])
    return _rounded(score_lexicon(lines), ["score"])


@query("j1_lexicon_lookup", f"""WITH {LEX}, {SENTENCES},
  toks AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(lower(sentence), '[^\\p{{L}}]+'),
    lambda w: regexp_replace(w, '[^a-zA-Z\\s]', '', 'g')), lambda w: w <> '')) AS term FROM sents),
  occ AS (SELECT doc_id, term, count(*) AS n FROM toks GROUP BY ALL)
  SELECT doc_id, term, n, round(coalesce(s_a, 0), 9) AS score_adj, round(coalesce(s_r, 0), 9) AS score_adv,
    round(coalesce(s_n, 0), 9) AS score_noun, round(coalesce(s_v, 0), 9) AS score_verb
  FROM occ LEFT JOIN wide USING (term)""")
def j1(spark, sf):
    """Scores of every word by part of speech; a word outside the lexicon scores 0."""
    docs = text.unnest(
        documents(spark, sf), text.lookup_words(text.strip_noise(F.col("text"))), ["doc_id"], "term"
    )
    counted = docs.filter(F.col("term") != "").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    scored = lookup_join(counted, lexicon(spark), ["term"], spread=["doc_id"])
    pos = [c for c in FEATURES if c != "score_all"]
    return scored.select(
        "doc_id", "term", "n", *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in pos]
    )


@query("a2_sentence_scores", f"""WITH {LEX}, {SENTENCE_SCORES} SELECT doc_id, sentence_no,
  round(score_adj, 6) AS score_adj, round(score_adv, 6) AS score_adv, round(score_noun, 6) AS score_noun,
  round(score_verb, 6) AS score_verb FROM sscore""")
def a2(spark, sf):
    scores = sentence_scores(documents(spark, sf), lexicon(spark)).filter(F.col("sentence_no").isNotNull())
    return _rounded(scores, FEATURES)


_ROUND_FEATURES = ", ".join(f"round({f}, 9) AS {f}" for f in FEATURES)


@query("a3_sentiment_vectors", f"WITH {VECTORS} SELECT doc_id, {_ROUND_FEATURES} FROM vec")
def a3(spark, sf):
    return _rounded(vectors(spark, sf), FEATURES, 9)


# Endings that a rule of thumb turns into part-of-speech tags.
_ENDINGS = [("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("less", "JJ"), ("ic", "JJ"), ("that", "JJ"), ("the", "JJ")]


def ending_tagger(sentence: Column) -> Column:
    """A stand-in tagger: the tag follows from the ending, nouns otherwise."""

    def tag(w: Column) -> Column:
        out = F.lit("NN")
        for ending, name in reversed(_ENDINGS):
            out = F.when(w.endswith(ending), name).otherwise(out)
        return F.struct(w.alias("token"), out.alias("pos"))

    return F.transform(text.letter_words(sentence), tag)


_TAG_CASE = "CASE " + " ".join(f"WHEN word LIKE '%{e}' THEN '{t}'" for e, t in _ENDINGS) + " ELSE 'NN' END"


@query("x4_tagged_vectors", f"""WITH {LEX}, {SENTENCES},
  toks AS (SELECT doc_id, sentence_no, unnest(list_filter(regexp_split_to_array(lower(sentence), '[^\\p{{L}}]+'), lambda x: x <> '')) AS word FROM sents),
  tagged AS (SELECT doc_id, sentence_no, {_TAG_CASE} AS tag, regexp_replace(word, '[^a-zA-Z\\s]', '', 'g') AS term FROM toks),
  hits AS (SELECT doc_id, sentence_no, sum(CASE WHEN tag = 'JJ' THEN s_a ELSE 0 END) AS a,
      sum(CASE WHEN tag = 'RB' THEN s_r ELSE 0 END) AS r, sum(CASE WHEN tag = 'NN' THEN s_n ELSE 0 END) AS n,
      sum(CASE WHEN tag IN ('VBG', 'VBD') THEN s_v ELSE 0 END) AS v FROM tagged JOIN wide USING (term) GROUP BY ALL),
  per AS (SELECT doc_id, coalesce(a, 0) AS a, coalesce(r, 0) AS r, coalesce(n, 0) AS n, coalesce(v, 0) AS v,
                 round(coalesce(a, 0) + coalesce(r, 0) + coalesce(n, 0) + coalesce(v, 0), 9) AS total
          FROM sents LEFT JOIN hits USING (doc_id, sentence_no)),
  means AS (SELECT doc_id, avg(a) AS a, avg(r) AS r, avg(n) AS n, avg(v) AS v,
      avg(CASE WHEN total >= 0.75 THEN 2.0 WHEN total > 0 THEN 1.0 WHEN total <= -0.75 THEN -2.0 WHEN total < 0 THEN -1.0 ELSE 0.0 END) AS x
      FROM per GROUP BY doc_id)
  SELECT doc_id, round(coalesce(a, 0), 9) AS score_adj, round(coalesce(r, 0), 9) AS score_adv, round(coalesce(n, 0), 9) AS score_noun,
    round(coalesce(v, 0), 9) AS score_verb, round(coalesce(x, 0), 9) AS score_all FROM documents LEFT JOIN means USING (doc_id)""")
def x4(spark, sf):
    """Vectors with a tagger given by the user: a word counts only under its tag."""
    return _rounded(sentiment_vectors(documents(spark, sf), lexicon(spark), tagger=ending_tagger), FEATURES, 9)


# ---- rows ---------------------------------------------------------------------------------


@query("r1_usable_rows", f"""WITH {LABELS} SELECT doc_id, label FROM documents LEFT JOIN lab USING (doc_id)
  WHERE text IS NOT NULL AND label IS NOT NULL AND label <> ''""")
def r1(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text").join(labels(spark, sf), "doc_id", "left")
    return rows.usable_rows(docs).select("doc_id", "label")


@query("r5_default_domain", """SELECT doc_id, CASE WHEN lang = 'en' THEN '$DEF' ELSE lang END AS domain,
  array_to_string(CASE WHEN lang = 'en' THEN ['$DEF'] ELSE [lang, source, '$DEF'] END, ',') AS domains FROM documents""")
def r5(spark, sf):
    """English documents name no domain; the others name two."""
    english = F.col("lang") == "en"
    return documents(spark, sf).select(
        "doc_id",
        domain_or_default(F.when(english, " ").otherwise(F.col("lang"))).alias("domain"),
        F.array_join(
            domain_list(F.when(~english, F.concat_ws(", ", "lang", "source"))), ","
        ).alias("domains"),
    )


@query("r6_class_last", f"""WITH {LABELS} SELECT doc_id, md5(text) AS digest, label FROM documents JOIN lab USING (doc_id)""")
def r6(spark, sf):
    made = rows.text_and_label(labelled_texts(spark, sf), "text", "label", ["doc_id"])
    return made.select("doc_id", F.md5("text").alias("digest"), "label")


@query("r9_any_labelled_table", "SELECT conv_id, turn, md5(text) AS digest, role AS label FROM conversations")
def r9(spark, sf):
    made = rows.text_and_label(table(spark, sf, "conversations"), "text", "role", ["conv_id", "turn"])
    return made.select("conv_id", "turn", F.md5("text").alias("digest"), "label")


@query("r10_same_features", f"""WITH {LABELS}, {VECTORS} SELECT doc_id, label, {_ROUND_FEATURES} FROM vec LEFT JOIN lab USING (doc_id)""")
def r10(spark, sf):
    """Training rows and rows without a class go through the same feature function."""
    both = vectors(spark, sf).join(labels(spark, sf), "doc_id", "left")
    return _rounded(both, FEATURES, 9).select("doc_id", "label", *FEATURES)


@query("w1_chunks", "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 100 AS chunk FROM documents")
def w1(spark, sf):
    return rows.chunks(table(spark, sf, "documents").select("doc_id", "lang"), 100, ["lang"], "doc_id")


@query("w5_most_recent", """SELECT doc_id, lang FROM documents
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) <= 75""")
def w5(spark, sf):
    return rows.most_recent(table(spark, sf, "documents").select("doc_id", "lang"), 75, ["lang"], "doc_id")


@query("u4_evaluation_domains", "SELECT DISTINCT lang AS domain FROM documents UNION SELECT '$DEF'")
def u4(spark, sf):
    return evaluate.evaluation_domains(spark, table(spark, sf, "documents").select(F.col("lang").alias("domain")))


# ---- Gaussian models ------------------------------------------------------------------------


@query("a7_gaussian_fit", f"""WITH {TRAINING}, long AS ({melted("train", "domain, label")})
  SELECT domain, label, feature, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x) * count(*), 6) AS m2
  FROM long GROUP BY ALL""")
def a7(spark, sf):
    return _rounded(bayes.gaussian_fit(training(spark, sf), FEATURES, ["domain"]), ["mean", "m2"])


@query("a7_gaussian_merge", f"""WITH {TRAINING}, long AS ({melted("train", "domain, label")})
  SELECT domain, label, feature, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x) * count(*), 6) AS m2
  FROM long GROUP BY ALL""")
def a7_merge(spark, sf):
    """Models of every source, merged: the same as one model of all rows."""
    shards = bayes.gaussian_fit(training(spark, sf, keep=["source"]), FEATURES, ["domain", "source"])
    return _rounded(bayes.merge_gaussian(durable(shards).drop("source"), ["domain"]), ["mean", "m2"])


def scored_training(spark, sf) -> DataFrame:
    """Labelled rows under the models of their language."""
    made = durable(training(spark, sf), "training")
    model = bayes.prepare_members(bayes.gaussian_fit(made, FEATURES, ["domain"]), FEATURES, FEATURE_WEIGHTS)
    return bayes.classify_vectors(made, model, FEATURES, spread=["doc_id"])


@query("j3_model_scores", f"WITH {NB} SELECT doc_id, label AS scored_class, round(prob, 6) AS prob FROM probs")
def j3(spark, sf):
    scored = scored_training(spark, sf).select("doc_id", F.inline("dist"))
    return scored.select("doc_id", F.col("label").alias("scored_class"), F.round("prob", 6).alias("prob"))


@query("w4_classify", f"WITH {NB} SELECT doc_id, domain, label, predicted, round(top, 6) AS prob FROM scored")
def w4(spark, sf):
    return scored_training(spark, sf).select(
        "doc_id", "domain", "label", "predicted", F.round("prob", 6).alias("prob")
    )


@query("a14_confusion", f"WITH {NB} SELECT domain, label, predicted, count(*) AS n FROM scored GROUP BY ALL")
def a14(spark, sf):
    return evaluate.confusion(scored_training(spark, sf), ["domain"])


@query("a14_confusion_matrix", f"""WITH {NB} SELECT label, count(*) FILTER (predicted = 'neg') AS neg,
  count(*) FILTER (predicted = 'pos') AS pos FROM scored GROUP BY label""")
def a14_matrix(spark, sf):
    return evaluate.confusion_matrix(scored_training(spark, sf), ["neg", "pos"])


@query("a15_evaluation", f"""WITH {NB}, {measures_sql("probs", "scored", ["domain"])}
  SELECT domain, n, {ROUNDED_MEASURES} FROM measures""")
def a15(spark, sf):
    return _rounded(evaluate.evaluate(scored_training(spark, sf), ["domain"]).drop("n_unscored"), MEASURES)


@query("a15_unscored_rows", f"""WITH {NB} SELECT domain, count(*) AS n, count(*) FILTER (domain = 'es') AS n_unscored,
  round(avg(CASE WHEN domain <> 'es' AND label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored GROUP BY domain""")
def a15_unscored(spark, sf):
    """Spanish has no model; its rows count as wrong."""
    made = durable(training(spark, sf), "training")
    params = bayes.gaussian_fit(made.filter("domain <> 'es'"), FEATURES, ["domain"])
    scored = bayes.classify_vectors(made, params, FEATURES, FEATURE_WEIGHTS, spread=["doc_id"])
    return _rounded(evaluate.evaluate(scored, ["domain"]).select("domain", "n", "n_unscored", "accuracy"), ["accuracy"])


def _cv_sql() -> str:
    """Ten folds: every row under the model of the other folds."""
    return f"""{TRAINING},
folded AS (SELECT *, doc_id % 10 AS fold FROM train),
long AS ({melted("folded", "domain, fold, label")}),
folds AS (SELECT unnest(range(10)) AS fold),
stats AS (SELECT domain, folds.fold, label, feature, count(*) AS n, avg(x) AS mean, var_pop(x) AS var
          FROM long JOIN folds ON long.fold <> folds.fold GROUP BY ALL),
floors AS (SELECT domain, fold, CASE WHEN max(var) > 0 THEN max(var) * 1e-9 ELSE 1e-9 END AS eps FROM stats GROUP BY ALL),
prior AS (SELECT domain, fold, label, ln(n * 1.0 / sum(n) OVER (PARTITION BY domain, fold)) AS prior
          FROM (SELECT DISTINCT domain, fold, label, n FROM stats)),
xs AS ({melted("folded", "doc_id, domain, fold")}),
ll AS (SELECT doc_id, domain, fold, label, any_value(prior) + sum(
    (CASE WHEN feature = 'score_all' THEN 2.0 ELSE 1.0 END)
    * (-0.5 * ln(2 * pi() * (var + eps)) - (x - mean) * (x - mean) / (2 * (var + eps)))) AS score
  FROM xs JOIN stats USING (domain, fold, feature) JOIN floors USING (domain, fold) JOIN prior USING (domain, fold, label)
  GROUP BY ALL),
raised AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM ll),
probs AS (SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM raised),
best AS (SELECT doc_id, arg_max(label, (prob, CASE WHEN label = 'neg' THEN 1 ELSE 0 END)) AS predicted FROM probs GROUP BY doc_id),
scored AS (SELECT doc_id, domain, label, predicted FROM train JOIN best USING (doc_id))"""


@query("a16_cross_validation", f"""WITH {_cv_sql()}, {measures_sql("probs", "scored", ["domain"])}
  SELECT domain, n, {ROUNDED_MEASURES} FROM measures""")
def a16(spark, sf):
    made = durable(training(spark, sf), "training")
    scored = evaluate.cross_validate(made, FEATURES, 10, weights=FEATURE_WEIGHTS)
    return _rounded(evaluate.evaluate(scored, ["domain"]).drop("n_unscored"), MEASURES)


@query("a18_table_summary", f"""WITH {LABELS} SELECT lang, count(*) AS n_rows, 3 AS n_columns, 2 AS class_place,
  'doc_id,text' AS other_columns FROM documents JOIN lab USING (doc_id) GROUP BY lang""")
def a18(spark, sf):
    return evaluate.table_summary(labelled_texts(spark, sf, ["lang"]), "label", ["lang"])


# ---- neighbours -----------------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT q.vec_id AS id, t.vec_id AS neighbour, CAST(t.label AS VARCHAR) AS label,
    list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS dist
  FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 12), neighbour) AS rank FROM pairs
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(dist, 12), neighbour) <= 5)"""


def _points(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


@query("w3_top_neighbours", f"WITH {_PAIRS} SELECT id, neighbour, label, rank, round(dist, 6) AS dist FROM near")
def w3(spark, sf):
    points = _points(spark, sf)
    near = neighbours.nearest_rows(points, points, 5, skip_self=True)
    return near.select("id", "neighbour", "label", "rank", F.round(F.sqrt("dist2"), 6).alias("dist"))


@query("j4_nearest_neighbours", f"""WITH {_PAIRS},
  votes AS (SELECT id, label, count(*) AS votes, min(rank) AS first FROM near GROUP BY ALL)
  SELECT id, arg_max(label, (votes, -first)) AS predicted, max(votes) AS votes FROM votes GROUP BY id""")
def j4(spark, sf):
    points = _points(spark, sf)
    return neighbours.classify_nearest(points, points, 5, skip_self=True)


_LOCAL = f"""{TRAINING},
lim AS (SELECT {", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in FEATURES)} FROM train),
unit AS (SELECT doc_id, label, {", ".join(FEATURES)},
  {", ".join(f"({f} - lo_{f}) / (CASE WHEN hi_{f} > lo_{f} THEN hi_{f} - lo_{f} ELSE 1 END) AS u_{f}" for f in FEATURES)} FROM train, lim),
gaps AS (SELECT q.doc_id, t.label, {", ".join("t." + f for f in FEATURES)},
  sqrt({" + ".join(f"power(q.u_{f} - t.u_{f}, 2)" for f in FEATURES)}) AS d FROM unit q CROSS JOIN unit t),
w AS (SELECT *, greatest(1.0001 - CASE WHEN max(d) OVER (PARTITION BY doc_id) > 0 THEN d / max(d) OVER (PARTITION BY doc_id) ELSE 0 END, 0) AS w FROM gaps),
wl AS ({" UNION ALL ".join(f"SELECT doc_id, label, '{f}' AS feature, w, {f} AS x FROM w" for f in FEATURES)}),
m AS (SELECT doc_id, label, feature, sum(w) AS n, sum(w * x) / sum(w) AS mean FROM wl GROUP BY ALL),
stats AS (SELECT doc_id, label, feature, any_value(n) AS n, any_value(mean) AS mean, sum(w * power(x - mean, 2)) / sum(w) AS var
          FROM wl JOIN m USING (doc_id, label, feature) GROUP BY ALL),
floors AS (SELECT doc_id, CASE WHEN max(var) > 0 THEN max(var) * 1e-9 ELSE 1e-9 END AS eps FROM stats GROUP BY doc_id),
prior AS (SELECT doc_id, label, ln(n / sum(n) OVER (PARTITION BY doc_id)) AS prior FROM stats WHERE feature = 'score_all'),
xs AS ({melted("train", "doc_id")}),
ll AS (SELECT doc_id, label, any_value(prior) + sum((CASE WHEN feature = 'score_all' THEN 2.0 ELSE 1.0 END)
    * (-0.5 * ln(2 * pi() * (var + eps)) - (x - mean) * (x - mean) / (2 * (var + eps)))) AS score
  FROM xs JOIN stats USING (doc_id, feature) JOIN floors USING (doc_id) JOIN prior USING (doc_id, label) GROUP BY ALL),
raised AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM ll)"""


@query("j5_local_bayes", f"""WITH {_LOCAL}
  SELECT doc_id, arg_max(label, (e, CASE WHEN label = 'neg' THEN 1 ELSE 0 END)) AS predicted, round(max(e) / sum(e), 5) AS prob
  FROM raised GROUP BY doc_id""")
def j5(spark, sf):
    """Every labelled document under a model fitted to all labelled documents by closeness."""
    made = durable(training(spark, sf), "training")
    answers = neighbours.classify_local(made, made, FEATURES, weights=FEATURE_WEIGHTS)
    return answers.select("doc_id", "predicted", F.round("prob", 5).alias("prob"))


_LOCAL_BY_DOMAIN = (
    _LOCAL.replace("lim AS (SELECT ", "lim AS (SELECT domain, ").replace(" FROM train),\nunit", " FROM train GROUP BY domain),\nunit")
    .replace("unit AS (SELECT doc_id, label,", "unit AS (SELECT doc_id, domain, label,").replace("FROM train, lim)", "FROM train JOIN lim USING (domain))")
    .replace("FROM unit q CROSS JOIN unit t)", "FROM unit q JOIN unit t USING (domain))")
)


def _by_domain(spark, sf, learner: str) -> DataFrame:
    texts = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    options = training_plans.FeatureOptions(lexicon=lexicon(spark))
    made = training_plans.with_vectors(texts, options, keep=["label"])
    return training_plans.classify(made, training_plans.train(made, learner, options))


@query("x1_local_by_domain", f"""WITH {_LOCAL_BY_DOMAIN}
  SELECT doc_id, arg_max(label, (e, CASE WHEN label = 'neg' THEN 1 ELSE 0 END)) AS predicted, round(max(e) / sum(e), 5) AS prob
  FROM raised GROUP BY doc_id""")
def x1_local(spark, sf):
    """Local models see only the texts of the row's own language."""
    return _by_domain(spark, sf, "local").select("doc_id", "predicted", F.round("prob", 5).alias("prob"))


@query("x1_nearest_by_domain", f"""WITH {TRAINING},
  pairs AS (SELECT q.doc_id, t.label, t.doc_id AS near, {" + ".join(f"power(q.{f} - t.{f}, 2)" for f in FEATURES)} AS d
            FROM train q JOIN train t USING (domain))
  SELECT doc_id, arg_min(label, (round(d, 9), near)) AS predicted FROM pairs GROUP BY doc_id""")
def x1_nearest(spark, sf):
    """The nearest text is one of the row's own language; equally near ones go by their id."""
    return _by_domain(spark, sf, "nearest").select("doc_id", "predicted")


# ---- learners of pyspark.ml -------------------------------------------------------------------

# A table that a line can part: the quality of a labelled document, moved by a part of its id.
_APART = "SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS label, quality * 4.0 - 2 + (doc_id % 10) / 10.0 AS x, doc_id % 7 / 7.0 AS y"


@query("a9_linear_svm", "SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS predicted FROM labels")
def a9_svm(spark, sf):
    """Classes that can be parted are parted."""
    table(spark, sf, "labels").createOrReplaceTempView("tonemill_labels")
    rows_ = spark.sql(f"{_APART} FROM tonemill_labels").selectExpr("doc_id", "label", "cast(x AS double) AS x", "cast(y AS double) AS y")
    model = mllib.fit_estimator(rows_, ["x", "y"], "linear_svc", maxIter=200, regParam=0.001)
    return mllib.apply_estimator(model, rows_).select("doc_id", "predicted")


_PENALTY = 0.01


@query("a9_logistic", f"SELECT unnest({[*FEATURES, 'intercept']!r}) AS feature, 0.0 AS gradient")
def a9_logistic(spark, sf):
    """The gradient of the mean log loss with a squared penalty vanishes at the coefficients that were found."""
    made = durable(training(spark, sf), "training")
    model = mllib.fit_estimator(
        made, FEATURES, "logistic", maxIter=1000, tol=1e-14, regParam=_PENALTY, standardization=False
    )
    fitted = model.stages[1]
    weights = dict(zip(FEATURES, fitted.coefficients.toArray().tolist(), strict=True))
    margin = sum((F.col(f) * w for f, w in weights.items()), F.lit(fitted.intercept))
    # Classes are numbered by name, so ``pos`` is the class of the positive side.
    miss = 1 / (1 + F.exp(-margin)) - (F.col("label") == "pos").cast("double")
    parts = [F.round(F.avg(miss * F.col(f)) + _PENALTY * w, 4).alias(f) for f, w in weights.items()]
    wide = made.agg(*parts, F.round(F.avg(miss), 4).alias("intercept"))
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.abs(F.col(c)) + 0.0).alias("gradient")) for c in wide.columns]))
    return wide.select(long.alias("x")).select("x.*")


@query("a10_decision_tree", """WITH t AS (SELECT quality, toxic, doc_id % 6 AS a, CASE WHEN doc_id % 12 = 0 THEN 1 - quality ELSE quality END AS q FROM labels),
  cuts AS (SELECT 'a' AS f, unnest(range(5)) AS cut UNION ALL SELECT 't', 0 UNION ALL SELECT 'q', 0),
  sides AS (SELECT f, cut, CASE f WHEN 'a' THEN a WHEN 't' THEN toxic ELSE q END <= cut AS low, quality, count(*) AS n FROM t, cuts GROUP BY ALL),
  leaf AS (SELECT f, cut, low, sum(n) AS k, sum(n) * (1 - sum(power(n, 2)) / power(sum(n), 2)) AS g FROM sides GROUP BY ALL)
  SELECT round(min(gini), 6) AS gini FROM (SELECT f, cut, sum(g) / sum(k) AS gini FROM leaf GROUP BY ALL)""")
def a10(spark, sf):
    """A tree of one split has the least Gini impurity that any one split has; quality is guessed from a column that errs."""
    made = table(spark, sf, "labels").selectExpr(
        "CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS label", "cast(doc_id % 6 AS double) AS a", "cast(toxic AS double) AS t",
        "cast(CASE WHEN doc_id % 12 = 0 THEN 1 - quality ELSE quality END AS double) AS q",
    )
    model = mllib.fit_estimator(made, ["a", "t", "q"], "tree", maxDepth=1, seed=1)
    impurity = 1 - F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda s, p: s + p * p)
    return model.transform(made).agg(F.round(F.avg(impurity), 6).alias("gini"))


# ---- learners that go on from a stored model -------------------------------------------------------

_W = increments.BIN_WIDTH
_XLX = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END"


def _entropy_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {a} + {b} > 0 THEN log2({a} + {b}) - ({_XLX.format(a)} + {_XLX.format(b)}) / ({a} + {b}) ELSE 0 END)"


_FIRST_SPLIT = f"""{TRAINING},
  binned AS (SELECT domain, feature, CAST(floor(x / {_W}) AS BIGINT) AS bin, count(*) FILTER (label = 'neg') * 1.0 AS a, count(*) FILTER (label = 'pos') * 1.0 AS b
             FROM ({melted("train", "domain, label")}) GROUP BY ALL),
  sides AS (SELECT domain, feature, bin, sum(a) OVER w AS la, sum(b) OVER w AS lb, sum(a) OVER p AS ta, sum(b) OVER p AS tb FROM binned
            WINDOW w AS (PARTITION BY domain, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY domain, feature)),
  cuts AS (SELECT domain, feature, (bin + 1) * {_W} AS cut, ta + tb AS n, (ta > 0)::INT + (tb > 0)::INT AS kinds,
             round({_entropy_sql("ta", "tb")} - ((la + lb) * {_entropy_sql("la", "lb")} + (ta + tb - la - lb) * {_entropy_sql("(ta - la)", "(tb - lb)")}) / (ta + tb), 9) AS gain
           FROM sides WHERE ta + tb - la - lb > 0),
  per AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY domain, feature ORDER BY gain DESC, cut) = 1),
  led AS (SELECT *, coalesce(lead(gain) OVER o, 0) AS second, row_number() OVER o AS nth FROM per WINDOW o AS (PARTITION BY domain ORDER BY gain DESC, feature)),
  best AS (SELECT *, log2(greatest(kinds, 2)) * sqrt(ln({1 / increments.DELTA}) / (2 * n)) AS bound FROM led WHERE nth = 1),
  judged AS (SELECT *, gain > 0 AND (gain - second > bound OR bound < {increments.TIE}) AS splits FROM best)"""


@query("a10_hoeffding_split", f"""WITH {_FIRST_SPLIT}
  SELECT domain, feature, cut, abs(gain) AS gain, abs(second) AS second, CAST(n AS BIGINT) AS n, round(bound, 6) AS bound, splits FROM judged""")
def a10_hoeffding(spark, sf):
    """The best first split of the sentiment vectors of each language, and whether the rows seen are enough to make it."""
    rows_ = training(spark, sf).withColumn("node", F.lit(1).cast("long"))
    found = increments.split_candidates(durable(increments.leaf_counts(rows_, FEATURES), "tree-counts"), ["neg", "pos"])
    return found.select("domain", "feature", "cut", "gain", "second", "n", F.round("bound", 6).alias("bound"), "splits")


@query("a10_hoeffding_root", f"""WITH {_FIRST_SPLIT}
  SELECT domain, CAST(sum(n) AS BIGINT) AS n_texts, any_value(feature) AS feature, any_value(cut) AS cut FROM judged WHERE splits GROUP BY domain
  UNION ALL SELECT domain, CAST(n AS BIGINT), NULL, NULL FROM judged WHERE NOT splits""")
def a10_root(spark, sf):
    """Trees learned by name, stored and loaded again: the texts they have seen and the split at their root."""
    path = scratch(spark, "registry")
    texts = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    training_plans.build(texts, path, 1, "hoeffding_tree", training_plans.FeatureOptions(lexicon=lexicon(spark)))
    params = training_plans.load_model(spark, path, "hoeffding_tree").params
    seen = params.filter("feature = ''").groupBy("domain").agg(F.sum("n").alias("n_texts"))
    root = params.filter("label = '' AND feature LIKE '1|%'").select("domain", F.substring("feature", 3, 100).alias("feature"), F.col("mean").alias("cut"))
    return seen.join(root, "domain", "left")


def _svm_sql(rounds: int, penalty: float) -> str:
    """Weights per language after some rounds of subgradient steps, written out round by round."""
    dims = [*FEATURES, "bias"]
    margin = lambda i: " + ".join(f"w{i}.{f} * t.{f}" for f in dims)
    parts = [f"{TRAINING}, t AS (SELECT domain, CASE label WHEN 'pos' THEN 1.0 ELSE -1.0 END AS y, {', '.join(FEATURES)}, 1.0 AS bias FROM train)",
             "n AS (SELECT domain, count(*) AS rows_ FROM t GROUP BY domain)", f"w0 AS (SELECT domain, {', '.join(f'0.0::DOUBLE AS {f}' for f in dims)} FROM n)"]
    for i in range(rounds):
        step = f"(1.0 / ({penalty} * {i + 1}))"
        pulls = ", ".join(f"sum(y * t.{f}) AS {f}" for f in dims)
        parts.append(f"g{i} AS (SELECT t.domain, {pulls} FROM t JOIN w{i} ON t.domain = w{i}.domain WHERE y * ({margin(i)}) < 1 GROUP BY t.domain)")
        after = ", ".join(f"(1 - {step} * {penalty}) * w{i}.{f} + {step} * coalesce(g{i}.{f}, 0) / rows_ AS {f}" for f in dims)
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT w{i}.domain, {after} FROM w{i} JOIN n ON n.domain = w{i}.domain LEFT JOIN g{i} ON g{i}.domain = w{i}.domain)")
    rows_ = " UNION ALL ".join(f"SELECT domain, '{f}' AS feature, round({f}, 6) + 0.0 AS weight FROM w{rounds}" for f in dims)
    return f"WITH {', '.join(parts)} {rows_}"


@query("a9_pegasos_svm", _svm_sql(8, 0.1))
def a9_pegasos(spark, sf):
    """Weights of the class ``pos`` for the sentiment vectors of every language, all languages in the same jobs."""
    params = increments.svm_fit(training(spark, sf), FEATURES, rounds=8, penalty=0.1)
    found = params.filter("label = 'pos' AND feature <> ''")
    return found.select("domain", "feature", (F.round("mean", 6) + 0.0).alias("weight"))


@query("a9_pegasos_increment", _svm_sql(6, 0.1))
def a9_pegasos_increment(spark, sf):
    """Two rounds, then four more that go on from the stored weights, are six rounds."""
    made = durable(training(spark, sf), "training")
    stored = increments.svm_fit(made, FEATURES, rounds=2, penalty=0.1)
    params = increments.svm_fit(made, FEATURES, stored, rounds=4, penalty=0.1).filter("label = 'pos' AND feature <> ''")
    return params.select("domain", "feature", (F.round("mean", 6) + 0.0).alias("weight"))


_NOMINAL = f"""{TRAINING}, {gaussian_sql("train", "vd", ["domain"], ["doc_id", "domain", "source"]).replace("FROM vd", "FROM (SELECT *, lang AS domain FROM vec)")},
  vals AS (SELECT domain, label, source, count(*) AS n FROM train GROUP BY ALL),
  kinds AS (SELECT domain, count(DISTINCT source) AS v FROM train GROUP BY domain),
  sized AS (SELECT domain, label, count(*) AS n_c FROM train GROUP BY ALL),
  joint AS (SELECT doc_id, ll.domain, ll.label, score + ln((coalesce(n, 0) + 1.0) / (n_c + v)) AS score FROM ll JOIN kinds ON kinds.domain = ll.domain
           JOIN sized ON sized.domain = ll.domain AND sized.label = ll.label
           LEFT JOIN vals ON vals.domain = ll.domain AND vals.label = ll.label AND vals.source = ll.source),
  mixed AS (SELECT doc_id, domain, label, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM joint)"""


@query("r8_nominal_bayes", f"""WITH {_NOMINAL}
  SELECT doc_id, domain, arg_max(label, (e, CASE WHEN label = 'neg' THEN 1 ELSE 0 END)) AS predicted, round(max(e) / sum(e), 6) AS prob
  FROM mixed GROUP BY doc_id, domain""")
def r8_bayes(spark, sf):
    """Sentiment vectors and, as a nominal attribute, the source of a text; every document is labelled."""
    every = durable(vectors(spark, sf, ["lang", "source"]), "vectors").withColumnRenamed("lang", "domain")
    stats = mixed.mixed_fit(with_labels(spark, sf, every), FEATURES, ["source"], ["domain"])
    scored = mixed.mixed_classify(every, stats, FEATURES, ["source"], ["domain"], FEATURE_WEIGHTS, spread=["doc_id"])
    return scored.select("doc_id", "domain", "predicted", F.round("prob", 6).alias("prob"))
