"""Registered queries: text functions and word features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions import identity, sentiment, text
from tonemill.operators import counts, rows, words
from tonemill.operators.joins import lookup_join
from tonemill.operators.vectors import sentence_scores
from tonemill.plans.fixtures import (
    IS_STOP, LABELS, LEX, SENTENCE_LIST, SENTENCE_SCORES, SENTENCES, WORD_LIST,
    documents, labelled_texts, lexicon, placed, query, table,
)
from tonemill.plans import training as plans
from tonemill.sources.lexicon import POS_COLUMNS


def _listed(df, terms="terms", sep="|"):
    return df.select("doc_id", F.size(terms).alias("n"), F.md5(F.array_join(terms, sep)).alias("digest"))


@query("f1_strip_noise", "SELECT doc_id, md5(regexp_replace(text, '[-+^:]', '', 'g')) AS digest FROM documents")
def f1(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(text.strip_noise(F.col("text"))).alias("digest"))


@query("f2_lookup_key", rf"""SELECT key, count(*) AS n FROM (
  SELECT lower(regexp_replace(w, '[^a-zA-Z\s]', '', 'g')) AS key FROM (SELECT unnest({WORD_LIST}) AS w FROM documents))
  GROUP BY key""")
def f2(spark, sf):
    words_ = text.unnest(documents(spark, sf), text.words(F.col("text")), [], "w")
    return words_.groupBy(text.lookup_key(F.col("w")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("f3_sentences", f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest
  FROM (SELECT doc_id, {SENTENCE_LIST} AS s FROM documents)""")
def f3(spark, sf):
    return _listed(documents(spark, sf).select("doc_id", text.sentences(F.col("text")).alias("terms")))


@query("f4_words", f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest
  FROM (SELECT doc_id, {WORD_LIST} AS s FROM documents)""")
def f4(spark, sf):
    return _listed(documents(spark, sf).select("doc_id", text.words(F.col("text")).alias("terms")))


@query("f5_stop_words", f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest
  FROM (SELECT doc_id, list_filter({WORD_LIST}, lambda w: NOT {IS_STOP}) AS s FROM documents)""")
def f5(spark, sf):
    made = documents(spark, sf).select("doc_id", text.words(F.col("text")).alias("w"))
    return _listed(made.select("doc_id", text.drop_stops(F.col("w")).alias("terms")))


_PAIRS = "[w[i] || ' ' || w[i + 1] for i in range(1, len(w))]"
_TRIPLES = "[w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]"


@query("f6_shingles", f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (
  SELECT doc_id, list_filter(list_concat(w, {_PAIRS}), lambda w: NOT {IS_STOP}) AS s
  FROM (SELECT doc_id, {WORD_LIST} AS w FROM documents))""")
def f6(spark, sf):
    return _listed(words.with_terms(documents(spark, sf), "shingles"))


@query("f7_char_ngrams", f"""SELECT gram, count(*) AS n FROM (
  SELECT unnest(list_concat([t[i:i] for i in range(1, len(t) + 1)],
                            list_concat([t[i:i+1] for i in range(1, len(t))], [t[i:i+2] for i in range(1, len(t) - 1)]))) AS gram
  FROM (SELECT unnest(list_filter(list_concat(w, {_PAIRS}), lambda w: NOT {IS_STOP})) AS t
        FROM (SELECT {WORD_LIST} AS w FROM documents)))
  GROUP BY gram""")
def f7(spark, sf):
    """Grams of one to three characters of all shingles."""
    return words.shingle_ngram_counts(documents(spark, sf), 1, 3)


@query("f8_word_ngrams", f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (
  SELECT doc_id, list_concat(w, list_concat({_PAIRS}, {_TRIPLES})) AS s
  FROM (SELECT doc_id, {WORD_LIST} AS w FROM documents))""")
def f8(spark, sf):
    return _listed(words.with_terms(documents(spark, sf), "ngrams"))


_F9 = """CASE WHEN total >= 0.75 THEN 'strong_positive' WHEN total > 0.25 THEN 'positive'
  WHEN total > 0 THEN 'weak_positive' WHEN total <= -0.75 THEN 'strong_negative'
  WHEN total < -0.25 THEN 'negative' WHEN total < 0 THEN 'weak_negative' ELSE 'neutral' END"""


def _totals(spark, sf):
    scores = sentence_scores(documents(spark, sf), lexicon(spark))
    total = sum((F.col(c) for c in POS_COLUMNS.values()), F.lit(0.0))
    return scores.withColumn("total", F.round(total, 9))


@query("f9_score_classes", f"""WITH {LEX}, {SENTENCE_SCORES}
  SELECT doc_id, sentence_no, {_F9} AS score_class FROM graded""")
def f9(spark, sf):
    totals = _totals(spark, sf).filter(F.col("sentence_no").isNotNull())
    return totals.select("doc_id", "sentence_no", sentiment.score_class(F.col("total")).alias("score_class"))


@query("f10_overall_class", f"""WITH {LEX}, {SENTENCE_SCORES}
  SELECT doc_id, sentence_no, overall - 2 AS overall FROM classed""")
def f10(spark, sf):
    totals = _totals(spark, sf).filter(F.col("sentence_no").isNotNull())
    overall = sentiment.centred_class(sentiment.overall_class(F.col("total")))
    return totals.select("doc_id", "sentence_no", overall.alias("overall"))


@query("f11_all_pos_score", f"""WITH {LEX}, {SENTENCES},
  toks AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '')) AS word FROM documents),
  keyed AS (SELECT word, regexp_replace(word, '[^a-zA-Z\\s]', '', 'g') AS term, count(*) AS n FROM toks GROUP BY ALL)
  SELECT word, n, round(coalesce(s_a + s_r + s_n + s_v, 0), 9) AS score FROM keyed LEFT JOIN wide USING (term)""")
def f11(spark, sf):
    """The score over all parts of speech of every word in use."""
    used = text.unnest(documents(spark, sf), text.letter_words(F.col("text")), [], "word")
    counted = used.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.withColumn("term", text.lookup_key(F.col("word")))
    scored = lookup_join(keyed, lexicon(spark), ["term"], spread=["word"])
    return scored.select("word", "n", F.round(F.coalesce("score_total", F.lit(0.0)), 9).alias("score"))


@query("f13_truncate", """SELECT doc_id, CASE WHEN trim(text) <> '' AND length(text) > 40
  THEN substring(text, 1, 40) || ' [cut]' ELSE text END AS short FROM documents""")
def f13(spark, sf):
    return documents(spark, sf).select("doc_id", text.truncate(F.col("text"), 40, " [cut]").alias("short"))


@query("f14_elapsed", """SELECT doc_id, (n_chars * 61 // 60000) || ' min ' || (n_chars * 61 % 60000 // 1000) || ' sec '
  || (n_chars * 61 % 1000) || ' ms' AS elapsed FROM documents""")
def f14(spark, sf):
    return documents(spark, sf).select("doc_id", text.elapsed(F.col("n_chars") * 61).alias("elapsed"))


@query("f15_escape_markup", r"""SELECT page_id, md5('<html><body><pre id="content">' ||
  replace(replace(replace(replace(regexp_replace(html, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'),
  '<', '&lt;'), '>', '&gt;'), chr(10), '<br />'), ' ', '&nbsp;') || '</pre></body></html>') AS digest FROM pages""")
def f15(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.escape_markup(F.col("html"))).alias("digest"))


@query("f16_clean_name", r"SELECT page_id, translate(url, '/\:', '___') AS name FROM pages")
def f16(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_name(F.col("url")).alias("name"))


@query("f17_registry_key", "SELECT doc_id, 'gaussian_nb-' || source || '-voting' AS key FROM documents")
def f17(spark, sf):
    key = identity.registry_key(F.lit("gaussian_nb"), F.col("source"), F.lit("voting"))
    return documents(spark, sf).select("doc_id", key.alias("key"))


@query("u3_distinct_tokens", f"""SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS digest
  FROM (SELECT doc_id, list_distinct({WORD_LIST}) AS s FROM documents)""")
def u3(spark, sf):
    made = documents(spark, sf).select("doc_id", text.words(F.col("text")).alias("w"))
    return _listed(made.select("doc_id", F.array_sort(text.distinct_terms(F.col("w"))).alias("terms")))


@query("a4_term_frequency", f"""SELECT conv_id, turn, term, count(*) AS n, min(pos) AS first_pos FROM (
  SELECT conv_id, turn, unnest(w) AS term, unnest(range(len(w))) AS pos
  FROM (SELECT conv_id, turn, {WORD_LIST} AS w FROM conversations)) GROUP BY ALL""")
def a4(spark, sf):
    made = words.with_terms(table(spark, sf, "conversations"))
    return words.term_frequency(made, ["conv_id", "turn"])



# A small lemma table.
_LEMMAS = [("was", "be"), ("is", "be"), ("are", "be"), ("des", "de"), ("der", "die"), ("idiots", "idiot")]
_LEMMA_ROWS = ", ".join(f"('{w}', '{m}')" for w, m in _LEMMAS)


@query("a4_lemma_frequency", f"""WITH lemmas(term, lemma) AS (VALUES {_LEMMA_ROWS}),
  toks AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos
           FROM (SELECT doc_id, {WORD_LIST} AS w FROM documents))
  SELECT doc_id, coalesce(lemma, term) AS term, count(*) AS n, min(pos) AS first_pos
  FROM toks LEFT JOIN lemmas USING (term) GROUP BY ALL""")
def a4_lemma(spark, sf):
    lemmas = spark.sql(f"SELECT * FROM VALUES {_LEMMA_ROWS} AS t(word, lemma)")
    docs = placed(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return words.term_frequency(words.with_terms(docs), ["doc_id"], lemmas=lemmas)


@query("a4_joined_terms", f"""SELECT doc_id, md5(string_agg(term, ' ' ORDER BY first_pos)) AS digest FROM (
  SELECT doc_id, term, min(pos) AS first_pos FROM (
    SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos
    FROM (SELECT doc_id, {WORD_LIST} AS w FROM documents)) GROUP BY ALL) GROUP BY doc_id""")
def a4_joined(spark, sf):
    made = documents(spark, sf).select("doc_id", text.words(F.col("text")).alias("w"))
    joined = words.joined_distinct_terms(F.col("w"))
    return made.filter(F.size("w") > 0).select("doc_id", F.md5(joined).alias("digest"))


_PRESENT = f"""present AS (SELECT doc_id, unnest(list_distinct({WORD_LIST})) AS term FROM documents)"""


def _per_text(rows_: DataFrame) -> DataFrame:
    """(doc_id, n, digest): the known terms of each text."""
    listed = F.array_join(F.sort_array(F.collect_list("term")), " ")
    return rows_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.md5(listed).alias("digest"))


_DIGEST = "doc_id, count(*) AS n, md5(string_agg(term, ' ' ORDER BY term)) AS digest"


@query("a5_presence_vectors", f"""WITH {_PRESENT},
  vocab AS (SELECT DISTINCT term FROM present JOIN labels USING (doc_id))
  SELECT {_DIGEST} FROM present SEMI JOIN vocab USING (term) GROUP BY doc_id""")
def a5(spark, sf):
    """The labelled texts are the first batch and fix the vocabulary for all texts."""
    vocab = words.vocabulary(words.with_terms(labelled_texts(spark, sf)))
    return _per_text(words.presence_vectors(words.with_terms(documents(spark, sf)), vocab, ["doc_id"]))


def _xlx(e: str) -> str:
    return f"(CASE WHEN ({e}) > 0 THEN ({e}) * log2({e}) ELSE 0 END)"


def _gain_sql(present: str, rows_: str) -> str:
    xlx = lambda e: f"(CASE WHEN ({e}) > 0 THEN ({e}) * log2({e}) ELSE 0 END)"
    return f"""classes AS (SELECT label, count(*) * 1.0 AS n_c FROM {rows_} GROUP BY label),
  whole AS (SELECT sum(n_c) AS n, sum({xlx('n_c')}) AS h FROM classes),
  cells AS (SELECT t.term, c.label, coalesce(n_tc, 0) * 1.0 AS n_tc, n_c
            FROM (SELECT DISTINCT term FROM {present}) t CROSS JOIN classes c
            LEFT JOIN (SELECT term, label, count(*) AS n_tc FROM {present} GROUP BY ALL) x
              ON x.term = t.term AND x.label = c.label),
  per AS (SELECT term, sum(n_tc) AS n_t, sum({xlx('n_tc')}) AS w, sum({xlx('n_c - n_tc')}) AS wo,
            list({{'tc': CAST(n_tc AS HUGEINT), 'c': CAST(n_c AS HUGEINT)}}) AS parts FROM cells GROUP BY term),
  gains AS (SELECT term, CAST(n_t AS BIGINT) AS n_docs,
      len(list_filter(parts, lambda x: x.tc * CAST(n AS HUGEINT) <> CAST(n_t AS HUGEINT) * x.c)) > 0 AS tells,
      round((({xlx('n')} - h) - ({xlx('n_t')} - w) - ({xlx('n - n_t')} - wo)) / n, 9) AS gain FROM per, whole)"""


_GAIN = f"""{LABELS}, {_PRESENT}, tagged AS (SELECT doc_id, term, label FROM present JOIN lab USING (doc_id)),
  known AS (SELECT doc_id, label FROM documents JOIN lab USING (doc_id)), {_gain_sql('tagged', 'known')}"""


def _rounded_gains(spark, sf) -> DataFrame:
    return words.information_gain(words.with_terms(labelled_texts(spark, sf))).withColumn("gain", F.round("gain", 9) + 0.0)


@query("a6_information_gain", f"WITH {_GAIN} SELECT term, n_docs, abs(gain) AS gain FROM gains WHERE tells")
def a6(spark, sf):
    return _rounded_gains(spark, sf)


@query("a6_gain_by_domain", f"""WITH {LABELS}, {_PRESENT},
  tagged AS (SELECT doc_id, term, label, lang AS domain FROM present JOIN lab USING (doc_id) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
  n_c AS (SELECT lang AS domain, label, count(*) AS n_c FROM documents JOIN lab USING (doc_id) GROUP BY ALL),
  whole AS (SELECT domain, sum(n_c) AS n, sum(n_c * log2(n_c)) AS h FROM n_c GROUP BY domain),
  cells AS (SELECT t.domain, t.term, c.label, coalesce(n_tc, 0) AS n_tc, n_c FROM (SELECT DISTINCT domain, term FROM tagged) t
    JOIN n_c c USING (domain) LEFT JOIN (SELECT domain, term, label, count(*) AS n_tc FROM tagged GROUP BY ALL) x
      ON x.domain = t.domain AND x.term = t.term AND x.label = c.label),
  per AS (SELECT domain, term, sum(n_tc) AS n_t, sum({_xlx('n_tc')}) AS w, sum({_xlx('n_c - n_tc')}) AS wo,
    list({{'tc': n_tc, 'c': n_c}}) AS parts FROM cells GROUP BY ALL)
  SELECT domain, term, CAST(n_t AS BIGINT) AS n_docs,
    abs(round((({_xlx('n')} - h) - ({_xlx('n_t')} - w) - ({_xlx('n - n_t')} - wo)) / n, 9)) AS gain
  FROM per JOIN whole USING (domain) WHERE len(list_filter(parts, lambda x: x.tc * n <> n_t * x.c)) > 0""")
def a6_by_domain(spark, sf):
    """Each language has gains of its own."""
    texts = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    gains = words.information_gain(words.with_terms(texts), by=["domain"])
    return gains.withColumn("gain", F.round("gain", 9) + 0.0)


@query("l1_ranked_terms", f"""WITH {_GAIN} SELECT term, n_docs, abs(gain) AS gain FROM gains WHERE tells
  ORDER BY gain DESC, term""")
def l1(spark, sf):
    return words.ranked_terms(_rounded_gains(spark, sf))


@query("a6_selected_vectors", f"""WITH {_GAIN} SELECT {_DIGEST} FROM present
  SEMI JOIN (SELECT term FROM gains WHERE tells) USING (term) GROUP BY doc_id""")
def a6_selected(spark, sf):
    gains = words.information_gain(words.with_terms(labelled_texts(spark, sf)))
    return _per_text(words.select_terms(words.with_terms(documents(spark, sf)), gains, ["doc_id"]))


_COUNTS = f"""toks AS (SELECT doc_id, unnest({WORD_LIST}) AS term FROM documents),
  tl AS (SELECT lang AS domain, label, term, count(*) AS n
         FROM toks JOIN lab USING (doc_id) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL),
  dl AS (SELECT lang AS domain, label, count(*) AS n FROM documents JOIN lab USING (doc_id) GROUP BY ALL)"""


def _word_rows(spark, sf):
    rows_ = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    return words.with_terms(rows_)


@query("a8_multinomial_fit", f"""WITH {LABELS}, {_COUNTS}
  SELECT domain, label, term AS feature, n FROM tl UNION ALL SELECT domain, label, '' AS feature, n FROM dl""")
def a8_fit(spark, sf):
    return counts.count_fit(_word_rows(spark, sf), by=["domain"])


# From documents to ``pr`` (doc_id, label, e): multinomial models of the labelled texts, per language.
MULTINOMIAL = f"""WITH {LABELS}, {_COUNTS},
  v AS (SELECT domain, count(DISTINCT term) AS v FROM tl GROUP BY domain),
  tot AS (SELECT domain, label, sum(n) AS total FROM tl GROUP BY ALL),
  cls AS (SELECT dl.domain, dl.label, coalesce(total, 0) AS total, coalesce(v, 0) AS v,
            ln((dl.n + 1.0) / (sum(dl.n) OVER (PARTITION BY dl.domain) + count(*) OVER (PARTITION BY dl.domain))) AS prior
          FROM dl LEFT JOIN tot USING (domain, label) LEFT JOIN v USING (domain)),
  rows_ AS (SELECT doc_id, lang AS domain FROM documents),
  occ AS (SELECT doc_id, domain, term, count(*) AS c FROM toks JOIN rows_ USING (doc_id) GROUP BY ALL),
  known AS (SELECT occ.* FROM occ SEMI JOIN tl ON occ.domain = tl.domain AND occ.term = tl.term),
  parts AS (SELECT k.doc_id, cls.label, sum(k.c * ln((coalesce(tl.n, 0) + 1.0) / (cls.total + cls.v))) AS s
            FROM known k JOIN cls ON cls.domain = k.domain
            LEFT JOIN tl ON tl.domain = k.domain AND tl.term = k.term AND tl.label = cls.label GROUP BY ALL),
  sc AS (SELECT doc_id, cls.label, prior + coalesce(s, 0) AS score FROM rows_ JOIN cls USING (domain)
         LEFT JOIN parts USING (doc_id, label)),
  pr AS (SELECT doc_id, label, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM sc)"""


@query("a8_multinomial_classify", f"""{MULTINOMIAL}
  SELECT doc_id, arg_max(label, (e, CASE WHEN label = 'neg' THEN 1 ELSE 0 END)) AS predicted,
         round(max(e) / sum(e), 6) AS prob FROM pr GROUP BY doc_id""")
def a8_classify(spark, sf):
    """Models of the labelled texts, per language, label every document."""
    stats = counts.count_fit(_word_rows(spark, sf), by=["domain"])
    rows_ = words.with_terms(documents(spark, sf).select("doc_id", F.col("lang").alias("domain"), "text"))
    scored = counts.count_scores(rows_, counts.prepare_counts(stats, ["domain"]), ["doc_id"])
    return scored.select("doc_id", "predicted", F.round("prob", 6).alias("prob"))


# The labelled texts, their words, and Gaussian scores of words that are there (one) or not (zero).
_LEAST = repr((0.01 / 6) ** 2)


def presence_sql(chosen: str = "TRUE", p: str = "") -> str:
    """CTEs from documents to ``{p}pr`` (doc_id, label, e): models per language of the labelled texts that are chosen.

    ``e`` is the class's probability before division by the sum over classes.
    """
    xlx = _xlx
    return f"""{p}texts AS (SELECT doc_id, lang AS domain, list_distinct({WORD_LIST}) AS words FROM documents WHERE {chosen}),
  {p}tagged AS (SELECT doc_id, domain, label, unnest(words) AS term FROM {p}texts JOIN lab USING (doc_id)),
  {p}nc AS (SELECT domain, label, count(*) AS n_c FROM {p}texts JOIN lab USING (doc_id) GROUP BY ALL),
  {p}whole AS (SELECT domain, sum(n_c) AS n FROM {p}nc GROUP BY domain),
  {p}cells AS (SELECT t.domain, t.term, c.label, coalesce(n_tc, 0) AS n_tc, n_c FROM (SELECT DISTINCT domain, term FROM {p}tagged) t
    JOIN {p}nc c USING (domain) LEFT JOIN (SELECT domain, term, label, count(*) AS n_tc FROM {p}tagged GROUP BY ALL) x
      ON x.domain = t.domain AND x.term = t.term AND x.label = c.label),
  {p}tells AS (SELECT domain, term FROM (SELECT domain, term, sum(n_tc) AS n_t, list({{'tc': n_tc, 'c': n_c}}) AS parts FROM {p}cells GROUP BY ALL)
    JOIN {p}whole USING (domain) WHERE len(list_filter(parts, lambda x: x.tc * n <> n_t * x.c)) > 0),
  {p}moments AS (SELECT domain, term, label, n_tc / n_c AS p, greatest(n_tc / n_c * (1 - n_tc / n_c), {_LEAST}) AS var
                 FROM {p}cells SEMI JOIN {p}tells USING (domain, term)),
  {p}base AS (SELECT domain, label, sum(-0.5 * ln(2 * pi() * var) - p * p / (2 * var)) AS absent FROM {p}moments GROUP BY ALL),
  {p}present AS (SELECT doc_id, label, sum((2 * p - 1) / (2 * var)) AS more
                 FROM (SELECT doc_id, domain, unnest(words) AS term FROM {p}texts) JOIN {p}moments USING (domain, term) GROUP BY ALL),
  {p}sc AS (SELECT doc_id, domain, c.label, ln(n_c / n) + coalesce(absent, 0) + coalesce(more, 0) AS score
            FROM {p}texts JOIN {p}nc c USING (domain) JOIN {p}whole USING (domain) LEFT JOIN {p}base USING (domain, label) LEFT JOIN {p}present USING (doc_id, label)),
  {p}pr AS (SELECT doc_id, domain, label, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM {p}sc)"""


PRESENCE_BEST = "arg_max(label, (e, CASE WHEN label = 'neg' THEN 1 ELSE 0 END)) AS predicted, round(max(e) / sum(e), 6) AS prob"


@query("a7_presence_fit", f"""WITH {LABELS}, {presence_sql()}
  SELECT domain, label, term AS feature, n_tc AS n FROM cells SEMI JOIN tells USING (domain, term) WHERE n_tc > 0
  UNION ALL SELECT domain, label, '', n_c FROM nc""")
def a7_presence_fit(spark, sf):
    """Selected words of each language, counted once per text."""
    rows_ = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    return plans.train(rows_, "presence_nb").params.select("domain", "label", "feature", "n")


@query("a7_presence_classify", f"WITH {LABELS}, {presence_sql()} SELECT doc_id, domain, {PRESENCE_BEST} FROM pr GROUP BY doc_id, domain")
def a7_presence_classify(spark, sf):
    """Models of the selected words of the labelled texts label every document."""
    rows_ = labelled_texts(spark, sf, ["lang"]).withColumnRenamed("lang", "domain")
    every = documents(spark, sf).select("doc_id", F.col("lang").alias("domain"), "text")
    scored = plans.classify(every, plans.train(rows_, "presence_nb"))
    return scored.select("doc_id", "domain", "predicted", F.round("prob", 6).alias("prob"))


@query("a19_char_model", """WITH grams AS (SELECT doc_id, lang, unnest([text[i:i+7] for i in range(1, length(text) - 6)]) AS g FROM documents),
  occ AS (SELECT doc_id, g, count(*) AS c FROM grams GROUP BY ALL),
  model AS (SELECT lang AS label, g, count(*) AS n FROM grams GROUP BY ALL),
  tot AS (SELECT label, sum(n) AS total FROM model GROUP BY label),
  v AS (SELECT count(DISTINCT g) AS v FROM model),
  langs AS (SELECT DISTINCT lang AS label FROM documents),
  den AS (SELECT label, ln(coalesce(total, 0) + 0.5 * v) AS d FROM langs LEFT JOIN tot USING (label), v),
  base AS (SELECT doc_id, sum(c) AS n FROM occ GROUP BY doc_id),
  extra AS (SELECT doc_id, label, sum(c * (ln(n + 0.5) - ln(0.5))) AS x FROM occ JOIN model USING (g) GROUP BY ALL),
  sc AS (SELECT documents.doc_id, lang, den.label, coalesce(n, 0) * (ln(0.5) - d) + coalesce(x, 0) AS score
         FROM documents CROSS JOIN den LEFT JOIN base USING (doc_id) LEFT JOIN extra USING (doc_id, label)),
  pr AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e,
                dense_rank() OVER (ORDER BY label) AS idx FROM sc)
  SELECT doc_id, lang, arg_max(label, (round(e, 9), -idx)) AS predicted, round(max(e) / sum(e), 6) AS prob
  FROM pr GROUP BY doc_id, lang""")
def a19(spark, sf):
    """Language of every document by its character runs of length eight."""
    docs = documents(spark, sf).select("doc_id", "lang", "text")
    scored = counts.char_scores_among(counts.with_char_grams(docs), ["doc_id"], "lang", keep=["lang"])
    return scored.select("doc_id", "lang", "predicted", F.round("prob", 6).alias("prob"))


@query("r7_class_index", """SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS label_idx, lang AS label FROM documents""")
def r7(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("lang").alias("label"))
    return rows.with_class_index(docs, spread=["doc_id"]).select("doc_id", "label_idx", "label")


@query("r8_nominal", "SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels")
def r8(spark, sf):
    return rows.nominal(table(spark, sf, "labels"), ["quality", "toxic"])


@query("x2_tokenizers", f"""WITH w AS (SELECT doc_id, {WORD_LIST} AS w FROM documents),
  t AS (SELECT doc_id, 'words' AS tokenizer, w AS s FROM w
        UNION ALL SELECT doc_id, 'shingles', list_filter(list_concat(w, {_PAIRS}), lambda w: NOT {IS_STOP}) FROM w
        UNION ALL SELECT doc_id, 'ngrams', list_concat(w, list_concat({_PAIRS}, {_TRIPLES})) FROM w
        UNION ALL SELECT doc_id, 'custom', list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') FROM documents)
  SELECT tokenizer, doc_id, len(s) AS n, len(list_distinct(s)) AS n_distinct FROM t""")
def x2(spark, sf):
    """Every tokenizer by name, and one given as a function."""
    docs = documents(spark, sf).select("doc_id", "text")
    made = docs
    for name in words.TOKENIZERS:
        made = words.with_terms(made, name, name=name)
    made = words.with_terms(made, text.letter_words, name="custom")
    parts = [
        F.struct(F.lit(n).alias("tokenizer"), F.size(n).alias("n"), F.size(F.array_distinct(n)).alias("n_distinct"))
        for n in (*words.TOKENIZERS, "custom")
    ]
    return made.select("doc_id", F.inline(F.array(*parts)))
