"""What the registered queries share: tables, the sample lexicon, and oracle fragments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.operators.joins import Lookup, as_lookup, lookup_join
from tonemill.operators.vectors import FEATURES, sentiment_vectors
from tonemill.sources.lexicon import prepare_lexicon, score_lexicon

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where it can be put in SQL, the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a table that comes in fewer pieces than there are cores more pieces.

    Files of a real corpus split into far more pieces than cores, and then nothing
    is moved.  Placing rows by their id lets the later work per id stay in place.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


#: Pieces of ``placed`` for each piece in which a table is read.
PIECES = 4


def placed(df: DataFrame, key: str) -> DataFrame:
    """The rows placed by their id in small pieces, each of which can be cut into words and grouped by text in memory.

    Texts move once; their words, which are many times as much, stay where the text is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, PIECES * df.rdd.getNumPartitions()), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


# A small lexicon in its source form (pos, id, positive, negative, terms, gloss).
# It holds terms with several ranks, a rank given twice, terms with several parts of
# speech, a term in capitals and one of two words.
LEXICON = [
    ("a", "00000001", 0.0, 0.75, "idiot#2 stupid#1 pathetic#1", "foolish"),
    ("n", "00000002", 0.0, 0.875, "idiot#1 moron#1", "a foolish person"),
    ("n", "00000003", 0.0, 0.625, "scum#1 trash#1 loser#1", "worthless people"),
    ("a", "00000004", 0.125, 0.75, "worthless#1 disgusting#1 vile#1", "without value"),
    ("n", "00000005", 0.0, 0.25, "clown#1", "a performer"),
    ("v", "00000006", 0.0, 0.5, "trash#1 clown#2", "to ruin"),
    ("r", "00000007", 0.125, 0.0, "With#1 for#2", "together"),
    ("a", "00000008", 0.25, 0.0, "the#1 is#4", "definite"),
    ("n", "00000009", 0.125, 0.25, "the#2 of#1", "an article"),
    ("n", "00000010", 0.0, 0.125, "the#4 and#1", "a word"),
    ("a", "00000011", 0.375, 0.125, "that#1 la#1", "pointing"),
    ("a", "00000012", 0.5, 0.125, "that#1 der#1", "pointing, as given last"),
    ("v", "00000013", 0.25, 0.125, "is#1 que#2 was#1", "to be"),
    ("r", "00000014", 0.0, 0.125, "que#1 in_and#1", "how"),
    ("n", "00000015", 0.625, 0.0, "orre#1 rewh#2", "a good"),
]
LEXICON_COLUMNS = "pos, id, pos_score, neg_score, terms, gloss, line_no"


def _values() -> str:
    rows = [
        f"('{p}', '{i}', CAST({ps} AS DOUBLE), CAST({ns} AS DOUBLE), '{t}', '{g}', {n})"
        for n, (p, i, ps, ns, t, g) in enumerate(LEXICON)
    ]
    return ", ".join(rows)


def lexicon_lines(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values()} AS t({LEXICON_COLUMNS})")


_prepared: dict[str, Lookup] = {}


def lexicon(spark: SparkSession) -> Lookup:
    """The sample lexicon in its prepared form, stored once per application."""
    app = spark.sparkContext.applicationId
    if app not in _prepared:
        _prepared[app] = prepare_lexicon(score_lexicon(lexicon_lines(spark)))
    return _prepared[app]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label): toxic texts are ``neg``, the others ``pos``."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "neg").otherwise("pos").alias("label")
    )


def with_labels(spark: SparkSession, sf_dir: str, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Meet the labels where the rows are while the label table is small; shuffle beyond that."""
    return lookup_join(rows, as_lookup(labels(spark, sf_dir)), ["doc_id"], how)


def vectors(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    return sentiment_vectors(documents(spark, sf_dir), lexicon(spark), keep=keep or [])


def training(spark: SparkSession, sf_dir: str, domain: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Labelled sentiment vectors: only texts that have a label are cut into words.

    The ids of a label table beyond a broadcast are met by placing the texts by their id, once; their sentences then
    stay in place, and moving a text costs far less than looking up its words.
    """
    names = list(dict.fromkeys([domain, *(keep or [])]))
    known = as_lookup(labels(spark, sf_dir))
    ids = replace(known, table=known.table.select("doc_id"))
    texts = lookup_join(documents(spark, sf_dir).select("doc_id", *names, "text"), ids, ["doc_id"], "left_semi")
    rows = lookup_join(sentiment_vectors(texts, lexicon(spark), keep=names), known, ["doc_id"], "inner")
    return rows.withColumn("domain", F.col(domain))


def labelled_texts(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, keep..., text, label) of the documents that have a label."""
    docs = documents(spark, sf_dir).select("doc_id", *(keep or []), "text")
    return with_labels(spark, sf_dir, docs)


# ---- oracle fragments -------------------------------------------------------------------

LABELS = "lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'neg' ELSE 'pos' END AS label FROM labels)"

LEX = rf"""lines({LEXICON_COLUMNS}) AS (VALUES {_values()}),
senses AS (
  SELECT lower(regexp_replace(split_part(sense, '#', 1), '[^a-zA-Z\s]', '', 'g')) AS term, pos,
         CAST(split_part(sense, '#', 2) AS INTEGER) AS rank, score, line_no, place
  FROM (SELECT pos, pos_score - neg_score AS score, line_no,
               unnest(string_split(terms, ' ')) AS sense,
               unnest(range(len(string_split(terms, ' ')))) AS place FROM lines)),
ranked AS (SELECT term, pos, rank, arg_max(score, line_no * 1000 + place) AS score
           FROM senses WHERE term <> '' GROUP BY ALL),
lex AS (SELECT term, pos, sum(score / rank) / sum(1.0 / rank) AS score FROM ranked GROUP BY ALL),
wide AS (SELECT term, coalesce(sum(score) FILTER (pos = 'a'), 0) AS s_a,
                coalesce(sum(score) FILTER (pos = 'r'), 0) AS s_r,
                coalesce(sum(score) FILTER (pos = 'n'), 0) AS s_n,
                coalesce(sum(score) FILTER (pos = 'v'), 0) AS s_v FROM lex GROUP BY term)"""

SENTENCE_LIST = r"""list_filter(regexp_split_to_array(regexp_replace(text, '[-+^:]', '', 'g'), '[.!?\n]+'),
                                lambda x: trim(x) <> '')"""

SENTENCES = rf"""sents AS (
  SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS sentence_no
  FROM (SELECT doc_id, {SENTENCE_LIST} AS s FROM documents))"""

LOOKUP_LIST = r"""list_filter(list_transform(regexp_split_to_array(lower(sentence), '[^\p{L}]+'),
    lambda w: regexp_replace(w, '[^a-zA-Z\s]', '', 'g')), lambda w: w <> '')"""

SENTENCE_SCORES = rf"""{SENTENCES},
toks AS (SELECT doc_id, sentence_no, unnest({LOOKUP_LIST}) AS term FROM sents),
hits AS (SELECT doc_id, sentence_no, sum(s_a) AS a, sum(s_r) AS r, sum(s_n) AS n, sum(s_v) AS v
         FROM toks JOIN wide USING (term) GROUP BY ALL),
sscore AS (SELECT doc_id, sentence_no, coalesce(a, 0) AS score_adj, coalesce(r, 0) AS score_adv,
                  coalesce(n, 0) AS score_noun, coalesce(v, 0) AS score_verb
           FROM sents LEFT JOIN hits USING (doc_id, sentence_no)),
graded AS (SELECT *, round(score_adj + score_adv + score_noun + score_verb, 9) AS total FROM sscore),
classed AS (SELECT *, CASE WHEN total >= 0.75 THEN 4 WHEN total > 0 THEN 3 WHEN total <= -0.75 THEN 0
                           WHEN total < 0 THEN 1 ELSE 2 END AS overall FROM graded)"""

VECTORS = f"""{LEX}, {SENTENCE_SCORES},
means AS (SELECT doc_id, avg(score_adj) AS score_adj, avg(score_adv) AS score_adv, avg(score_noun) AS score_noun,
                 avg(score_verb) AS score_verb, avg(overall - 2.0) AS score_all FROM classed GROUP BY doc_id),
vec AS (SELECT doc_id, lang, source, {", ".join(f"coalesce({f}, 0) AS {f}" for f in FEATURES)}
        FROM documents LEFT JOIN means USING (doc_id))"""

TRAINING = f"{LABELS}, {VECTORS}, train AS (SELECT *, lang AS domain FROM vec JOIN lab USING (doc_id))"


def melted(source: str, keep: str) -> str:
    """Long form (keep, feature, x) of a table of vectors."""
    parts = [f"SELECT {keep}, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM {source}" for f in FEATURES]
    return " UNION ALL ".join(parts)


def gaussian_sql(train: str, rows: str, model: list[str], row: list[str], p: str = "") -> str:
    """CTEs from training rows to class probabilities of rows.

    ``model`` lists the columns that name a model, ``row`` those that name a row;
    rows meet the models they share columns with.
    """
    shared = [c for c in model if c in row]
    out = [*row, *[c for c in model if c not in row]]
    m, o = ", ".join(model), ", ".join(out)
    return f"""{p}long AS ({melted(train, m + ", label")}),
{p}stats AS (SELECT {m}, label, feature, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM {p}long GROUP BY ALL),
{p}floors AS (SELECT {m}, CASE WHEN max(var) > 0 THEN max(var) * 1e-9 ELSE 1e-9 END AS eps FROM {p}stats GROUP BY ALL),
{p}prior AS (SELECT {m}, label, ln(n * 1.0 / sum(n) OVER (PARTITION BY {m})) AS prior
             FROM (SELECT DISTINCT {m}, label, n FROM {p}stats)),
{p}xs AS ({melted(rows, ", ".join(row))}),
{p}ll AS (SELECT {o}, label, any_value(prior) + sum(
    (CASE WHEN feature = 'score_all' THEN 2.0 ELSE 1.0 END)
    * (-0.5 * ln(2 * pi() * (var + eps)) - (x - mean) * (x - mean) / (2 * (var + eps)))) AS score
  FROM {p}xs JOIN {p}stats USING ({", ".join([*shared, "feature"])}) JOIN {p}floors USING ({m})
       JOIN {p}prior USING ({m}, label)
  GROUP BY ALL),
{p}raised AS (SELECT *, exp(score - max(score) OVER (PARTITION BY {o})) AS e FROM {p}ll),
{p}probs AS (SELECT {o}, label, e / sum(e) OVER (PARTITION BY {o}) AS prob FROM {p}raised)"""


# Equal probabilities go to the class that comes first by name, that is ``neg``.
ARGMAX = "arg_max(label, (prob, CASE WHEN label = 'neg' THEN 1 ELSE 0 END))"

NB = f"""{TRAINING}, {gaussian_sql("train", "train", ["domain"], ["doc_id", "domain"])},
best AS (SELECT doc_id, {ARGMAX} AS predicted, max(prob) AS top FROM probs GROUP BY doc_id),
scored AS (SELECT doc_id, domain, label, predicted, top FROM train JOIN best USING (doc_id))"""


def measures_sql(probs: str, scored: str, keys: list[str]) -> str:
    """CTEs with the quality measures of scored rows per key; ``probs`` holds every class of a row."""
    k = ", ".join(keys)
    return f"""errs AS (SELECT {k}, avg(abs(p.prob - (p.label = s.label)::INT)) AS mean_abs_err,
    sqrt(avg(power(p.prob - (p.label = s.label)::INT, 2))) AS root_mean_sq_err
  FROM (SELECT doc_id, label, prob FROM {probs}) p JOIN {scored} s USING (doc_id) GROUP BY ALL),
cells AS (SELECT {k}, label, predicted, count(*) AS n FROM {scored} GROUP BY ALL),
tot AS (SELECT {k}, sum(n) AS n, coalesce(sum(n) FILTER (label = predicted), 0) / sum(n) AS po FROM cells GROUP BY ALL),
chance AS (SELECT {k}, sum(a.n * b.n) AS c FROM (SELECT {k}, label AS cls, sum(n) AS n FROM cells GROUP BY ALL) a
  JOIN (SELECT {k}, predicted AS cls, sum(n) AS n FROM cells GROUP BY ALL) b USING ({k}, cls) GROUP BY ALL),
measures AS (SELECT {k}, CAST(n AS BIGINT) AS n, po AS accuracy,
    CASE WHEN coalesce(c, 0) / (n * n) < 1 THEN (po - coalesce(c, 0) / (n * n)) / (1 - coalesce(c, 0) / (n * n)) ELSE 0 END AS kappa,
    mean_abs_err, root_mean_sq_err, (1 - po) * 100 AS pct_incorrect
  FROM tot LEFT JOIN chance USING ({k}) JOIN errs USING ({k}))"""


MEASURES = ["accuracy", "kappa", "mean_abs_err", "root_mean_sq_err", "pct_incorrect"]
ROUNDED_MEASURES = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)

# The words of a text: acronyms, words with apostrophes, runs of letters and digits.
WORD_LIST = r"""list_transform(regexp_extract_all(text, '\p{L}\.(?:\p{L}\.)+|\p{L}+(?:[''’]\p{L}+)+|[\p{L}\p{N}]+'),
    lambda w: lower(regexp_replace(replace(w, '.', ''), '[''’][sS]$', '')))"""

STOPS = (
    "['a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or',"
    "'such','that','the','their','then','there','these','they','this','to','was','will','with']"
)
IS_STOP = f"(list_contains({STOPS}, w) OR regexp_matches(w, '^[ -~]$'))"
