"""Registered queries: corpora, labelled lines, requests, payloads, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions.text import sentences
from tonemill.operators import evaluate
from tonemill.plans.fixtures import (
    LABELS, SENTENCE_LIST, documents, labelled_texts, labels, query, table,
)
from tonemill.session import scratch
from tonemill.sources import corpus, files, requests

_FLAT = "translate(text, chr(10) || chr(9) || chr(13), '   ')"


def flat_text():
    return F.translate("text", "\n\t\r", "   ")


def write_class_dirs(spark, sf) -> str:
    """One folder per class and one file per labelled document, written in parallel."""
    root = scratch(spark, "classes")
    texts = labelled_texts(spark, sf).select("label", "text")
    names = ["neg", "pos"]
    if (local := files.local_path(spark, root)) is not None:
        files.write_files(texts, local, names)
        return root
    for name in names:
        part = texts.filter(F.col("label") == name).select("text")
        part.write.option("maxRecordsPerFile", 1).text(f"{root}/{name}")
    return root


def _class_rows(spark, sf) -> tuple[DataFrame, str]:
    root = write_class_dirs(spark, sf)
    return corpus.read_class_dirs(spark, root), root


@query("s1_class_dirs", f"""WITH {LABELS} SELECT label, md5(rtrim(text, chr(10))) AS digest, count(*) AS n
  FROM documents JOIN lab USING (doc_id) GROUP BY ALL""")
def s1(spark, sf):
    found, _ = _class_rows(spark, sf)
    # The writer ends every file with a line break.
    digest = F.md5(F.rtrim(F.col("text"), F.lit("\n"))).alias("digest")
    return found.groupBy("label", digest).agg(F.count(F.lit(1)).alias("n"))


@query("a17_ingest_audit", """SELECT count(*) AS n_rows, count(*) AS n_files_used, count(*) AS n_files, false AS differs
  FROM documents JOIN labels USING (doc_id)""")
def a17(spark, sf):
    found, root = _class_rows(spark, sf)
    return evaluate.ingest_audit(found, corpus.class_dir_files(spark, root))


# Documents as lines: labelled ones carry their code, French ones without a label a word that
# is no code, the other ones nothing.
_LINES = f"""lines AS (SELECT CASE WHEN l.doc_id IS NOT NULL THEN {_FLAT} || chr(9) || toxic
    WHEN lang = 'fr' THEN {_FLAT} || chr(9) || 'pos' WHEN lang = 'de' THEN {_FLAT} || chr(9) || lang
    ELSE {_FLAT} END AS value, {_FLAT} AS flat, toxic, lang, l.doc_id IS NOT NULL AS labelled
  FROM documents LEFT JOIN labels l USING (doc_id))"""


def lines_of(spark, sf) -> DataFrame:
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    code = (
        F.when(F.col("toxic").isNotNull(), F.col("toxic").cast("string"))
        .when(F.col("lang") == "fr", "pos").when(F.col("lang") == "de", F.col("lang"))
    )
    return docs.select(F.concat_ws("\t", flat_text(), code).alias("value"))


def write_lines(spark, sf) -> str:
    path = scratch(spark, "lines")
    lines_of(spark, sf).write.text(path)
    return path


@query("s2_labelled_lines", f"""WITH {_LINES} SELECT label, md5(flat) AS digest, count(*) AS n FROM (
  SELECT flat, CASE WHEN labelled THEN (CASE toxic WHEN 1 THEN 'pos' ELSE 'neg' END) WHEN lang = 'fr' THEN 'pos' END AS label FROM lines)
  WHERE label IS NOT NULL GROUP BY ALL""")
def s2(spark, sf):
    good, _ = corpus.read_labelled_lines(spark, write_lines(spark, sf), "sentence score")
    return good.groupBy("label", F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("s3_line_format", f"""WITH {LABELS} SELECT CASE label WHEN 'neg' THEN 'bad' ELSE 'good' END AS label,
  md5({_FLAT}) AS digest, count(*) AS n FROM documents JOIN lab USING (doc_id) GROUP BY ALL""")
def s3(spark, sf):
    """Lines with the class first and classes named by the format."""
    code = F.when(F.col("label") == "neg", "-1").otherwise("+7")
    lines = labelled_texts(spark, sf).select(F.concat_ws("\t", code, flat_text()).alias("value"))
    path = scratch(spark, "lines")
    lines.write.text(path)
    good, _ = corpus.read_labelled_lines(spark, path, "Score_code text -1=bad;7=good;x=none")
    return good.groupBy("label", F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("r2_rejected_lines", f"""WITH {_LINES} SELECT md5(value) AS digest,
  CASE WHEN lang = 'de' THEN 'class code is not in the format' ELSE 'line has not two fields' END AS reason, count(*) AS n
  FROM lines WHERE NOT labelled AND lang <> 'fr' GROUP BY ALL""")
def r2(spark, sf):
    _, bad = corpus.read_labelled_lines(spark, write_lines(spark, sf), "sentence score")
    return bad.groupBy(F.md5("value").alias("digest"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("a17_line_audit", f"""WITH {_LINES}, n AS (SELECT count(*) AS n_read, count(*) FILTER (labelled OR lang = 'fr') AS n_kept FROM lines)
  SELECT 'whole' AS load, n_read, n_kept, n_read - n_kept AS n_rejected, 0 AS n_lost, false AS differs FROM n UNION ALL
  SELECT 'cut', n_read, n_kept, 0, n_read - n_kept, n_read <> n_kept FROM n""")
def a17_lines(spark, sf):
    """A load that accounts for all lines, and one whose rejects were thrown away."""
    path = write_lines(spark, sf)
    good, bad = corpus.read_labelled_lines(spark, path, "sentence score")
    audit = lambda name, rejected: evaluate.line_audit(spark.read.text(path), good, rejected).withColumn("load", F.lit(name))
    return audit("whole", bad).union(audit("cut", bad.limit(0))).select("load", "n_read", "n_kept", "n_rejected", "n_lost", "differs")


@query("a17_observed_audit", f"""WITH {_LINES}, n AS (SELECT count(*) AS n_read, count(*) FILTER (labelled OR lang = 'fr') AS n_kept FROM lines)
  SELECT 'whole' AS load, n_read, n_kept, n_read - n_kept AS n_rejected, 0 AS n_lost, false AS differs FROM n UNION ALL
  SELECT 'cut', n_read, n_kept, 0, n_read - n_kept, n_read <> n_kept FROM n""")
def a17_observed(spark, sf):
    """The same loads, counted while they are stored; the second one throws away what it cannot use."""
    lines = spark.read.text(write_lines(spark, sf)).select("value")
    whole = lambda d: corpus.split_lines(d, corpus.parse_format("sentence score"))
    cut = lambda d: whole(d).filter("reason is null")
    audits = [evaluate.observed_load(lines, split, scratch(spark, "load"))[2].withColumn("load", F.lit(name)) for name, split in (("whole", whole), ("cut", cut))]
    return audits[0].union(audits[1]).select("load", "n_read", "n_kept", "n_rejected", "n_lost", "differs")


@query("j2_score_mapping", """SELECT doc_id, CASE quality WHEN 0 THEN 'poor' ELSE '1' END AS label FROM labels""")
def j2(spark, sf):
    """A code outside the map stays as it is."""
    code = corpus.map_class(F.col("quality").cast("string"), {0: "poor", 2: "fine"})
    return table(spark, sf, "labels").select("doc_id", code.alias("label"))


@query("s4_json_requests", f"""WITH {LABELS},
  s AS (SELECT doc_id, lang, source, {SENTENCE_LIST} AS s FROM documents)
  SELECT doc_id, CASE WHEN lang = 'es' THEN '$DEF' ELSE source END AS domain, true AS use_sentiment_vector, row_no,
         md5(sentence) AS digest, label
  FROM (SELECT doc_id, lang, source, unnest(s) AS sentence, unnest(range(len(s))) AS row_no FROM s) JOIN lab USING (doc_id)""")
def s4(spark, sf):
    """A request per document, with a row per sentence; sentences of unlabelled documents have no class."""
    docs = documents(spark, sf).join(labels(spark, sf), "doc_id", "left")
    named = docs.withColumn("domain", F.when(F.col("lang") != "es", F.col("source")))
    tuples = F.transform(
        sentences(F.col("text")), lambda s: F.struct(s.alias("text"), F.col("label").alias("textClass"))
    )
    made = requests.to_requests(named, "domain", ["neg", "pos"], tuples, ["doc_id"])
    rows = requests.parse_requests(made, "value", ["doc_id"])
    return rows.select(
        "doc_id", "domain", "use_sentiment_vector", "row_no", F.md5("text").alias("digest"), "label"
    )


@query("s4_request_rejects", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 END AS row_no,
  CASE doc_id % 4 WHEN 0 THEN 'row has no text or no class' WHEN 1 THEN 'no JSON object' ELSE 'no rows' END AS reason, 1 AS n
  FROM documents WHERE doc_id % 4 < 3 UNION ALL
  SELECT doc_id, 0 AS row_no, 'kept' AS reason, 1 AS n FROM documents WHERE doc_id % 4 IN (0, 3)""")
def s4_rejects(spark, sf):
    """A request per document; by turns with a row that has no class, broken, without rows, and sound."""
    turn = F.col("doc_id") % 4
    row = F.struct(F.translate("text", "\n\t\r", "   ").alias("text"), F.col("lang").alias("textClass"))
    unclassed = F.struct(F.lit("x").alias("text"), F.lit(None).cast("string").alias("textClass"))
    rows = F.when(turn == 0, F.array(row, unclassed)).when(turn == 3, F.array(row)).otherwise(F.slice(F.array(row), 1, 0))
    whole = requests.to_requests(documents(spark, sf), "lang", ["en", "fr"], rows, ["doc_id"])
    broken = F.when(turn == 1, F.concat(F.lit("{"), "value")).otherwise(F.col("value"))
    good, bad = requests.split_requests(whole.withColumn("value", broken), "value", ["doc_id"])
    told = good.select("doc_id", F.col("row_no").cast("int").alias("row_no"), F.lit("kept").alias("reason"))
    return told.union(bad.select("doc_id", "row_no", "reason")).withColumn("n", F.lit(1))


@query("s5_payload_faults", """SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 3) THEN 'row' ELSE 'reject' END AS outcome,
  CASE doc_id % 7 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'json' WHEN 3 THEN 'csv' WHEN 4 THEN 'csv' WHEN 5 THEN 'arff' ELSE 'reject' END AS form
  FROM documents""")
def s5_faults(spark, sf):
    """Each payload is in exactly one output: sound ones, and those of every kind of fault."""
    turn = F.col("doc_id") % 7
    flat = F.translate("text", "\n\t\r'\"\\", "      ")
    body = (
        F.when(turn == 0, F.to_json(F.struct(F.array(F.struct(flat.alias("text"), F.lit("x").alias("textClass"))).alias("dataSet"))))
        .when(turn == 1, '{"dataSet": [{"text": "without a class"}]}')
        .when(turn == 2, F.concat(F.lit('{"dataSet": [{"text": "'), flat))
        .when(turn == 3, F.concat(F.lit('text,class\n"two\nlines '), flat, F.lit('",x\n')))
        .when(turn == 4, F.concat(F.lit('text,class\n"'), flat, F.lit('",\n')))
        .when(turn == 5, "@relation r\n@attribute text string\n@data\n")
        .otherwise("bare words")
    )
    rows, rejects = requests.parse_payloads(documents(spark, sf).select("doc_id", body.alias("payload")), "payload", ["doc_id"])
    return rows.select("doc_id", F.lit("row").alias("outcome"), "form").union(rejects.select("doc_id", F.lit("reject"), "form"))


_QUOTABLE = "translate(text, chr(10) || chr(9) || chr(13) || chr(39) || chr(34) || chr(92), '      ')"


def payloads(spark, sf) -> DataFrame:
    """Documents as messages: English in ARFF, French in CSV, German in JSON, Spanish as bare text."""
    docs = documents(spark, sf).select(
        "doc_id", "lang", F.translate("text", "\n\t\r'\"\\", "      ").alias("flat")
    )
    arff = F.concat(
        F.lit("% made from a document\n@RELATION docs\n@attribute class {en,fr}\n@attribute text string\n@data\nen,'"),
        F.col("flat"), F.lit("'\n"),
    )
    csv = F.concat(F.lit('text,class\n"'), F.col("flat"), F.lit('",fr\n'))
    json = F.to_json(
        F.struct(
            F.lit("docs").alias("domain"),
            F.array(F.struct(F.col("flat").alias("text"), F.col("lang").alias("textClass"))).alias("dataSet"),
        )
    )
    body = (
        F.when(F.col("lang") == "en", arff).when(F.col("lang") == "fr", csv).when(F.col("lang") == "de", json)
        .otherwise(F.col("flat"))
    )
    return docs.select("doc_id", body.alias("payload"))


@query("s5_payload_rows", f"""SELECT doc_id, CASE lang WHEN 'en' THEN 'arff' WHEN 'fr' THEN 'csv' ELSE 'json' END AS form,
  md5(trim({_QUOTABLE})) AS digest, lang AS label FROM documents WHERE lang <> 'es'""")
def s5(spark, sf):
    rows, _ = requests.parse_payloads(payloads(spark, sf), "payload", ["doc_id"])
    return rows.select("doc_id", "form", F.md5(F.trim("text")).alias("digest"), "label")


@query("s5_payload_rejects", f"""SELECT doc_id, 'reject' AS form, md5({_QUOTABLE}) AS digest FROM documents
  WHERE lang = 'es' AND NOT contains(text, ',') UNION ALL
  SELECT doc_id, 'csv', md5({_QUOTABLE}) FROM documents WHERE lang = 'es' AND contains(text, ',')""")
def s5_rejects(spark, sf):
    """Bare text shows no form; with a comma it looks like a header that no row follows."""
    _, bad = requests.parse_payloads(payloads(spark, sf), "payload", ["doc_id"])
    return bad.select("doc_id", "form", F.md5("payload").alias("digest"))


@query("s6_job_manifests", """SELECT doc_id, 'corpus/' || source AS dir, CASE WHEN lang = 'es' THEN '$DEF' ELSE lang END AS domain,
  n_chars > 1000 AS tabbed, CASE WHEN n_chars > 1000 THEN 'sentence score' END AS format FROM documents""")
def s6(spark, sf):
    """A manifest per document; Spanish ones name no domain, short ones no format."""
    long_text = F.col("n_chars") > 1000
    content = F.concat_ws(
        "\n", F.concat(F.lit("corpus/"), F.col("source")), F.when(F.col("lang") == "es", "").otherwise(F.col("lang")),
        F.when(long_text, "TRUE").otherwise("no"), F.when(long_text, "sentence score"),
    )
    made = documents(spark, sf).select("doc_id", content.alias("value"))
    return requests.parse_manifests(made, "value", ["doc_id"])


@query("r4_file_ending", f"""WITH {LABELS} SELECT doc_id, label FROM documents JOIN lab USING (doc_id)""")
def r4(spark, sf):
    """Files of two endings in one folder; only those with the wanted ending are read."""
    path = scratch(spark, "mixed")
    rows = labelled_texts(spark, sf).select("doc_id", "label")
    rows.write.mode("append").json(path)
    rows.withColumn("label", F.lit("wrong")).write.mode("append").csv(path)
    return spark.read.schema("doc_id long, label string").option("pathGlobFilter", "*.json").json(path)
