"""Registered queries: streams that take in a table that Spark wrote as files, then stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.operators import bayes
from tonemill.operators.vectors import FEATURE_WEIGHTS, FEATURES, sentiment_vectors
from tonemill.plans.fixtures import (
    ARGMAX, LABELS, TRAINING, WORD_LIST, documents, gaussian_sql, labelled_texts, lexicon, melted, query, table, training, with_labels,
)
from tonemill.plans import training as plans
from tonemill.plans.queries_ingest import _FLAT, flat_text
from tonemill.session import durable, scratch
from tonemill.sources import requests
from tonemill.streaming import sources as streams
from tonemill.streaming import training as learning

ROW_SCHEMA = "doc_id long, domain string, text string, label string"


#: Micro-batches in which the streams take in what is there, at most.
BATCHES = 4


def _pieces(spark, sf) -> int:
    """Files of an inbox: each core has one in every micro-batch, and a larger table has more of them, not larger ones."""
    return BATCHES * max(spark.sparkContext.defaultParallelism, table(spark, sf, "documents").rdd.getNumPartitions())


def _share(spark, path: str, batches: int) -> int:
    """Files per trigger that make ``batches`` micro-batches of the files of an inbox."""
    return -(-len(spark.read.text(path).inputFiles()) // batches)


def _inbox(spark, sf) -> str:
    """Labelled rows as files that arrive over several micro-batches."""
    path = scratch(spark, "inbox")
    rows = labelled_texts(spark, sf, ["lang"]).select("doc_id", F.col("lang").alias("domain"), "text", "label")
    rows.repartition(_pieces(spark, sf), "doc_id").write.parquet(path)
    return path


_COUNTED = f"""toks AS (SELECT doc_id, unnest({WORD_LIST}) AS term FROM documents),
  tl AS (SELECT lang AS domain, label, term AS feature, count(*) AS n
         FROM toks JOIN lab USING (doc_id) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL
         UNION ALL SELECT lang, label, '', count(*) FROM documents JOIN lab USING (doc_id) GROUP BY ALL)"""


@query("t1_stream_word_training", f"WITH {LABELS}, {_COUNTED} SELECT domain, label, feature, n FROM tl")
def t1(spark, sf):
    """Counts kept as stream state over several micro-batches equal the counts of one batch."""
    inbox = _inbox(spark, sf)
    stream = streams.file_stream(spark, inbox, ROW_SCHEMA, files_per_trigger=_share(spark, inbox, 2))
    out, checkpoint = scratch(spark, "snapshots"), scratch(spark, "progress")
    learning.train_words(stream, out, checkpoint, flush=True).awaitTermination()
    return learning.snapshot_counts(spark, out)


_STATS = f"""{TRAINING}, long AS ({melted("train", "domain, label")})
  SELECT domain, label, feature, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x) * count(*), 6) AS m2
  FROM long GROUP BY ALL"""


@query("t1_stream_vector_training", f"WITH {_STATS}")
def t1_vectors(spark, sf):
    """The merged increments of several micro-batches equal one batch."""
    inbox = _inbox(spark, sf)
    stream = streams.file_stream(spark, inbox, ROW_SCHEMA, files_per_trigger=_share(spark, inbox, 2))
    out, checkpoint = scratch(spark, "increments"), scratch(spark, "progress")
    learning.train_vectors(stream, lexicon(spark), out, checkpoint, flush=True).awaitTermination()
    merged = learning.merged_increments(spark, out)
    return merged.select("domain", "label", "feature", "n", F.round("mean", 6).alias("mean"), F.round("m2", 6).alias("m2"))


@query("t2_snapshots", f"WITH {LABELS}, {_COUNTED} SELECT 1 AS after_first, 1 AS after_second, count(*) AS n_rows, sum(n)::BIGINT AS n FROM tl")
def t2(spark, sf):
    """Two runs with nothing new between them: the idle run writes no snapshot."""
    inbox = _inbox(spark, sf)
    stream = streams.file_stream(spark, inbox, ROW_SCHEMA, files_per_trigger=_share(spark, inbox, 1))
    out, checkpoint = scratch(spark, "snapshots"), scratch(spark, "progress")
    seen = []
    for _ in range(2):
        learning.train_words(stream, out, checkpoint, flush=True).awaitTermination()
        batches = learning.read_batches(spark, out, learning.COUNT_SCHEMA)
        seen.append(batches.agg(F.countDistinct("batch_id")).first()[0])
    # One snapshot after the first run, and still one after the second.
    state = learning.snapshot_counts(spark, out)
    return state.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n")).select(
        F.lit(seen[0]).cast("int").alias("after_first"), F.lit(seen[1]).cast("int").alias("after_second"),
        "n_rows", "n",
    )


@query("t3_flush", f"""WITH {LABELS} SELECT lang AS domain, label, count(*) AS n FROM documents JOIN lab USING (doc_id) GROUP BY ALL""")
def t3(spark, sf):
    """All pending rows are in the model when the flush ends."""
    inbox = _inbox(spark, sf)
    stream = streams.file_stream(spark, inbox, ROW_SCHEMA, files_per_trigger=_share(spark, inbox, BATCHES))
    out, checkpoint = scratch(spark, "snapshots"), scratch(spark, "progress")
    learning.train_words(stream, out, checkpoint, flush=True).awaitTermination()
    return learning.snapshot_counts(spark, out).filter(F.col("feature") == "").select("domain", "label", "n")


@query("t5_stream_scoring", f"""WITH {TRAINING}, {gaussian_sql("train", "vd", ["domain"], ["doc_id", "domain"])
  .replace("FROM vd", "FROM (SELECT *, lang AS domain FROM vec)")}
  SELECT doc_id, domain, {ARGMAX} AS predicted, round(max(prob), 6) AS prob FROM probs GROUP BY doc_id, domain""")
def t5(spark, sf):
    """New documents arrive as a stream and meet the stored models."""
    path, out, checkpoint = scratch(spark, "inbox"), scratch(spark, "answers"), scratch(spark, "progress")
    docs = documents(spark, sf).select("doc_id", F.col("lang").alias("domain"), "text")
    docs.repartition(_pieces(spark, sf), "doc_id").write.parquet(path)
    stats = durable(bayes.gaussian_fit(training(spark, sf), FEATURES, ["domain"]), "params")
    model, words = bayes.prepare_members(stats, FEATURES, FEATURE_WEIGHTS), lexicon(spark)

    def score(batch: DataFrame) -> DataFrame:
        vectors = sentiment_vectors(batch, words, keep=["domain"])
        scored = bayes.classify_vectors(vectors, model, FEATURES, spread=["doc_id"])
        return scored.select("doc_id", "domain", "predicted", "prob")

    stream = streams.file_stream(spark, path, "doc_id long, domain string, text string", files_per_trigger=_share(spark, path, 2))
    learning.score_stream(stream, score, out, checkpoint, flush=True).awaitTermination()
    answers = learning.read_batches(spark, out, "doc_id long, domain string, predicted string, prob double")
    return answers.select("doc_id", "domain", "predicted", F.round("prob", 6).alias("prob"))


def _swapped(train: str, rows_: str, p: str) -> str:
    first = f"{p}train AS (SELECT * FROM train WHERE {train}), {p}vd AS (SELECT *, lang AS domain FROM vec WHERE {rows_})"
    return f"""{first}, {gaussian_sql(p + "train", p + "vd", ["domain"], ["doc_id", "domain"], p)}"""


@query("t5_refreshed_model", f"""WITH {TRAINING}, {_swapped("source < 'src2'", "source < 'src2'", "a_")}, {_swapped("TRUE", "source >= 'src2'", "b_")}
  SELECT doc_id, domain, {ARGMAX} AS predicted, round(max(prob), 6) AS prob
  FROM (SELECT doc_id, domain, label, prob FROM a_probs UNION ALL SELECT doc_id, domain, label, prob FROM b_probs) GROUP BY doc_id, domain""")
def t5_refreshed(spark, sf):
    """One running query: the model is replaced between its two micro-batches, and the second one is scored with the new model."""
    path, registry_path = scratch(spark, "inbox"), scratch(spark, "registry")
    out, checkpoint = scratch(spark, "answers"), scratch(spark, "progress")
    texts = labelled_texts(spark, sf, ["lang", "source"]).withColumnRenamed("lang", "domain")
    options, early = plans.FeatureOptions(lexicon=lexicon(spark)), F.col("source") < "src2"
    plans.build(texts.filter(early), registry_path, 1, features=options)
    docs = documents(spark, sf).select("doc_id", F.col("lang").alias("domain"), "text", "source")
    first = 0
    for part in (early, ~early):
        docs.filter(part).drop("source").repartition(_pieces(spark, sf), "doc_id").write.mode("append").parquet(path)
        first = first or _share(spark, path, 1)  # the first micro-batch is the first part
    scorer, calls = learning.RegistryScorer(spark, registry_path), []

    def score(batch: DataFrame) -> DataFrame:
        if len(calls) == 1:  # somebody trains again while the stream runs
            plans.rebuild(texts, registry_path, 2, features=options)
        calls.append(1)
        return scorer(batch)

    stream = streams.file_stream(spark, path, "doc_id long, domain string, text string", files_per_trigger=first)
    learning.score_stream(stream, score, out, checkpoint, flush=True).awaitTermination()
    answers = learning.read_batches(spark, out, "doc_id long, domain string, predicted string, prob double")
    return answers.select("doc_id", "domain", "predicted", F.round("prob", 6).alias("prob"))


@query("t1_compacted_snapshots", f"WITH {LABELS}, {_COUNTED} SELECT domain, label, feature, n FROM tl")
def t1_compacted(spark, sf):
    """A snapshot per micro-batch, merged to a base after every second one and when the query ends."""
    inbox = _inbox(spark, sf)
    stream = streams.file_stream(spark, inbox, ROW_SCHEMA, files_per_trigger=_share(spark, inbox, BATCHES))
    out, checkpoint = scratch(spark, "snapshots"), scratch(spark, "progress")
    query_ = learning.train_words(stream, out, checkpoint, flush=True, compact_every=2, snapshot_at_end=True)
    query_.awaitTermination()
    learning.stop_training(query_)
    return learning.snapshot_counts(spark, out)


@query("s8_message_stream", f"""WITH {LABELS} SELECT lang AS domain, label, md5(text) AS digest, count(*) AS n
  FROM documents JOIN lab USING (doc_id) GROUP BY ALL""")
def s8(spark, sf):
    """Training messages as lines of JSON, routed by their domain column."""
    path, out, checkpoint = scratch(spark, "messages"), scratch(spark, "rows"), scratch(spark, "progress")
    texts = labelled_texts(spark, sf, ["lang"])
    one = F.array(F.struct(F.col("text"), F.col("label").alias("textClass")))
    requests.to_requests(texts, "lang", ["neg", "pos"], one, []).repartition(_pieces(spark, sf)).write.text(path)
    rows = streams.message_stream(spark, path, files_per_trigger=_share(spark, path, 2))
    writer = rows.writeStream.format("parquet").option("path", out)
    learning.start(writer, checkpoint, flush=True).awaitTermination()
    taken = spark.read.parquet(out)
    return taken.groupBy("domain", "label", F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


_NOT_ROWS = """CASE WHEN label IS NOT NULL THEN NULL WHEN lang = 'en' THEN 'no JSON object' WHEN lang = 'de' THEN 'no rows' ELSE 'row has no text or no class' END"""


@query("s8_message_rejects", f"""WITH {LABELS} SELECT {_NOT_ROWS} AS reason, count(*) AS n FROM documents LEFT JOIN lab USING (doc_id) GROUP BY ALL""")
def s8_rejects(spark, sf):
    """Messages of all documents; those without a label make messages that cannot be used, in ways told by their language."""
    path, checkpoint = scratch(spark, "messages"), scratch(spark, "progress")
    out, aside = scratch(spark, "rows"), scratch(spark, "rejects")
    docs = with_labels(spark, sf, documents(spark, sf).select("doc_id", "lang", "text"), "left")
    row = F.array(F.struct("text", F.col("label").alias("textClass")))
    whole = F.to_json(F.struct(F.col("lang").alias("domain"), row.alias("dataSet")))
    bare = F.to_json(F.struct(F.col("lang").alias("domain"), F.slice(row, 1, 0).alias("dataSet")))
    unusable = F.when(F.col("lang") == "en", F.concat(F.lit("= "), F.md5("text"))).when(F.col("lang") == "de", bare).otherwise(whole)
    docs.select(F.when(F.col("label").isNotNull(), whole).otherwise(unusable).alias("value")).repartition(_pieces(spark, sf)).write.text(path)
    lines = streams.raw_messages(spark, path, files_per_trigger=_share(spark, path, 2))
    learning.store_messages(lines, out, aside, checkpoint, flush=True).awaitTermination()
    taken = spark.read.parquet(f"{out}/batch=*").select(F.lit(None).cast("string").alias("reason"))
    return taken.union(spark.read.parquet(f"{aside}/batch=*").select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_JOBS = f"""WITH {LABELS} SELECT CASE WHEN lang = 'es' THEN '$DEF' ELSE lang END AS domain, label, md5({_FLAT}) AS digest,
  count(*) AS n FROM documents JOIN lab USING (doc_id) GROUP BY ALL"""


@query("t4_trigger_loads", _JOBS)
def t4(spark, sf):
    """A corpus of lines per language, and a manifest per language that sets off its load."""
    root, jobs = scratch(spark, "corpora"), scratch(spark, "jobs")
    out, checkpoint = scratch(spark, "loaded"), scratch(spark, "progress")
    texts = labelled_texts(spark, sf, ["lang"])
    code = F.when(F.col("label") == "neg", "0").otherwise("1")
    lines = texts.select("lang", F.concat_ws("\t", flat_text(), code).alias("value"))
    lines.write.partitionBy("lang").text(root)
    manifest = F.concat_ws(
        "\n", F.concat(F.lit(f"{root}/lang="), F.col("lang")),
        F.when(F.col("lang") == "es", "").otherwise(F.col("lang")), F.lit("true"), F.lit("sentence score"),
    )
    names = texts.select("lang").distinct().select(manifest.alias("value"))
    names.write.option("maxRecordsPerFile", 1).text(jobs)

    def handle(rows: DataFrame, domain: str, job_id: str) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/job={job_id}")

    # The writer names its files itself, so the ending to look for is given.
    triggers = streams.trigger_stream(spark, jobs, glob="*.txt")
    learning.run_triggers(triggers, handle, checkpoint, flush=True).awaitTermination()
    loaded = spark.read.parquet(f"{out}/job=*")
    return loaded.groupBy("domain", "label", F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("s7_new_files", f"""WITH {LABELS} SELECT doc_id, label FROM documents JOIN lab USING (doc_id)""")
def s7(spark, sf):
    """Files that are there at the start and files that come later are each taken once."""
    path, out, checkpoint = scratch(spark, "inbox"), scratch(spark, "rows"), scratch(spark, "progress")
    rows = labelled_texts(spark, sf, ["lang"]).select("doc_id", F.col("lang").alias("domain"), "text", "label")
    for name in ("neg", "pos"):
        rows.filter(F.col("label") == name).write.mode("append").parquet(path)
        stream = streams.file_stream(spark, path, ROW_SCHEMA).select("doc_id", "label")
        writer = stream.writeStream.format("parquet").option("path", out)
        learning.start(writer, checkpoint, flush=True).awaitTermination()
    return spark.read.parquet(out)
