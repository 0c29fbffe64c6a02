"""Continuous training, snapshots, directory jobs and scoring of streams.

Increments and snapshots are written below a path of their own per micro-batch and
replace what an interrupted attempt of the same batch left there, so a restart from
the checkpoint neither loses nor doubles rows.  They are merged to a base from time to time, so a
reader meets a bounded number of folders however long a stream runs.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tonemill.operators import bayes, counts
from tonemill.operators.joins import Lookup
from tonemill.operators.rows import usable_rows, with_domain
from tonemill.operators.vectors import FEATURES, sentiment_vectors
from tonemill.operators.words import with_terms
from tonemill.plans.training import classify, load_model, prepare_model
from tonemill.sources.corpus import read_class_dirs, read_labelled_lines
from tonemill.sources.lexicon import prepare_lexicon
from tonemill.sources.registry import models_version
from tonemill.sources.requests import split_requests
from tonemill.streaming.sources import with_default_domain

SNAPSHOT_INTERVAL = "60 seconds"
COUNT_SCHEMA = "domain string, label string, feature string, n long, batch_id long"
VECTOR_SCHEMA = "domain string, label string, feature string, n long, mean double, m2 double, batch_id long"
#: Batch folders that a reader meets at most beside the merged base.
COMPACT_EVERY = 20
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(
    writer, checkpoint: str, flush: bool = False, interval: str = SNAPSHOT_INTERVAL
) -> StreamingQuery:
    """Run at an interval, or take in everything that is pending and stop."""
    trigger = {"availableNow": True} if flush else {"processingTime": interval}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    marked = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
    marked.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_changes(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write what a micro-batch changed; one that changes nothing leaves no file."""
    batch.persist()
    try:
        if not batch.isEmpty():
            write_batch(batch, batch_id, path)
    finally:
        batch.unpersist()


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


# ---- merged bases ---------------------------------------------------------------------------------


def _folders(spark: SparkSession, path: str, prefix: str, finished: bool = False) -> dict[int, str]:
    """Number -> folder of the folders ``<prefix><number>``; with ``finished`` only those whose writer has committed."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    out = {}
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(prefix) and name.removeprefix(prefix).isdigit():
            if not finished or fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out[int(name.removeprefix(prefix))] = f"{path}/{name}"
    return out


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def snapshot_folders(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(last batch in the base, folders to read): the newest finished base and the batches after it.

    A base is pointed to by the commit mark that its writer leaves last, so one that a crash cut short is not seen.
    """
    bases, batches = _folders(spark, f"{path}/base", "upto=", finished=True), _folders(spark, path, "batch=")
    upto = max(bases, default=-1)
    return upto, ([bases[upto]] if bases else []) + [folder for number, folder in sorted(batches.items()) if number > upto]


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest base and of the batches after it, as they were written."""
    folders = snapshot_folders(spark, path)[1]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge the base and the batches after it to a new base.

    What the base before the last one has taken in is removed; the last one and its batches stay for readers that
    have begun with them.  A batch that is repeated after its base was written is a batch the base has already.
    """
    upto, folders = snapshot_folders(spark, path)
    batches = _folders(spark, path, "batch=")
    newest = max(batches, default=-1)
    if newest <= upto:
        return
    merged = merge(spark.read.schema(schema).parquet(*folders)).withColumn("batch_id", F.lit(newest).cast("long"))
    names = [f.split()[0] for f in schema.split(", ")]
    merged.select(names).write.mode("overwrite").parquet(f"{path}/base/upto={newest}")
    older = [folder for number, folder in _folders(spark, f"{path}/base", "upto=").items() if number < upto]
    _remove(spark, older + [folder for number, folder in batches.items() if number <= upto])


class SnapshotAtEnd(StreamingQueryListener):
    """Takes a last snapshot when the query of a given name ends, however it ends."""

    def __init__(self, name: str, snapshot: Callable[[], None]):
        self.name, self.snapshot = name, snapshot
        self.query_id = None
        self.done = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.query_id = event.id

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id == self.query_id:
            try:
                self.snapshot()
            finally:
                self.done.set()


def _started(
    spark: SparkSession, writer, checkpoint: str, flush: bool, interval: str, snapshot: Callable[[], None] | None
) -> StreamingQuery:
    """Start a query; with ``snapshot`` its listener is at ``query.at_end``, to wait for."""
    if snapshot is None:
        return start(writer, checkpoint, flush, interval)
    listener = SnapshotAtEnd(f"training-{uuid.uuid4().hex}", snapshot)
    spark.streams.addListener(listener)
    query = start(writer.queryName(listener.name), checkpoint, flush, interval)
    query.at_end = listener
    return query


def stop_training(query: StreamingQuery, seconds: float = 600.0) -> bool:
    """Stop a query and wait for its last snapshot; whether it was taken in time."""
    query.stop()
    listener = getattr(query, "at_end", None)
    return listener is None or listener.done.wait(seconds)


# ---- continuous training ----------------------------------------------------------------------------


def word_counts_stream(stream: DataFrame, tokenizer: str = "words") -> DataFrame:
    """Running term counts by domain and class: the state is the model."""
    rows = with_terms(with_default_domain(usable_rows(stream)), tokenizer)
    return counts.count_fit(rows, by=["domain"])


def newest_counts(rows: DataFrame) -> DataFrame:
    """Of running counts the newest row each."""
    return rows.groupBy("domain", "label", "feature").agg(F.max_by("n", "batch_id").alias("n"))


def train_words(
    stream: DataFrame, path: str, checkpoint: str, tokenizer: str = "words", flush: bool = False,
    interval: str = SNAPSHOT_INTERVAL, compact_every: int = COMPACT_EVERY, snapshot_at_end: bool = False,
) -> StreamingQuery:
    """Keep running counts in state and write the changed rows as a snapshot per trigger.

    The state holds a row per term and class, so it is kept on disk by RocksDB unless the session names another store.
    Every ``compact_every`` batches, and on request when the query ends, snapshots are merged to a base.
    """
    spark = stream.sparkSession
    if spark.conf.get(STATE_STORE, None) in (None, "", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKS_DB)

    def snapshot(batch: DataFrame, batch_id: int) -> None:
        write_changes(batch, batch_id, path)
        if len(snapshot_folders(batch.sparkSession, path)[1]) > compact_every:
            compact(batch.sparkSession, path, COUNT_SCHEMA, newest_counts)

    writer = word_counts_stream(stream, tokenizer).writeStream.outputMode("update").foreachBatch(snapshot)
    last = (lambda: compact(spark, path, COUNT_SCHEMA, newest_counts)) if snapshot_at_end else None
    return _started(spark, writer, checkpoint, flush, interval, last)


def snapshot_counts(spark: SparkSession, path: str) -> DataFrame:
    """The model as of the last snapshot: the newest row of every count."""
    return newest_counts(read_snapshot(spark, path, COUNT_SCHEMA))


def train_vectors(
    stream: DataFrame, lexicon: DataFrame | Lookup, path: str, checkpoint: str, key: str = "doc_id",
    flush: bool = False, interval: str = SNAPSHOT_INTERVAL, compact_every: int = COMPACT_EVERY, snapshot_at_end: bool = False,
) -> StreamingQuery:
    """Turn each micro-batch into sentiment vectors and write its statistics as an increment.

    Increments are merged to a base like the snapshots of ``train_words``.
    """
    spark = stream.sparkSession
    prepared = lexicon if isinstance(lexicon, Lookup) else prepare_lexicon(lexicon)
    merge = lambda rows: bayes.merge_gaussian(rows, ["domain"])

    def increment(batch: DataFrame, batch_id: int) -> None:
        rows = with_default_domain(usable_rows(batch))
        vectors = sentiment_vectors(rows, prepared, key, keep=["domain", "label"])
        # An increment that a base has taken in already is not written, or counted, once more.
        if batch_id > snapshot_folders(batch.sparkSession, path)[0]:
            write_changes(bayes.gaussian_fit(vectors, FEATURES, ["domain"]), batch_id, path)
        if len(snapshot_folders(batch.sparkSession, path)[1]) > compact_every:
            compact(batch.sparkSession, path, VECTOR_SCHEMA, merge)

    last = (lambda: compact(spark, path, VECTOR_SCHEMA, merge)) if snapshot_at_end else None
    return _started(spark, stream.writeStream.foreachBatch(increment), checkpoint, flush, interval, last)


def merged_increments(spark: SparkSession, path: str) -> DataFrame:
    """The model of all increments so far."""
    return bayes.merge_gaussian(read_snapshot(spark, path, VECTOR_SCHEMA), ["domain"])


def store_messages(
    messages: DataFrame, rows_path: str, rejects_path: str, checkpoint: str, flush: bool = False, interval: str = SNAPSHOT_INTERVAL
) -> StreamingQuery:
    """Training messages (value) as rows and, beside them, what is set aside with the reason.

    Both are written per micro-batch and replace what an interrupted attempt of the batch has left, so every
    message is in one of them exactly once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            rows, rejects = split_requests(batch.select("value"))
            write_batch(rows, batch_id, rows_path)
            write_batch(rejects, batch_id, rejects_path)
        finally:
            batch.unpersist()

    return start(messages.writeStream.foreachBatch(store), checkpoint, flush, interval)


def score_stream(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    flush: bool = False, interval: str = SNAPSHOT_INTERVAL,
) -> StreamingQuery:
    """Score the rows of every micro-batch with a batch scoring function and write the answers."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        write_batch(score(batch), batch_id, path)

    return start(stream.writeStream.foreachBatch(answer), checkpoint, flush, interval)


class RegistryScorer:
    """Scores batches with the newest stored models of a learner, and changes to newer ones between two batches.

    Before each batch one number is read that changes with the set of newest models; only if it has changed
    are the models loaded and prepared again.  While there is no model, rows get null classes.
    """

    def __init__(self, spark: SparkSession, path: str, learner: str = "gaussian_nb", key: str = "doc_id", keep: list[str] | None = None):
        self.spark, self.path, self.learner, self.key, self.keep = spark, path, learner, key, keep or []
        self.version, self.model = None, None

    def __call__(self, batch: DataFrame) -> DataFrame:
        version = models_version(self.spark, self.path, self.learner)
        if version != self.version:
            self.model = None if version is None else prepare_model(load_model(self.spark, self.path, self.learner))
            self.version = version
        if self.model is None:
            return with_domain(batch).select(self.key, "domain", *self.keep, F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("prob"))
        scored = classify(batch, self.model, self.key, self.keep)
        return scored.select(self.key, "domain", *self.keep, "predicted", "prob")


def load_job(spark: SparkSession, directory: str, tabbed: bool, spec: str | None) -> DataFrame:
    """The (text, label) rows that a manifest names."""
    if tabbed:
        return read_labelled_lines(spark, directory, spec)[0].select("text", "label")
    return read_class_dirs(spark, directory).select("text", "label")


def run_triggers(
    triggers: DataFrame, handle: Callable[[DataFrame, str, str], None], checkpoint: str, flush: bool = False,
    interval: str = SNAPSHOT_INTERVAL, failed: str | None = None,
) -> StreamingQuery:
    """Load the corpus of every new manifest and pass it to ``handle(rows, domain, job_id)``.

    The list of jobs in a micro-batch is bounded by the files taken per trigger;
    only the manifests pass through the driver, the corpora do not.  The checkpoint
    remembers finished manifests.  After a crash a manifest may be handled again
    under the same job id, so a handler writes to a place named by that id.

    With a folder for ``failed`` jobs, a job whose corpus cannot be loaded or handled is
    written there as (job_id, file, dir, domain, error) and the others go on; without
    one it stops the stream.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        jobs = batch.withColumn("job_id", F.md5("file")).orderBy("file").collect()
        broken = []
        for job in jobs:
            try:
                rows = load_job(batch.sparkSession, job["dir"], job["tabbed"], job["format"])
                handle(rows.withColumn("domain", F.lit(job["domain"])), job["domain"], job["job_id"])
            except Exception as e:
                if failed is None:
                    raise
                broken.append((job["job_id"], job["file"], job["dir"], job["domain"], str(e)[:1000]))
        if broken:
            schema = "job_id string, file string, dir string, domain string, error string"
            batch.sparkSession.createDataFrame(broken, schema).coalesce(1).write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")

    return start(triggers.writeStream.foreachBatch(run), checkpoint, flush, interval)
