import json

from pyspark.sql import functions as F

from tonemill.operators import bayes, counts
from tonemill.operators.vectors import FEATURE_WEIGHTS, FEATURES, sentiment_vectors
from tonemill.operators.words import with_terms
from tonemill.plans import training as plans
from tonemill.plans.fixtures import lexicon
from tonemill.streaming import sources as streams
from tonemill.streaming import training as learning

SCHEMA = "doc_id long, domain string, text string, label string"
ROWS = [
    (1, "m", "the best of that. trash idiot!", "neg"), (2, "", "orre with that", "pos"), (3, "m", "rewh the", "pos"),
    (4, None, "clown, moron", "neg"), (5, "m", "the the", ""), (6, "m", None, "pos"),
]


def put(spark, path, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def as_map(df, *values):
    keys = ("domain", "label", "feature")
    return {tuple(r[k] for k in keys): tuple(round(r[v], 9) for v in values) for r in df.collect()}


def batch_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).filter("text is not null and label <> ''")
    return df.withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.lit("$DEF")))


def test_word_training_restarts_where_it_stopped(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    put(spark, inbox, ROWS[:3], "one")
    run = lambda: learning.train_words(
        streams.file_stream(spark, f"{inbox}/*", SCHEMA), out, progress, flush=True
    ).awaitTermination()
    run()
    run()  # nothing new: no snapshot
    assert len(list((tmp_path / "out").glob("batch=*"))) == 1
    put(spark, inbox, ROWS[3:], "two")
    run()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
    want = counts.count_fit(with_terms(batch_rows(spark)), by=["domain"])
    assert as_map(learning.snapshot_counts(spark, out), "n") == as_map(want, "n")


def test_vector_training_equals_one_batch(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    put(spark, inbox, ROWS[:3], "one")
    put(spark, inbox, ROWS[3:], "two")
    stream = streams.file_stream(spark, f"{inbox}/*", SCHEMA, files_per_trigger=1)
    learning.train_vectors(stream, lexicon(spark), out, progress, flush=True).awaitTermination()
    vectors = sentiment_vectors(batch_rows(spark), lexicon(spark), keep=["domain", "label"])
    want = bayes.gaussian_fit(vectors, FEATURES, ["domain"])
    assert as_map(learning.merged_increments(spark, out), "n", "mean", "m2") == as_map(want, "n", "mean", "m2")


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    stats = spark.createDataFrame([("d", "pos", "f", 2, 1.0, 0.5)], "domain string, label string, feature string, n long, mean double, m2 double")
    for _ in range(2):
        learning.write_changes(stats, 7, out)
    assert as_map(learning.merged_increments(spark, out), "n") == {("d", "pos", "f"): (2,)}
    learning.write_changes(stats.limit(0), 8, out)
    assert not (tmp_path / "out" / "batch=8").exists()


def test_scoring(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    put(spark, inbox, ROWS[:4], "one")
    vectors = sentiment_vectors(batch_rows(spark), lexicon(spark), keep=["domain", "label"])
    model = bayes.prepare_members(bayes.gaussian_fit(vectors, FEATURES, ["domain"]), FEATURES, FEATURE_WEIGHTS)

    def score(batch):
        rows = streams.with_default_domain(batch)
        made = sentiment_vectors(rows, lexicon(spark), keep=["domain"])
        return bayes.classify_vectors(made, model, FEATURES).select("doc_id", "predicted")

    stream = streams.file_stream(spark, f"{inbox}/*", SCHEMA)
    learning.score_stream(stream, score, out, progress, flush=True).awaitTermination()
    got = learning.read_batches(spark, out, "doc_id long, predicted string")
    want = bayes.classify_vectors(vectors, model, FEATURES)
    assert {tuple(r) for r in got.collect()} == {(r.doc_id, r.predicted) for r in want.collect()}


def test_messages_are_routed_by_domain(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    messages = [
        {"domain": "m", "dataSet": [{"text": "a", "textClass": "pos"}]}, {"dataSet": [{"text": "b", "textClass": "neg"}]},
    ]
    (inbox / "m.json").write_text("\n".join(json.dumps(m) for m in messages) + "\nnot json\n")
    writer = streams.message_stream(spark, str(inbox)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    learning.start(writer, str(tmp_path / "progress"), flush=True).awaitTermination()
    got = {(r.domain, r.text, r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("m", "a", "pos"), ("$DEF", "b", "neg")}


def test_trigger_files(spark, tmp_path):
    jobs, lines, classes = tmp_path / "jobs", tmp_path / "lines", tmp_path / "classes"
    for d in (jobs, lines, classes / "pos", classes / "neg"):
        d.mkdir(parents=True)
    (lines / "a.txt").write_text("good\t1\nbad\t0\nbroken\n")
    (classes / "pos" / "x").write_text("nice")
    (classes / "neg" / "y").write_text("awful")
    (jobs / "one.train").write_text(f"{lines}\nmovies\ntrue\nsentence score\n")
    (jobs / "two.train").write_text(f"{classes}\n")
    (jobs / "three.proc").write_text(f"{classes}\nignored\n")
    seen = []

    def handle(rows, domain, job_id):
        seen.append(job_id)
        rows.write.mode("overwrite").parquet(str(tmp_path / "out" / f"job={job_id}"))

    run = lambda: learning.run_triggers(
        streams.trigger_stream(spark, str(jobs)), handle, str(tmp_path / "progress"), flush=True
    ).awaitTermination()
    run()
    run()  # finished manifests are not run again
    assert len(seen) == 2
    got = {(r.domain, r.text, r.label) for r in spark.read.parquet(str(tmp_path / "out" / "job=*")).collect()}
    assert got == {
        ("movies", "good", "pos"), ("movies", "bad", "neg"), ("$DEF", "nice", "pos"), ("$DEF", "awful", "neg"),
    }


def test_snapshots_are_merged_and_a_restart_goes_on(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    run = lambda: learning.train_words(
        streams.file_stream(spark, f"{inbox}/*", SCHEMA, files_per_trigger=1), out, progress, flush=True, compact_every=2
    ).awaitTermination()
    usable = [r for r in ROWS if r[2] is not None and r[3]]
    for i in range(7):
        put(spark, inbox, [(10 * i + r[0], *r[1:]) for r in usable], f"part{i}")
        run()
        assert len(learning.snapshot_folders(spark, out)[1]) <= 3
    assert len(list((tmp_path / "out").glob("batch=*"))) <= 4 and len(list((tmp_path / "out/base").glob("upto=*"))) <= 2
    want = {k: (7 * n,) for k, (n,) in as_map(counts.count_fit(with_terms(batch_rows(spark)), by=["domain"]), "n").items()}
    assert as_map(learning.snapshot_counts(spark, out), "n") == want
    # A base whose writer did not finish is not seen, and a batch that is repeated after its base changes nothing.
    broken = tmp_path / "out/base/upto=900"
    broken.mkdir()
    last = learning.snapshot_folders(spark, out)[0]
    learning.write_batch(spark.createDataFrame([("m", "neg", "idiot", 1)], "domain string, label string, feature string, n long"), last, out)
    assert as_map(learning.snapshot_counts(spark, out), "n") == want


def test_merged_vector_increments(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for row in ROWS:
        put(spark, inbox, [row], f"row{row[0]}")
    stream = streams.file_stream(spark, f"{inbox}/*", SCHEMA, files_per_trigger=1)
    learning.train_vectors(stream, lexicon(spark), out, progress, flush=True, compact_every=1).awaitTermination()
    assert len(learning.snapshot_folders(spark, out)[1]) <= 2
    vectors = sentiment_vectors(batch_rows(spark), lexicon(spark), keep=["domain", "label"])
    want = as_map(bayes.gaussian_fit(vectors, FEATURES, ["domain"]), "n", "mean", "m2")
    assert as_map(learning.merged_increments(spark, out), "n", "mean", "m2") == want


def test_a_stopped_stream_leaves_a_whole_snapshot(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    put(spark, inbox, ROWS, "one")
    query = learning.train_words(
        streams.file_stream(spark, f"{inbox}/*", SCHEMA), out, progress, interval="200 milliseconds", snapshot_at_end=True
    )
    query.processAllAvailable()
    assert not list((tmp_path / "out").glob("base/*"))
    assert learning.stop_training(query, 120) and not query.isActive
    upto, folders = learning.snapshot_folders(spark, out)
    assert upto >= 0 and len(folders) == 1
    want = counts.count_fit(with_terms(batch_rows(spark)), by=["domain"])
    assert as_map(learning.snapshot_counts(spark, out), "n") == as_map(want, "n")
    spark.streams.removeListener(query.at_end)


def test_scorer_follows_the_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    rows = batch_rows(spark).withColumn("domain", F.lit("m"))
    scorer = learning.RegistryScorer(spark, path, "multinomial_nb")
    options = plans.FeatureOptions(feature_select=False)
    assert {r.predicted for r in scorer(rows).collect()} == {None}
    plans.build(rows.filter("label = 'neg'"), path, 1, "multinomial_nb", options)
    assert {r.predicted for r in scorer(rows).collect()} == {"neg"}
    held = scorer.model
    scorer(rows)
    assert scorer.model is held
    plans.rebuild(rows, path, 2, "multinomial_nb", options)
    assert {r.predicted for r in scorer(rows).collect()} == {"neg", "pos"} and scorer.model is not held


def test_messages_are_rows_or_rejects_once(spark, tmp_path):
    inbox, rows, aside, progress = (str(tmp_path / n) for n in ("in", "rows", "aside", "progress"))
    good = json.dumps({"domain": "m", "dataSet": [{"text": "a b", "textClass": "x"}, {"text": "c"}]})
    for name, lines in (("one", [good, "nonsense"]), ("two", ["{}", good])):
        spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(f"{inbox}/{name}")
    run = lambda: learning.store_messages(streams.raw_messages(spark, f"{inbox}/*", files_per_trigger=1), rows, aside, progress, flush=True).awaitTermination()
    run()
    run()
    taken, left = spark.read.parquet(f"{rows}/batch=*"), spark.read.parquet(f"{aside}/batch=*")
    assert [r.text for r in taken.collect()] == ["a b", "a b"]
    assert sorted(r.reason for r in left.collect()) == ["no JSON object", "no rows", "row has no text or no class", "row has no text or no class"]
