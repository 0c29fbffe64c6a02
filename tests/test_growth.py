"""Tables in more pieces than there are cores: what moves, and how much of it a task takes."""

from pathlib import Path

import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the sample tables are not here")


@pytest.fixture(scope="module")
def pieces(spark, tmp_path_factory):
    """The smallest tables, documents in 24 files."""
    root = tmp_path_factory.mktemp("pieces")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(24 if name == "documents" else 1).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def rows_of(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_words_of_placed_texts_are_counted_in_place(spark, pieces):
    made = driver.queries()["a4_lemma_frequency"](spark, pieces)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" in plan
    assert rows_of(made) == rows_of(driver.queries()["a4_lemma_frequency"](spark, SF))


def test_inboxes_of_larger_tables_have_more_files(spark, pieces):
    from tonemill.plans import queries_streams

    inbox = queries_streams._inbox(spark, pieces)
    files = spark.read.parquet(inbox).inputFiles()
    assert len(files) > 24  # four files, however large the table, made four tasks
    assert -(-len(files) // queries_streams._share(spark, inbox, 2)) == 2
    assert rows_of(driver.queries()["t5_stream_scoring"](spark, pieces)) == rows_of(driver.queries()["t5_stream_scoring"](spark, SF))


def test_a_saved_model_is_trained_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from tonemill.sources import registry

    # Parameters that come out otherwise whenever they are computed again.
    params = spark.range(6).select(F.lit("d").alias("domain"), F.lit("a").alias("label"), F.col("id").cast("string").alias("feature"), F.lit(1).cast("long").alias("n"), F.expr("CAST(substring(uuid(), 1, 1) < '8' AS DOUBLE) + CAST(conv(substring(uuid(), 1, 6), 16, 10) AS DOUBLE)").alias("mean"), F.lit(0.0).alias("m2"))
    status = registry.save_models(params, str(tmp_path), "gaussian_nb", 1).first()
    again = registry.headers_of(registry.load_models(spark, str(tmp_path)).drop("model_id"), "gaussian_nb").first()
    assert status["model_id"] == again["model_id"]


def test_only_labelled_texts_are_cut_into_words(spark, pieces):
    from tonemill.plans import fixtures

    made = fixtures.training(spark, pieces)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("LeftSemi") > plan.rindex("Generate ")  # the joins with the labels stand below the words
    spark.conf.set("spark.tonemill.broadcastRows", "0")
    try:
        placed = fixtures.training(spark, pieces)
        moved = {r["doc_id"]: tuple(round(r[f], 9) for f in fixtures.FEATURES) for r in placed.collect()}
    finally:
        spark.conf.unset("spark.tonemill.broadcastRows")
    assert moved == {r["doc_id"]: tuple(round(r[f], 9) for f in fixtures.FEATURES) for r in made.collect()}
    assert len(moved) == spark.read.parquet(f"{SF}/labels.parquet").count()


def test_files_of_many_models_are_written_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tonemill.sources import registry

    params = spark.range(40).select(F.lit("d").alias("domain"), F.col("id").alias("version"), F.lit("a").alias("label"), F.lit("f").alias("feature"), F.lit(1).cast("long").alias("n"), F.col("id").cast("double").alias("mean"), F.lit(0.0).alias("m2"))
    registry.save_models(params, str(tmp_path), "gaussian_nb", 1, keys=["domain", "version"])
    tasks = {Path(f).name.split("-")[1] for f in registry.load_models(spark, str(tmp_path)).inputFiles()}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


@pytest.mark.parametrize("learner", ["nearest", "local"])
def test_texts_that_are_trained_on_and_asked_are_cut_into_words_once(spark, monkeypatch, learner):
    from tonemill.plans import queries_vectors, training

    plain, cut = training.sentiment_vectors, []
    monkeypatch.setattr(training, "sentiment_vectors", lambda *a: cut.append(1) or plain(*a))
    answered = queries_vectors._by_domain(spark, SF, learner).select("doc_id", "predicted").collect()
    assert len(cut) == 1
    texts = queries_vectors.labelled_texts(spark, SF, ["lang"]).withColumnRenamed("lang", "domain")
    options = training.FeatureOptions(lexicon=queries_vectors.lexicon(spark))
    apart = training.classify(texts, training.train(texts, learner, options)).select("doc_id", "predicted")
    assert sorted(answered) == sorted(apart.collect())


def test_a_row_without_a_text_is_asked_and_not_trained_on(spark):
    from tonemill.plans import fixtures, training

    rows = spark.createDataFrame([(1, "d", "a", "the idiot"), (2, "d", "b", None)], "doc_id long, domain string, label string, text string")
    options = training.FeatureOptions(lexicon=fixtures.lexicon(spark))
    made = training.with_vectors(rows, options, keep=["label"])
    model = training.train(made, "nearest", options)
    assert [r.doc_id for r in model.fitted.collect()] == [1]
    assert {r.doc_id: r.predicted for r in training.classify(made, model).collect()} == {1: "a", 2: "a"}


def test_grams_of_shingles_without_making_the_pairs(spark, monkeypatch):
    from tonemill.operators import words

    texts = [None, "", "...", "the", "a", "x", "house", "the the the", "the house", "a b c d", "U.S.A. the cat's mat", "été 42 𝒳𝒴 the İstanbul é", "one two one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for low, high in ((1, 3), (2, 2), (1, 1), (3, 5)):
        every = words.char_ngram_counts(words.with_terms(df, "shingles"), low, high)
        assert rows_of(words.shingle_ngram_counts(df, low, high)) == rows_of(every)
    monkeypatch.setattr(words, "char_ngram_counts", None)  # cuts every pair into all its windows
    assert driver.queries()["f7_char_ngrams"](spark, SF).count() > 0
