import math

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tonemill.operators import bayes, counts, ensemble, evaluate, mllib
from tonemill.operators.joins import lookup_join, store_lookup
from tonemill.operators.rows import argmax_rows, chunks, class_index, most_recent, numbered
from tonemill.operators.vectors import FEATURE_WEIGHTS, FEATURES, sentiment_vectors
from tonemill.operators.words import information_gain, lemmatised, presence_vectors, vocabulary, with_terms
from tonemill.plans import training as plans
from tonemill.plans.fixtures import lexicon, lexicon_lines
from tonemill.sources.lexicon import by_term, score_lexicon

TEXTS = [
    (1, "the best of that. what a trash idiot!", "neg"),
    (2, "The the is for la. de idiot, moron", "neg"),
    (3, "that orre with that. rewh", "pos"),
    (4, "nothing known here", "pos"),
    (5, "", "pos"),
    (6, "... !!", "neg"),
    (7, "pathetic-clown worthless: vile. that", "neg"),
    (8, "was is que with with with the", "pos"),
    (9, "orre orre. the the the that", "pos"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, label string")


@pytest.fixture(scope="module")
def vectors(spark, texts):
    made = sentiment_vectors(texts, lexicon(spark), keep=["label"]).withColumn("domain", F.lit("d"))
    return spark.createDataFrame(made.collect(), made.schema)


def test_vectors_by_hand(spark, texts):
    scores = {(r.term, r.pos): r.score for r in score_lexicon(lexicon_lines(spark)).collect()}
    got = {r.doc_id: r for r in sentiment_vectors(texts, lexicon(spark)).collect()}
    assert len(got) == len(TEXTS)
    # Two sentences: (the, of, that) and (trash, idiot); `a` and `what` are unknown.
    assert got[1].score_adj == pytest.approx((scores["the", "a"] + scores["that", "a"] + scores["idiot", "a"]) / 2)
    assert got[1].score_noun == pytest.approx(
        (scores["the", "n"] + scores["of", "n"] + scores["trash", "n"] + scores["idiot", "n"]) / 2
    )
    assert got[1].score_verb == pytest.approx(scores["trash", "v"] / 2)
    assert all(got[5][f] == 0 for f in FEATURES) and all(got[6][f] == 0 for f in FEATURES)
    # Noise characters vanish before words are cut: `patheticclown` is no word of the lexicon.
    assert got[7].score_noun == 0


def test_lexicon_rules(spark):
    got = {(r.term, r.pos): r.score for r in score_lexicon(lexicon_lines(spark)).collect()}
    assert got["that", "a"] == pytest.approx(0.375)  # the later line of the same rank
    assert got["the", "n"] == pytest.approx((-0.125 / 2 - 0.125 / 4) / (1 / 2 + 1 / 4))
    assert ("inand", "r") in got and ("with", "r") in got


def test_tagger_limits_words_to_their_tag(spark, texts):
    def nouns(sentence):
        return F.transform(F.split(F.lower(sentence), " "), lambda w: F.struct(w.alias("token"), F.lit("NN").alias("pos")))

    got = sentiment_vectors(texts, lexicon(spark), tagger=nouns).agg(*[F.max(F.abs(f)).alias(f) for f in FEATURES]).first()
    assert got.score_adj == got.score_adv == got.score_verb == 0 and got.score_noun > 0


def test_vectors_do_not_depend_on_the_join(only_shuffles, texts, vectors):
    spark = only_shuffles
    again = sentiment_vectors(texts, by_scores(spark), keep=["label"])
    a = {r.doc_id: tuple(round(r[f], 9) for f in FEATURES) for r in again.collect()}
    b = {r.doc_id: tuple(round(r[f], 9) for f in FEATURES) for r in vectors.collect()}
    assert a == b
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def by_scores(spark):
    return store_lookup(by_term(score_lexicon(lexicon_lines(spark))))


def test_salted_lookup_join(only_shuffles):
    spark = only_shuffles
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5))
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (9, "z")], "k long, v string")
    got = lookup_join(rows, lookup, ["k"], "left", spread=["id"])
    assert got.count() == 1000
    assert got.filter("v is null").count() == rows.filter("k not in (0, 1)").count()
    assert lookup_join(rows, lookup.select("k"), ["k"], "left_semi", spread=["id"]).count() == rows.filter("k in (0, 1)").count()


def test_lookup_limits(spark):
    rows = spark.createDataFrame([(i, "x" * 50) for i in range(20)], "k long, v string")
    assert store_lookup(rows).small and store_lookup(rows.limit(0)).small
    for name, value in (("spark.tonemill.broadcastRows", "19"), ("spark.tonemill.broadcastBytes", "1000")):
        spark.conf.set(name, value)
        try:
            assert not store_lookup(rows).small
        finally:
            spark.conf.unset(name)


def test_merge_equals_the_whole(vectors):
    whole = bayes.gaussian_fit(vectors, FEATURES, ["domain"])
    parts = bayes.gaussian_fit(vectors.withColumn("s", F.col("doc_id") % 4), FEATURES, ["domain", "s"]).drop("s")
    as_map = lambda df: {(r.label, r.feature): (r.n, round(r["mean"], 9), round(r.m2, 9)) for r in df.collect()}
    assert as_map(bayes.merge_gaussian(parts, ["domain"])) == as_map(whole)


def test_gaussian_against_pyspark_ml(vectors):
    """With a shared floor on the variances both learners give the same classes and odds."""
    assembled = VectorAssembler(inputCols=["score_adj", "score_noun"], outputCol="features").transform(vectors)
    indexed = StringIndexer(inputCol="label", outputCol="idx", stringOrderType="alphabetAsc").fit(assembled).transform(assembled)
    fitted = NaiveBayes(modelType="gaussian", labelCol="idx").fit(indexed)
    theirs = {r.doc_id: r.probability for r in fitted.transform(indexed).collect()}
    features = ["score_adj", "score_noun"]
    ours = bayes.classify_vectors(vectors, bayes.gaussian_fit(vectors, features, ["domain"]), features).collect()
    for r in ours:
        for c in r.dist:
            assert c.prob == pytest.approx(theirs[r.doc_id][c.label_idx], abs=1e-6)


def test_multinomial_against_pyspark_ml(texts):
    made = with_terms(texts).withColumn("domain", F.lit("d"))
    model = counts.prepare_counts(counts.count_fit(made, by=["domain"]), ["domain"])
    ours = {r.doc_id: {c.label: c.prob for c in r.dist} for r in counts.count_scores(made, model, ["doc_id"]).collect()}
    table = CountVectorizer(inputCol="terms", outputCol="features").fit(made).transform(made)
    indexer = StringIndexer(inputCol="label", outputCol="idx", stringOrderType="alphabetAsc").fit(table)
    fitted = NaiveBayes(modelType="multinomial", labelCol="idx", smoothing=1.0).fit(indexer.transform(table))
    for r in fitted.transform(indexer.transform(table)).collect():
        for i, label in enumerate(indexer.labels):
            assert ours[r.doc_id][label] == pytest.approx(r.probability[i], abs=1e-9)


def test_counts_do_not_depend_on_the_join(spark, texts, request):
    made = with_terms(texts)

    def run():
        model = counts.prepare_char_model(counts.count_fit(counts.with_char_grams(made, order=3)))
        scored = counts.count_scores(counts.with_char_grams(made, order=3), model, ["doc_id"])
        return {r.doc_id: [(c.label, round(c.prob, 9)) for c in r.dist] for r in scored.collect()}

    small = run()
    request.getfixturevalue("only_shuffles")
    assert run() == small and len(small) == len(TEXTS)


def test_char_scores_in_one_shuffle_are_those_of_the_stored_model(spark):
    lines = [(1, "a", "the quick brown fox"), (2, "b", "der schnelle Fuchs, schnelle"), (3, "a", "the quick red fox"), (4, "b", "kurz"), (5, "a", None), (6, None, "the quick Fuchs")]
    made = counts.with_char_grams(spark.createDataFrame(lines, "doc_id long, label string, text string"))
    model = counts.prepare_char_model(counts.count_fit(made.filter("label is not null")))
    scores = lambda rows: {r.doc_id: (r.predicted, [(c.label, round(c.prob, 9)) for c in r.dist]) for r in rows.collect()}
    among = counts.char_scores_among(made, ["doc_id"])
    assert scores(among) == scores(counts.count_scores(made, model, ["doc_id"])) and among.count() == 6
    # The answers come from stored sums by text: runs are not shuffled a second time.
    assert "Generate" not in among._jdf.queryExecution().optimizedPlan().toString()


def test_frequent_terms_of_a_large_vocabulary_do_not_move(spark, request):
    lines = [(i, " ".join(["the", "of", "and", f"w{i % 40}", f"v{i}"][: 1 + i % 5])) for i in range(200)]
    texts = with_terms(spark.createDataFrame(lines, "doc_id long, text string"))
    vocab = vocabulary(texts.filter("doc_id % 3 > 0"))
    got = lambda rows: {(r.doc_id, r.term) for r in rows.collect()}
    whole = got(presence_vectors(texts, vocab, ["doc_id"]))
    known = {r.term for r in vocab.collect()}
    assert whole == {(i, t) for i, line in lines for t in line.split() if t in known}
    request.getfixturevalue("only_shuffles")
    spark.conf.set("spark.tonemill.broadcastRows", "20")
    split = presence_vectors(texts, vocab, ["doc_id"])
    assert got(split) == whole
    # Only the rows without a term of the broadcast head are joined by a shuffle.
    assert "_met" in split._jdf.queryExecution().optimizedPlan().toString()


def test_constant_features_and_ties(spark):
    rows = spark.createDataFrame(
        [(1, "d", "b", 1.0), (2, "d", "a", 1.0)], "doc_id long, domain string, label string, x double"
    )
    scored = bayes.classify_vectors(rows, bayes.gaussian_fit(rows, ["x"], ["domain"]), ["x"]).collect()
    assert {r.predicted for r in scored} == {"a"}
    assert all(r.prob == pytest.approx(0.5) for r in scored)
    scores = spark.createDataFrame([(1, "b", 1, 0.5), (1, "a", 0, 0.5), (1, "c", 2, 0.4)], "id int, label string, idx int, p double")
    assert argmax_rows(scores, ["id"], F.col("p"), "label", "idx").first().predicted == "a"


def test_unknown_domain_gets_no_class(vectors):
    model = bayes.gaussian_fit(vectors, FEATURES, ["domain"])
    scored = bayes.classify_vectors(vectors.withColumn("domain", F.lit("other")), model, FEATURES)
    assert scored.filter("predicted is not null").count() == 0 and scored.count() == len(TEXTS)


def test_ensemble_of_one_is_that_model(vectors):
    stats = bayes.gaussian_fit(vectors, FEATURES, ["domain"])
    alone = bayes.classify_vectors(vectors, stats, FEATURES, FEATURE_WEIGHTS)
    packed = bayes.prepare_members(
        ensemble.ensemble(stats.withColumn("model_id", F.lit("m"))), FEATURES, FEATURE_WEIGHTS, member="model_id"
    )
    voted = bayes.classify_vectors(vectors, packed, FEATURES)
    as_map = lambda df: {r.doc_id: (r.predicted, round(r.prob, 12)) for r in df.collect()}
    assert as_map(alone) == as_map(voted)


def test_combiners_refuse_nothing_trained(spark, vectors):
    stats = bayes.gaussian_fit(vectors, FEATURES, ["domain"]).withColumn("model_id", F.lit("m"))
    with pytest.raises(ensemble.NoTrainedModel):
        ensemble.ensemble(stats.withColumn("n", F.lit(0).cast("long")))
    with pytest.raises(ValueError, match="evaluation"):
        ensemble.ensemble(stats, "best")
    with pytest.raises(ValueError, match="unknown combiner"):
        ensemble.ensemble(stats, "stacking")


def test_best_member_and_its_tie(spark, vectors):
    good = bayes.gaussian_fit(vectors, FEATURES, ["domain"])
    swapped = F.when(F.col("label") == "pos", "neg").otherwise("pos")
    wrong = good.withColumn("label", swapped)
    members = good.withColumn("model_id", F.lit("b")).unionByName(wrong.withColumn("model_id", F.lit("c")))
    members = members.unionByName(good.withColumn("model_id", F.lit("a")))
    chosen = ensemble.ensemble(members, "best", vectors, FEATURES, FEATURE_WEIGHTS)
    assert [r[0] for r in chosen.select("model_id").distinct().collect()] == ["a"]


@pytest.mark.parametrize("n", [1, 2, 9])
def test_any_number_of_rows(spark, texts, n):
    few = texts.filter(F.col("doc_id") <= n).withColumn("domain", F.lit(""))
    options = plans.FeatureOptions(lexicon=lexicon(spark))
    for learner in ("gaussian_nb", "local", "nearest"):
        answers = plans.classify(few, plans.train(few, learner, options))
        assert answers.filter("predicted is not null").count() == n


def test_no_rows(spark, texts):
    none = texts.limit(0).withColumn("domain", F.lit("d"))
    model = plans.train(none, "gaussian_nb", plans.FeatureOptions(lexicon=lexicon(spark)))
    assert model.params.count() == 0
    assert plans.classify(none, model).count() == 0


def test_learners_by_name(spark, texts):
    rows = texts.withColumn("domain", F.lit("d"))
    options = plans.FeatureOptions(lexicon=lexicon(spark), tokenizer="shingles")
    words = plans.classify(rows, plans.train(rows, "multinomial_nb", options))
    assert words.filter("predicted is not null").count() == len(TEXTS)
    tree = plans.classify(rows, plans.train(rows, "tree", options, maxDepth=2))
    assert {r.predicted for r in tree.collect()} <= {"pos", "neg"}
    given = plans.classify(rows, plans.train(rows, NaiveBayes(modelType="gaussian"), options))
    assert given.count() == len(TEXTS)
    with pytest.raises(ValueError, match="unknown learner"):
        plans.train(rows, "no such learner", options)
    with pytest.raises(ValueError, match="unknown tokenizer"):
        with_terms(rows, "no such tokenizer")


@pytest.mark.parametrize("learner", ["nearest", "local", "tree", "multinomial_nb"])
def test_each_domain_has_its_own_classes(spark, texts, learner):
    """Two domains with the same texts and other names of their classes; a third one has no model."""
    other = F.when(F.col("label") == "pos", "yes").otherwise("no")
    rows = texts.withColumn("domain", F.lit("d1")).unionByName(
        texts.withColumn("domain", F.lit("d2")).withColumn("label", other).withColumn("doc_id", F.col("doc_id") + 100)
    )
    model = plans.train(rows, learner, plans.FeatureOptions(lexicon=lexicon(spark)))
    asked = rows.drop("label").unionByName(texts.drop("label").withColumn("domain", F.lit("d3")).withColumn("doc_id", F.col("doc_id") + 200))
    got = plans.classify(asked, model).collect()
    assert len(got) == 3 * len(TEXTS)
    seen = {n: {r.predicted for r in got if r.doc_id // 100 == n} for n in range(3)}
    assert seen[0] <= {"pos", "neg"} and seen[1] <= {"yes", "no"} and seen[2] == {None}


def test_word_model_through_the_registry(spark, texts, tmp_path):
    from tonemill.sources.registry import latest_model, load_headers

    rows = texts.withColumn("domain", F.lit("d"))
    options = plans.FeatureOptions(feature_select=False)
    plans.build(rows, str(tmp_path), 1, "multinomial_nb", options)
    assert load_headers(spark, str(tmp_path)).first().n_rows == len(TEXTS)
    stored = latest_model(spark, str(tmp_path), "d").select("domain", "label", "feature", "n")
    loaded = plans.TextModel("multinomial_nb", options, params=stored)
    as_map = lambda m: {r.doc_id: (r.predicted, round(r.prob, 12)) for r in plans.classify(rows, m).collect()}
    assert as_map(loaded) == as_map(plans.train(rows, "multinomial_nb", options))


def test_stored_models_are_loaded_with_their_features(spark, texts, tmp_path):
    rows = texts.withColumn("domain", F.lit("d"))
    as_map = lambda m: {r.doc_id: (r.predicted, round(r.prob, 12)) for r in plans.classify(rows, m).collect()}
    for learner, options in (
        ("gaussian_nb", plans.FeatureOptions(lexicon=lexicon(spark))), ("multinomial_nb", plans.FeatureOptions(tokenizer="shingles")),
    ):
        plans.build(rows, str(tmp_path), 1, learner, options)
        loaded = plans.load_model(spark, str(tmp_path), learner, "d")
        assert loaded.features.tokenizer == options.tokenizer
        assert as_map(loaded) == as_map(plans.train(rows, learner, options))
    with pytest.raises(ValueError, match="no model"):
        plans.load_model(spark, str(tmp_path), "gaussian_nb", "nowhere")
    with pytest.raises(ValueError, match="cannot be stored"):
        plans.build(rows, str(tmp_path), 2, "multinomial_nb", plans.FeatureOptions(tokenizer=lambda t: F.split(t, " ")))


def test_shards_vote(spark, texts):
    rows = texts.withColumn("domain", F.lit("d")).withColumn("shard", F.col("doc_id") % 2)
    options = plans.FeatureOptions(lexicon=lexicon(spark))
    members = plans.train_shards(rows, "shard", options)
    assert {r.model_id for r in members.select("model_id").distinct().collect()} == {"0", "1"}
    voted = plans.classify_combined(rows, members, options, keep=["label"]).collect()
    assert len(voted) == len(TEXTS) and all(abs(sum(c.prob for c in r.dist) - 1) < 1e-9 for r in voted)
    best = plans.classify_combined(rows, members, options, "best", rows)
    assert best.count() == len(TEXTS)


def test_snapshots_of_a_member_do_not_mix(spark):
    schema = "domain string, model_id string, label string, feature string, n long"
    newer = spark.createDataFrame([("d", "a", "pos", "f", 9)], schema)
    older = spark.createDataFrame([("d", "a", "pos", "f", 1), ("d", "a", "neg", "f", 1), ("d", "b", "neg", "f", 2)], schema)
    from tonemill.operators.ensemble import union_members

    assert {tuple(r) for r in union_members(newer, older).collect()} == {("d", "a", "pos", "f", 9), ("d", "b", "neg", "f", 2)}


def test_increment_equals_one_build(spark, texts, tmp_path):
    from tonemill.sources.registry import latest_model

    rows = texts.withColumn("domain", F.lit("d"))
    options = plans.FeatureOptions(lexicon=lexicon(spark))
    plans.build(rows.filter("doc_id < 5"), str(tmp_path / "a"), 1, features=options)
    plans.increment(rows.filter("doc_id >= 5"), str(tmp_path / "a"), 2, features=options)
    plans.rebuild(rows, str(tmp_path / "b"), 1, features=options)
    as_map = lambda p: {
        (r.label, r.feature): (r.n, round(r["mean"], 9), round(r.m2, 9)) for r in latest_model(spark, str(p)).collect()
    }
    assert as_map(tmp_path / "a") == as_map(tmp_path / "b")


def test_evaluation_by_hand(spark):
    dist = lambda p: [(0, "neg", 1 - p), (1, "pos", p)]
    rows = [(1, "pos", "pos", dist(0.9)), (2, "pos", "neg", dist(0.4)), (3, "neg", "neg", dist(0.2)), (4, "odd", "pos", dist(1.0))]
    df = spark.createDataFrame(
        rows, "id int, label string, predicted string, dist array<struct<label_idx:int,label:string,prob:double>>"
    )
    got = evaluate.evaluate(df).first()
    assert (got.n, got.accuracy, got.pct_incorrect) == (4, 0.5, 50.0)
    pe = (2 * 2 + 1 * 2) / 16
    assert got.kappa == pytest.approx((0.5 - pe) / (1 - pe))
    # The class `odd` is unknown to the model and counts as one more error.
    assert got.mean_abs_err == pytest.approx((0.2 + 1.2 + 0.4 + 1 + 1) / 8)
    assert got.root_mean_sq_err == pytest.approx(math.sqrt((2 * 0.01 + 2 * 0.36 + 2 * 0.04 + 1 + 1) / 8))
    # Rows without a model count as wrong; the products hold for very many rows.
    unscored = spark.createDataFrame([(5, "pos", None, None), (6, "neg", None, None)], df.schema)
    both = evaluate.evaluate(df.union(unscored)).first()
    assert (both.n, both.n_unscored, both.accuracy) == (6, 2, 2 / 6) and both.mean_abs_err == pytest.approx(got.mean_abs_err)
    matrix = {r.label: (r.neg, r.pos) for r in evaluate.confusion_matrix(df, ["neg", "pos"]).collect()}
    assert matrix == {"pos": (1, 1), "neg": (1, 0), "odd": (0, 1)}


def test_information_gain_by_hand(spark):
    df = spark.createDataFrame(
        [(["a", "b"], "x"), (["a", "a"], "x"), (["b"], "y"), ([], "y")], "terms array<string>, label string"
    )
    got = {r.term: (r.n_docs, r.gain) for r in information_gain(df).collect()}
    assert got == {"a": (2, 1.0)}  # b is spread evenly and tells nothing


def test_a_very_small_gain_is_a_gain(spark):
    """One text in very many: the gain is far below what rounding would keep."""
    df = spark.range(300_000).select(
        F.when(F.col("id") == 7, F.array(F.lit("once"))).otherwise(F.array(F.lit("all"))).alias("terms"),
        F.when(F.col("id") % 50_000 == 1, "x").otherwise("y").alias("label"),
    )
    got = {r.term: r.gain for r in information_gain(df).collect()}
    assert set(got) == {"once", "all"} and 0 <= got["once"] < 1e-9


def test_vocabulary_and_lemmas(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],)], "terms array<string>")
    assert {(r.term, r.n_docs) for r in vocabulary(df).collect()} == {("a", 2), ("b", 1)}
    assert [r.term for r in vocabulary(df, min_docs=2).collect()] == ["a"]
    rows = spark.createDataFrame([(1, "was"), (2, "cat")], "id int, term string")
    lemmas = spark.createDataFrame([("was", "be")], "word string, lemma string")
    assert {r.term for r in lemmatised(rows, lemmas, ["id"]).collect()} == {"be", "cat"}


def test_numbering_over_many_runs(spark):
    rng = np.random.default_rng(7)
    ids = sorted(set(rng.integers(-(2**55), 2**55, 400).tolist()))
    rows = [(i, "hot" if n % 3 else "cold") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(5)
    for newest in (False, True):
        got = numbered(df, ["g"], "id", newest, rows_per_part=20).collect()
        for g in ("hot", "cold"):
            order = [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.row_no)]
            assert order == sorted((i for i, k in rows if k == g), reverse=newest)
            assert sorted(r.row_no for r in got if r.g == g) == list(range(1, len(order) + 1))


def test_chunks_and_recent(spark):
    df = spark.range(10).withColumn("g", F.lit("x"))
    sizes = {r.chunk: r["count"] for r in chunks(df, 4, ["g"], "id").groupBy("chunk").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 2}
    assert {r.id for r in most_recent(df, 3, ["g"], "id").collect()} == {7, 8, 9}
    assert chunks(df.limit(0), 4, ["g"], "id").count() == 0
    with pytest.raises(ValueError):
        chunks(df, 0, ["g"], "id")


def test_line_audit(spark):
    rows = lambda n: spark.range(n)
    good = evaluate.line_audit(rows(10), rows(7), rows(3)).first()
    assert (good.n_read, good.n_kept, good.n_rejected, good.n_lost, good.differs) == (10, 7, 3, 0, False)
    assert evaluate.line_audit(rows(10), rows(7), rows(2)).first().differs


def test_class_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string")
    assert {(r.label, r.label_idx) for r in class_index(df).collect()} == {("a", 0), ("b", 1)}


def test_estimators(vectors):
    for name, options in (("logistic", {"maxIter": 3}), ("linear_svc", {"maxIter": 3}), ("tree", {"maxDepth": 2})):
        model = mllib.fit_estimator(vectors, FEATURES, name, **options)
        answers = mllib.apply_estimator(model, vectors)
        assert answers.count() == len(TEXTS)
        assert not [c for c in answers.columns if c.startswith("_")]
