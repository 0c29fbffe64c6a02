"""Selected presence words, lemmas before shingles, and composite models."""

import glob
import json
import math
import shutil

import pytest
from pyspark.sql import functions as F

from tonemill.operators import bayes, presence
from tonemill.operators.vectors import FEATURE_WEIGHTS, FEATURES
from tonemill.operators.words import with_terms
from tonemill.plans import composites
from tonemill.plans import training as plans
from tonemill.plans.fixtures import lexicon
from tonemill.sources import registry, requests

TEXTS = [
    (1, "d", "good fine good day", "pos"), (2, "d", "good day", "pos"), (3, "d", "bad day", "neg"), (4, "d", "bad bad awful", "neg"),
    (5, "d", "day night", "pos"), (6, "e", "red blue", "left"), (7, "e", "red green", "right"), (8, "e", "", "right"), (9, "f", "only one class", "pos"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, domain string, text string, label string")


def plain_presence(train, text):
    """Class -> probability of one text by wide vectors of ones and zeros."""
    terms = sorted({w for _, t, _ in train for w in t.split()})
    classes = sorted({c for _, _, c in train})
    share = lambda w, c: sum(w in t.split() for _, t, k in train if k == c) / sum(k == c for _, _, k in train)
    overall = lambda w: sum(w in t.split() for _, t, _ in train) / len(train)
    chosen = [w for w in terms if any(abs(share(w, c) - overall(w)) > 1e-12 for c in classes)]
    scores = {}
    for c in classes:
        score = math.log(sum(k == c for _, _, k in train) / len(train))
        for w in chosen:
            p = share(w, c)
            var = max(p * (1 - p), presence.LEAST_VARIANCE)
            x = float(w in text.split())
            score += -0.5 * math.log(2 * math.pi * var) - (x - p) ** 2 / (2 * var)
        scores[c] = score
    top = max(scores.values())
    raised = {c: math.exp(s - top) for c, s in scores.items()}
    return {c: e / sum(raised.values()) for c, e in raised.items()}


def test_presence_words_against_wide_vectors(spark, texts):
    asked = spark.createDataFrame(
        [(20, "d", "good bad day"), (21, "d", "unknown words"), (22, "d", ""), (23, "e", "red red"), (24, "e", "green blue"), (25, "f", "one"), (26, "none", "one"), (27, "d", None)],
        "doc_id long, domain string, text string",
    )
    model = plans.train(texts, "presence_nb")
    got = {r.doc_id: r for r in plans.classify(asked, model).collect()}
    assert got[26].predicted is None and len(got) == 8
    for i, domain, text in [(20, "d", "good bad day"), (21, "d", ""), (22, "d", ""), (23, "e", "red"), (24, "e", "green blue"), (25, "f", "one"), (27, "d", "")]:
        want = plain_presence([(k, t, c) for k, d, t, c in TEXTS if d == domain], text)
        assert {s.label: pytest.approx(s.prob) for s in got[i].dist} == want


def test_presence_words_beyond_the_broadcast(only_shuffles, texts):
    model = plans.train(texts, "presence_nb")
    rows = lambda: {r.doc_id: round(r.prob, 9) for r in plans.classify(texts, model).collect()}
    shuffled = rows()
    only_shuffles.conf.unset("spark.tonemill.broadcastRows")
    assert rows() == shuffled
    only_shuffles.conf.set("spark.tonemill.broadcastRows", "0")


def test_presence_increments_equal_one_build(texts, tmp_path):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    options = plans.FeatureOptions(feature_select=False)
    plans.build(texts, whole, 1, "presence_nb", options)
    plans.build(texts.filter("doc_id % 2 = 0"), parts, 1, "presence_nb", options)
    plans.increment(texts.filter("doc_id % 2 = 1"), parts, 2, options, learner="presence_nb")
    load = lambda p: sorted(map(tuple, plans.load_model(texts.sparkSession, p, "presence_nb").params.select("domain", "label", "feature", "n").collect()))
    assert load(whole) == load(parts)


def test_requests_choose_their_features(spark, texts, tmp_path):
    path = str(tmp_path / "registry")
    lines = [json.dumps({"domain": d, "dataSet": [{"text": t, "textClass": c}], "useSentimentVector": i % 2 == 0}) for i, d, t, c in TEXTS] + ["no request"]
    rows, rejects = requests.split_requests(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, value string"), keep=["doc_id"])
    status = plans.build_requests(rows, path, 1, plans.FeatureOptions(lexicon=lexicon(spark)))
    assert {(r.domain, r.learner, r.status) for r in status.collect()} >= {("d", "presence_nb", "CREATED"), ("d", "gaussian_nb", "CREATED")}
    # One text is empty, and one line is no request.
    assert rows.count() == len(TEXTS) and rejects.count() == 1
    answers = plans.classify_requests(rows, path)
    assert answers.count() == len(TEXTS) and {r.use_sentiment_vector for r in answers.collect()} == {True, False}
    empty = plans.classify_requests(rows, str(tmp_path / "nothing"))
    assert all(r.predicted is None for r in empty.collect()) and empty.count() == len(TEXTS)


def test_lemmas_come_before_shingles_in_order(spark):
    rows = spark.createDataFrame([(1, "cats run cats"), (2, ""), (3, None), (4, "dogs")], "doc_id long, text string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("run", "go")], "word string, lemma string")
    plain = {r.doc_id: r.terms for r in with_terms(rows, "words", lemmas=lemmas).collect()}
    assert plain[1] == ["cat", "go", "cat"] and plain[4] == ["dogs"] and not plain[2] and not plain[3]
    same = spark.createDataFrame([(1, "cat go cat")], "doc_id long, text string")
    shingled = {r.doc_id: r.terms for r in with_terms(rows, "shingles", lemmas=lemmas).collect()}
    assert shingled[1] == with_terms(same, "shingles").first().terms


@pytest.fixture(scope="module")
def models(spark, texts):
    options = plans.FeatureOptions(lexicon=lexicon(spark))
    shards = plans.train_shards(texts.withColumn("shard", F.col("doc_id") % 2), "shard", options)
    return [
        plans.TextModel("gaussian_nb", options, params=shards), plans.train(texts, "multinomial_nb", plans.FeatureOptions(feature_select=False)), plans.train(texts, "presence_nb"),
    ]


def answers(df):
    return {r.doc_id: (r.predicted, None if r.prob is None else round(r.prob, 9)) for r in df.collect()}


def test_stored_composite_answers_like_the_one_in_hand(spark, texts, models, tmp_path):
    path = str(tmp_path / "registry")
    asked = texts.select("doc_id", "domain", "text").union(spark.createDataFrame([(99, "none", "text")], "doc_id long, domain string, text string"))
    status = composites.gather(models, path, 1)
    assert {r.status for r in status.collect()} == {"CREATED"}
    in_hand = answers(composites.classify_composite(asked, composites.composite_of(models)))
    again = answers(composites.classify_composite(asked, composites.load_composite(spark, path)))
    assert again[99] == (None, None) and len(again) == len(TEXTS) + 1
    # Both shards of a domain may have learned the same; then they count once when stored.
    votes = composites.member_votes(asked, composites.load_composite(spark, path))
    mean = {}
    for r in votes.collect():
        for s in r.dist:
            mean.setdefault(r.doc_id, {}).setdefault(s.label, []).append(s.prob)
    sizes = {r.domain: r.n_members for r in composites.load_composite(spark, path).members().collect()}
    domains = {i: d for i, d, _, _ in TEXTS}
    for i, by_label in mean.items():
        best = max(sorted(by_label), key=lambda c: round(sum(by_label[c]) / sizes[domains[i]], 12))
        assert again[i] == (best, pytest.approx(sum(by_label[best]) / sizes[domains[i]], abs=1e-8))
    assert set(in_hand) == set(again)


def test_many_members_are_scored_in_groups(spark, texts):
    options = plans.FeatureOptions(lexicon=lexicon(spark))
    rows = texts.select("doc_id", F.lit("d").alias("domain"), "text", F.when(F.col("label").isin("pos", "left"), "a").otherwise("b").alias("label"))
    copies = spark.range(2 * composites.GROUP + 3).select(F.col("id").alias("shard"))
    many = rows.join(copies, (F.col("doc_id") + F.col("shard")) % 5 != 0)
    params = plans.train_shards(many.withColumn("doc_id", F.col("doc_id") * 100 + F.col("shard")), "shard", options)
    got = answers(composites.classify_composite(rows, composites.composite_of([plans.TextModel("gaussian_nb", options, params=params)])))
    want = plans.classify_combined(rows, params, options)
    assert got == answers(want)


def test_gather_states_and_renewal(spark, texts, models, tmp_path):
    path = str(tmp_path / "registry")
    nothing = spark.createDataFrame([("zero",)], "domain string")
    state = lambda df: {r.domain: r.status for r in df.collect()}
    assert state(composites.gather(models[:2], path, 1, domains=nothing)) == {"d": "CREATED", "e": "CREATED", "f": "CREATED", "zero": "IGNORED"}
    assert state(composites.gather(models[:2][::-1], path, 2)) == {"d": "EXISTS", "e": "EXISTS", "f": "EXISTS"}
    assert state(composites.gather(models, path, 3)) == {"d": "CREATED", "e": "CREATED", "f": "CREATED"}
    assert len(composites.load_composite(spark, path).kinds) == 3
    assert set(state(composites.gather(models[:2], path, 4)).values()) == {"EXISTS"}
    assert len(composites.load_composite(spark, path).kinds) == 2
    # A member of the newest set cannot be read: the set before it answers.
    composites.gather(models, path, 5)
    lost = registry.load_headers(spark, f"{path}/composites").filter("algorithm = 'presence_nb'").select("model_id").distinct().collect()
    for r in lost:
        for folder in glob.glob(f"{path}/composites/params/domain=*/model_id={r.model_id}"):
            shutil.rmtree(folder)
    assert len(composites.load_composite(spark, path).kinds) == 2
    with pytest.raises(ValueError):
        composites.load_composite(spark, str(tmp_path / "none"))


def test_the_best_member_is_gathered_alone(spark, texts, models, tmp_path):
    path = str(tmp_path / "registry")
    status = {r.domain: r.n_members for r in composites.gather(models, path, 1, "best", evaluation=texts).collect()}
    assert set(status.values()) == {1}
    errors = composites.composite_errors(texts, composites.composite_of(models)).collect()
    alone = composites.composite_errors(texts, composites.load_composite(spark, path, "best")).collect()
    for r in alone:
        assert r.root_mean_sq_err == pytest.approx(min(e.root_mean_sq_err for e in errors if e.domain == r.domain))
    with pytest.raises(ValueError):
        composites.gather(models, path, 1, "best")


def test_heavy_terms_do_not_move(spark):
    """A word that is a third of all terms, on the way beyond the broadcast: equal answers, and it is in the head."""
    rows = [(i, "d", " ".join(["hot"] * 10 + [f"w{(i * 7 + k) % 40}" for k in range(15)] + [f"own{i}"] * (i % 4)), "ab"[i % 2]) for i in range(60)]
    texts = spark.createDataFrame([*rows, (90, "d", "", "a"), (91, "d", "hot", "b")], "doc_id long, domain string, text string, label string")
    answer = lambda learner: {r.doc_id: (r.predicted, round(r.prob, 9)) for r in plans.classify(texts, plans.train(texts, learner, plans.FeatureOptions(feature_select=False))).collect()}
    want = {name: answer(name) for name in plans.OF_WORDS}
    spark.conf.set("spark.tonemill.broadcastRows", "30")
    try:
        for name in plans.OF_WORDS:
            prepared = plans.prepare_model(plans.train(texts, name, plans.FeatureOptions(feature_select=False))).params
            heads = [r.term for r in prepared.terms.head.collect()]
            assert not prepared.terms.small and "hot" in heads and len(heads) <= 30
            assert prepared.terms.head.count() + prepared.terms.tail.count() == prepared.terms.table.count()
            assert answer(name) == want[name]
    finally:
        spark.conf.unset("spark.tonemill.broadcastRows")
