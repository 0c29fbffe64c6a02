"""Hoeffding trees and support vector machines against plain code, and increments against one build."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.operators import bayes, increments
from tonemill.plans import training as plans
from tonemill.plans.fixtures import lexicon

F2 = ["u", "v"]


def rows_of(n, seed, noise=0.05):
    """Two domains: in ``p`` a class is a corner of the square, in ``q`` it is one side."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        u, v = rnd.random(), rnd.random()
        truth = ("yes" if u > 0.5 and v > 0.25 else "no") if i % 3 else ("yes" if v < 0.75 else "no")
        if rnd.random() < noise:
            truth = "yes" if truth == "no" else "no"
        out.append((i, "p" if i % 3 else "q", u, v, truth))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, domain string, u double, v double, label string")


def entropy(labels):
    n = len(labels)
    return -sum(c / n * math.log2(c / n) for c in (labels.count(k) for k in set(labels))) if n else 0.0


def plain_split(rows, width=increments.BIN_WIDTH):
    """(feature, cut, gain, second) by trying every bin edge."""
    labels, best = [r[4] for r in rows], []
    for f, k in (("u", 2), ("v", 3)):
        edges = sorted({(math.floor(r[k] / width) + 1) * width for r in rows})[:-1]
        tried = []
        for cut in edges:
            left, right = [r[4] for r in rows if r[k] < cut], [r[4] for r in rows if r[k] >= cut]
            tried.append((round(entropy(labels) - (len(left) * entropy(left) + len(right) * entropy(right)) / len(rows), 9), -cut))
        best.append((*max(tried), f))
    best.sort(key=lambda b: (-b[0], b[2]))
    return best[0][2], -best[0][1], best[0][0], best[1][0]


def test_best_split_by_trying_all(spark):
    rows = rows_of(900, 1)
    cells = increments.leaf_counts(frame(spark, rows).withColumn("node", F.lit(1).cast("long")), F2)
    got = {r.domain: r for r in increments.split_candidates(cells, ["no", "yes"]).collect()}
    for d in "pq":
        mine = [r for r in rows if r[1] == d]
        feature, cut, gain, second = plain_split(mine)
        assert (got[d].feature, got[d].cut, got[d].n) == (feature, cut, len(mine))
        assert got[d].gain == pytest.approx(gain, abs=2e-9) and got[d].second == pytest.approx(second, abs=2e-9)
        bound = math.sqrt(math.log(1 / increments.DELTA) / (2 * len(mine)))
        assert got[d].bound == pytest.approx(bound) and got[d].splits == (gain - second > bound or bound < increments.TIE)


def test_tree_learns_corners_and_answers_by_leaf(spark):
    rows = rows_of(4000, 2)
    params = increments.tree_fit(frame(spark, rows), F2)
    scored = bayes.pick_class(increments.tree_scores(frame(spark, rows_of(1000, 3, 0.0)).union(frame(spark, [(0, "none", 0.5, 0.5, "yes")])), params, F2)).collect()
    right = sum(r.predicted == r.label for r in scored if r.domain != "none") / 1000
    assert right > 0.93 and all(r.predicted is None for r in scored if r.domain == "none")
    splits = {(r.domain, r.node): (r.feature, r.cut) for r in increments._splits(params).collect()}
    assert len([k for k in splits if k[0] == "p"]) >= 2 and splits["q", 1] == ("v", 0.75)
    # Every row is at one leaf: the class counts of the leaves add up to the rows.
    at_leaves = increments._cells(params).filter("feature = ''").groupBy("domain").agg(F.sum("n").alias("n")).collect()
    assert {r.domain: r.n for r in at_leaves} == {d: sum(r[1] == d for r in rows) for d in "pq"}


def test_counts_of_increments_are_those_of_one_build(spark):
    rows = rows_of(90, 4, 0.4)  # too few to split
    as_set = lambda p: sorted(map(tuple, p.select("domain", "label", "feature", "n").collect()))
    whole = increments.tree_fit(frame(spark, rows), F2)
    assert not increments._splits(whole).count()
    step = increments.tree_fit(frame(spark, rows[:40]), F2)
    step = increments.tree_fit(frame(spark, rows[40:70]), F2, step)
    assert as_set(increments.tree_fit(frame(spark, rows[70:]), F2, step)) == as_set(whole)


def test_tree_of_increments_splits_and_goes_on(spark):
    params = None
    for i in range(4):
        params = increments.tree_fit(frame(spark, rows_of(1500, 10 + i)), F2, params)
    scored = bayes.pick_class(increments.tree_scores(frame(spark, rows_of(600, 20, 0.0)), params, F2)).collect()
    assert sum(r.predicted == r.label for r in scored) / 600 > 0.9
    assert sum(r.n for r in params.filter("feature = ''").collect()) == 6000


def test_odd_rows_of_trees(spark):
    odd = frame(spark, [(1, "p", None, 0.5, "yes"), (2, "p", float("inf"), None, "no"), (3, "p", None, None, "yes"), (4, "one", 0.1, 0.1, "only")])
    odd = odd.filter("u is null or u < 1e9")
    params = increments.tree_fit(odd, F2)
    assert {r.predicted for r in bayes.pick_class(increments.tree_scores(odd, params, F2)).collect()} <= {"yes", "no", "only"}
    assert increments.tree_fit(odd.limit(0), F2).count() == 0
    assert increments.svm_fit(odd.limit(0), F2, rounds=2).count() == 0


def plain_svm(rows, rounds, penalty, start=None, made=0):
    x = np.array([[r[2], r[3], 1.0] for r in rows])
    out = {}
    for c in sorted({r[4] for r in rows}):
        y = np.array([1.0 if r[4] == c else -1.0 for r in rows])
        w = np.zeros(3) if start is None else start[c].copy()
        for t in range(made + 1, made + rounds + 1):
            inside = y * (x @ w) < 1
            w = (1 - 1 / t) * w + (y[inside, None] * x[inside]).sum(0) / (penalty * t * len(rows))
        out[c] = w
    return out


def weights_of(params, domain):
    got = {}
    for r in params.filter(F.col("domain") == domain).collect():
        if r.feature:
            got.setdefault(r.label, {})[r.feature] = r["mean"]
    return {c: np.array([w[f] for f in [*F2, "bias"]]) for c, w in got.items()}


def test_svm_against_plain_steps(spark):
    rows = rows_of(300, 5)
    params = increments.svm_fit(frame(spark, rows), F2, rounds=12, penalty=0.05)
    for d in "pq":
        want = plain_svm([r for r in rows if r[1] == d], 12, 0.05)
        assert all(np.allclose(weights_of(params, d)[c], want[c]) for c in want)
    more = rows_of(200, 6)
    grown = increments.svm_fit(frame(spark, [r for r in more if r[1] == "p"]), F2, params, rounds=5, penalty=0.05)
    want = plain_svm([r for r in more if r[1] == "p"], 5, 0.05, weights_of(params, "p"), 12)
    assert all(np.allclose(weights_of(grown, "p")[c], want[c]) for c in want)
    assert all(np.allclose(weights_of(grown, "q")[c], weights_of(params, "q")[c]) for c in want)
    weights_of_all = {d: weights_of(params, d) for d in "pq"}
    scored = bayes.pick_class(increments.svm_scores(frame(spark, rows), params, F2)).collect()
    for r in scored:  # the class of the greatest margin
        margins = {c: w @ [r.u, r.v, 1.0] for c, w in weights_of_all[r.domain].items()}
        assert r.predicted == max(margins, key=margins.get)


def test_learners_by_name_through_the_registry(spark, tmp_path):
    texts = [(i, "d", ("orre that. rewh" if i % 2 else "idiot, trash moron") + f" {i}", "pos" if i % 2 else "neg") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, domain string, text string, label string")
    options = plans.FeatureOptions(lexicon=lexicon(spark))
    for learner in increments.LEARNERS:
        path = str(tmp_path / learner)
        plans.build(df.filter("doc_id < 30"), path, 1, learner, options)
        plans.increment(df.filter("doc_id >= 30"), path, 2, options, learner=learner)
        model = plans.load_model(spark, path, learner)
        assert model.params.filter("feature = ''").agg(F.sum("n")).first()[0] == 60
        assert {r.predicted for r in plans.classify(df, model, keep=["label"]).filter("label = 'pos'").collect()} <= {"pos", "neg"}
    assert all(r.predicted == r.label for r in plans.classify(df, model, keep=["label"]).collect())


def test_nominal_and_numeric_attributes_against_plain_bayes(spark):
    from tonemill.operators import mixed

    rnd = random.Random(9)
    rows = [(i, "d" if i % 3 else "e", rnd.gauss(i % 2, 1.0), rnd.choice("abc") if i % 5 else None, str(rnd.randrange(2 + i % 2)), "ny"[i % 2]) for i in range(120)]
    schema = "doc_id long, domain string, x double, c string, k string, label string"
    df = spark.createDataFrame(rows, schema)
    stats = mixed.mixed_fit(df, ["x"], ["c", "k"], ["domain"])
    halves = mixed.mixed_fit(df.filter("doc_id < 50"), ["x"], ["c", "k"], ["domain"]).unionByName(mixed.mixed_fit(df.filter("doc_id >= 50"), ["x"], ["c", "k"], ["domain"]))
    asked = spark.createDataFrame([(1, "d", 0.3, "a", "1", ""), (2, "d", 0.9, None, "2", ""), (3, "e", -1.0, "never", None, ""), (4, "none", 0.0, "a", "0", "")], schema)
    for model in (stats, mixed.merge_mixed(halves, ["domain"])):
        got = {r.doc_id: r for r in mixed.mixed_classify(asked, model, ["x"], ["c", "k"], ["domain"], spread=["doc_id"]).collect()}
        assert got[4].predicted is None and len(got) == 4
        for i, d, x, c, k, _ in asked.collect()[:3]:
            scores = {}
            mine = [r for r in rows if r[1] == d]
            moments = {y: np.array([r[2] for r in mine if r[5] == y]) for y in "ny"}
            floor = max(m.var() for m in moments.values()) * bayes.VARIANCE_FLOOR
            for y in "ny":
                var = moments[y].var() + floor
                score = math.log(len(moments[y]) / len(mine)) - 0.5 * math.log(2 * math.pi * var) - (x - moments[y].mean()) ** 2 / (2 * var)
                for place, value in ((3, c), (4, k)):
                    if value is not None:
                        known = [r[place] for r in mine if r[place] is not None]
                        own = [r[place] for r in mine if r[place] is not None and r[5] == y]
                        score += math.log((own.count(value) + 1) / (len(own) + len(set(known))))
                scores[y] = math.exp(score)
            assert {s.label: s.prob for s in got[i].dist} == {y: pytest.approx(scores[y] / sum(scores.values())) for y in "ny"}


def test_only_the_newest_versions_are_read(spark, tmp_path):
    from tonemill.sources import registry

    path = str(tmp_path / "registry")
    made = lambda v, domain: spark.createDataFrame([(domain, "a", "x", 3, float(v), 1.0), (domain, "b", "x", 4, 2.0 * v, 1.0)], "domain string, label string, feature string, n long, mean double, m2 double")
    for v in range(1, 6):
        registry.save_models(made(v, "d/1 =%$").unionByName(made(v + 10, "other")), path, "gaussian_nb", v)
    newest = registry.latest_model(spark, path)
    assert {(r.domain, r.label): r["mean"] for r in newest.collect()} == {("d/1 =%$", "a"): 5.0, ("d/1 =%$", "b"): 10.0, ("other", "a"): 15.0, ("other", "b"): 30.0}
    assert len({f.rsplit("/", 1)[0] for f in newest.inputFiles()}) == 2
    assert registry.latest_model(spark, path, domain="other").count() == 2
    assert registry.latest_model(spark, str(tmp_path / "nothing")).count() == 0


def test_an_observed_load_counts_what_it_stores(spark, tmp_path):
    from tonemill.operators import evaluate

    lines = spark.createDataFrame([(f"{i}",) for i in range(10)], "value string")
    split = lambda d: d.withColumn("reason", F.when(F.col("value") > "6", "too large"))
    kept, rejected, audit = evaluate.observed_load(lines, split, str(tmp_path / "whole"))
    assert (kept.count(), rejected.count()) == (7, 3) and tuple(audit.first()) == (10, 7, 3, 0, False)
    lossy = lambda d: split(d).filter("value <> '2'")
    assert tuple(evaluate.observed_load(lines, lossy, str(tmp_path / "cut"))[2].first()) == (10, 6, 3, 1, True)
    nothing = evaluate.observed_load(lines.limit(0), split, str(tmp_path / "none"))
    assert tuple(nothing[2].first()) == (0, 0, 0, 0, False) and nothing[0].count() == 0
