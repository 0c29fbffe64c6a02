import numpy as np
import pytest

from tonemill.operators import neighbours

SCHEMA = "id long, vector array<double>, label string"


def points(rng, n, dim, copies):
    rows = rng.normal(size=(n, dim))
    rows[: copies] = rows[0]  # a third of all rows are copies of one point
    return [(i, rows[i].tolist(), "abc"[i % 3]) for i in range(n)]


def brute(queries, train, k, skip_self):
    out = {}
    for q, v, _ in queries:
        gaps = sorted(
            (float(((np.array(v) - np.array(t)) ** 2).sum()), i) for i, t, _ in train if not (skip_self and i == q)
        )
        out[q] = [i for _, i in gaps[:k]]
    return out


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
@pytest.mark.parametrize("skip_self", [True, False])
def test_exact_with_copies_and_small_blocks(spark, block_rows, skip_self):
    rng = np.random.default_rng(3)
    data = points(rng, 120, 5, 40)
    df = spark.createDataFrame(data, SCHEMA)
    got = neighbours.nearest_rows(df, df, 4, skip_self=skip_self, block_rows=block_rows).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        found.setdefault(r.id, []).append(r.neighbour)
    assert found == brute(data, data, 4, skip_self)


def test_clustered_points_and_far_queries(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(scale=50, size=(6, 3))
    data = [(i, (centres[i % 6] + rng.normal(size=3)).tolist(), str(i % 6)) for i in range(150)]
    asked = [(1000 + i, (rng.normal(scale=200, size=3)).tolist(), "?") for i in range(30)]
    got = neighbours.nearest_rows(
        spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(data, SCHEMA), 3, block_rows=12
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        found.setdefault(r.id, []).append(r.neighbour)
    assert found == brute(asked, data, 3, False)


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b")], SCHEMA)
    got = neighbours.nearest_rows(df, df, 5, skip_self=True)
    assert {(r.id, r.neighbour) for r in got.collect()} == {(1, 2), (2, 1)}
    assert neighbours.nearest_rows(df, df.limit(0), 5).count() == 0


def test_vote_ties_go_to_the_nearest(spark):
    rows = [(1, 10, "b", 0.1, 1), (1, 11, "a", 0.2, 2), (1, 12, "a", 0.3, 3), (1, 13, "b", 0.4, 4)]
    df = spark.createDataFrame(rows, "id long, neighbour long, label string, dist2 double, rank int")
    assert neighbours.vote(df).first().predicted == "b"


FEATURES = ["x", "y"]


def local_brute(queries, train):
    values = np.array([[r[1], r[2]] for r in train])
    labels = np.array([r[3] for r in train])
    low, high = values.min(0), values.max(0)
    width = np.where(high > low, high - low, 1.0)
    out = {}
    for q in queries:
        v = np.array([q[1], q[2]])
        d = np.sqrt((((v - values) / width) ** 2).sum(1))
        w = np.maximum(1.0001 - (d / d.max() if d.max() > 0 else 0 * d), 0)
        logs, variances = {}, []
        stats = {}
        for c in sorted(set(labels)):
            m = labels == c
            mean = (w[m, None] * values[m]).sum(0) / w[m].sum()
            var = (w[m, None] * (values[m] - mean) ** 2).sum(0) / w[m].sum()
            stats[c] = (w[m].sum(), mean, var)
            variances += list(var)
        floor = 1e-9 * max(variances) if max(variances) > 0 else 1e-9
        for c, (n, mean, var) in stats.items():
            s = var + floor
            logs[c] = np.log(n / w.sum()) - 0.5 * np.log(2 * np.pi * s).sum() - ((v - mean) ** 2 / (2 * s)).sum()
        top = max(logs.values())
        e = {c: np.exp(x - top) for c, x in logs.items()}
        out[q[0]] = {c: x / sum(e.values()) for c, x in e.items()}
    return out


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_local_models(spark, block_rows):
    rng = np.random.default_rng(11)
    train = [(i, *rng.normal(loc=(i % 2) * 2, size=2).round(1).tolist(), "pn"[i % 2]) for i in range(40)]
    train += [(100 + i, 0.5, 0.5, "p") for i in range(20)]
    df = spark.createDataFrame(train, "doc_id long, x double, y double, label string")
    got = neighbours.classify_local(df, df, FEATURES, block_rows=block_rows).collect()
    want = local_brute(train, train)
    assert len(got) == len(train)
    for r in got:
        for c in r.dist:
            assert c.prob == pytest.approx(want[r.doc_id][c.label], abs=1e-6)


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_local_models_of_domains(spark, block_rows):
    """Every domain as if it were alone, in the same jobs; a query without a domain of training rows has no class."""
    rng = np.random.default_rng(12)
    made = {
        d: [(100 * i + j, *rng.normal(loc=(j % 2) * (i + 1), size=2).round(1).tolist(), "pn"[j % 2]) for j in range(n)]
        for i, (d, n) in enumerate([("a", 30), ("b", 9)])
    }
    rows = [(d, *r) for d, part in made.items() for r in part]
    schema = "domain string, doc_id long, x double, y double, label string"
    train = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([*rows, ("c", 900, 0.0, 0.0, "p"), (None, 901, 0.0, 0.0, "p")], schema)
    got = neighbours.classify_local(asked, train, FEATURES, block_rows=block_rows, by="domain", keep=["domain", "label"]).collect()
    want = {i: probs for part in made.values() for i, probs in local_brute(part, part).items()}
    assert sorted(r.doc_id for r in got) == sorted([*want, 900, 901])
    for r in got:
        if r.doc_id >= 900:
            assert r.predicted is None
            continue
        for c in r.dist:
            assert c.prob == pytest.approx(want[r.doc_id][c.label], abs=1e-6)


def test_queries_of_one_domain_are_cut_into_many_blocks(spark):
    cores = spark.sparkContext.defaultParallelism
    few = neighbours._rows_per_piece(spark, 100_000, 1, 20_000)
    assert 100_000 / few > 3 * cores or few == neighbours.QUERY_STEP
    assert neighbours._rows_per_piece(spark, 10**9, 10**4, 20_000) == 20_000


def test_local_model_of_equal_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "a"), (2, 1.0, 2.0, "b")], "doc_id long, x double, y double, label string")
    got = neighbours.classify_local(df, df, FEATURES).collect()
    assert [r.predicted for r in got] == ["a", "a"]
    with pytest.raises(ValueError):
        neighbours.classify_local(df, df.limit(0), FEATURES).collect()


def test_no_row_of_pairs_in_the_plan(spark):
    df = spark.createDataFrame([(i, [float(i)], "a") for i in range(10)], SCHEMA)
    plan = neighbours.nearest_rows(df, df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_equal_rows_count_as_often_as_they_can_be_near(spark):
    rows = [(i, [0.0, 1.0], "a" if i % 2 else "b") for i in range(200)] + [(1000, [3.0, 1.0], "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = neighbours._first_of_equal(df, "id", "vector", 3)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 1000]
    for skip_self in (True, False):
        got = neighbours.nearest_rows(df, df, 2, skip_self=skip_self).orderBy("id", "rank").collect()
        found = {}
        for r in got:
            found.setdefault(r.id, []).append(r.neighbour)
        assert found == brute(rows, rows, 2, skip_self)


@pytest.mark.parametrize(("n_asked", "n_points"), [(1, 1), (70, 1500), (130, 3000)])
def test_tiles_add_up_to_the_whole_sums(n_asked, n_points):
    rng = np.random.default_rng(9)
    asked, points, columns = rng.random((n_asked, 5)), rng.random((n_points, 5)), rng.random((n_points, 4))
    points[0] = asked[0]
    far, sums = neighbours._distance_sums(asked, points, columns)
    gaps = np.sqrt(((asked[:, None, :] - points[None, :, :]) ** 2).sum(2))
    assert np.allclose(far, gaps.max(1), rtol=1e-14, atol=0) and np.allclose(sums, gaps @ columns, rtol=1e-12, atol=0)
    assert (n_points > 1) or far[0] == 0.0
