"""Projection passes, scalar clusters and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.llm import projection_passes, queries, scalar_clusters, spelling_variants

EXTRA = ["id", "node", "n", "block", "key", "dims", "vector", "links", "other", "cluster", "distance", "word", "run", "label"]


def vector_table(spark, rows, kind="double"):
    """Rows (vec_id, embedding) with extra columns named like those used inside."""
    schema = f"vec_id long, embedding array<{kind}>, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(i, v, *["x"] * len(EXTRA)) for i, v in rows], schema)


def plain_links(rows, threshold=0.9):
    """(id, number of links, component, kept) by comparing every pair."""
    usable = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {k: set() for k in range(len(rows))}
    for a, (_, x) in enumerate(rows):
        for b, (_, y) in enumerate(rows[:a]):
            if usable(x) and usable(y) and len(x) == len(y):
                x_, y_ = (np.array(v) / np.abs(v).max() for v in (x, y))
                if (x_ * y_).sum() / np.sqrt((x_ * x_).sum() * (y_ * y_).sum()) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out, seen = [], {}
    for a in range(len(rows)):
        if a not in seen:
            members, todo = {a}, [a]
            while todo:
                for b in links[todo.pop()] - members:
                    members.add(b)
                    todo.append(b)
            ids = [rows[b][0] for b in members if rows[b][0] is not None]
            seen |= dict.fromkeys(members, min(ids, default=None))
        out.append((rows[a][0], len(links[a]), seen[a], rows[a][0] == seen[a]))
    return sorted(out, key=str)


def answers(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def group_of(rng, size, noise, width=8):
    base = rng.normal(size=width)
    return [(base + noise * rng.normal(size=width)).tolist() for _ in range(size)]


ODD = [
    (1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] + [0.0] * 6), (5, [float("nan")] + [1.0] * 7), (6, [float("inf")] + [1.0] * 7),
    (7, [1.0] * 8), (7, [1.0] * 8), (8, [2.0] * 8), (9, [-1.0] * 8), (9, [1.0] * 7 + [1.1]), (None, [1.0] * 8), (None, [-3.0, 5.0] * 4),
    (10, [1.0] * 4), (11, [1.0] * 4), (12, [1e200] * 8), (13, [1e-200] * 8), (14, [-0.0, 1.0] * 4), (15, [0.0, 1.0] * 4),
]


def test_links_of_odd_vectors(spark):
    assert answers(projection_passes.link_near(vector_table(spark, ODD))) == plain_links(ODD)
    assert projection_passes.link_near(vector_table(spark, [])).count() == 0
    assert answers(projection_passes.link_near(vector_table(spark, ODD[:6]))) == plain_links(ODD[:6])


def test_links_of_crowded_groups_in_narrow_windows(spark):
    """Groups of several windows: the window grows, pairs met in several passes count once, copies count each."""
    rng = np.random.default_rng(5)
    vectors = group_of(rng, 150, 0.05) + group_of(rng, 40, 0.25) + [v for _ in range(30) for v in group_of(rng, 3, 0.1)]
    vectors += [vectors[0]] * 60 + [vectors[200]] * 3
    rows = list(enumerate(vectors))
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    found = answers(projection_passes.link_near(vector_table(spark, rows), window=16, passes=9))
    wanted = plain_links(rows)
    assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in wanted)
    true = {r[0]: r[1] for r in wanted}
    assert all(n <= true[i] for i, n, _, _ in found)
    again = answers(projection_passes.link_near(vector_table(spark, rows), window=1024))
    assert again == wanted


def test_floats_and_threshold(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(group_of(rng, 60, 0.35, 16))]
    assert answers(projection_passes.link_near(vector_table(spark, rows, "float"))) == plain_links(rows)
    assert answers(projection_passes.link_near(vector_table(spark, rows, "float"), 0.95)) == plain_links(rows, 0.95)


def test_passes_grow_with_the_table():
    counts = [projection_passes.passes_for(n) for n in (0, 1, 1024, 10_000, 10**6, 10**9)]
    assert counts[:3] == [1, 1, 1] and counts == sorted(counts) and counts[-1] > counts[3] > 1


def plain_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    import hashlib

    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    for _ in range(rounds):
        chosen = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), x in zip(kept, chosen, strict=True) if x == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((i, nearest(v), away(v, centroids[nearest(v)])) for i, v in kept), centroids


@pytest.mark.parametrize("size", [3, 200])
def test_clusters_follow_the_plain_algorithm(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, rng.normal(scale=0.01, size=64).round(2).tolist()) for i in range(size)]
    rows += rows[:2] * 2  # repeated rows count
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [1.0] * 63), (904, [float("inf")] * 64), (905, [float("nan")] * 64), (906, [1e300] * 64)]
    assigned, centroids = scalar_clusters.cluster(vector_table(spark, rows + odd), 40, 5)
    wanted, plain = plain_clusters(rows, 40, 5)
    assert sorted(map(tuple, assigned.collect())) == wanted and centroids.tolist() == plain
    told = scalar_clusters.with_inertia(assigned, centroids).collect()
    assert len(told) == len(rows) and {r["inertia"] for r in told} == {sum(w[2] for w in wanted)}
    assert all(r["cluster_inertia"] == sum(w[2] for w in wanted if w[1] == r["cluster"]) for r in told)


def test_clusters_of_nothing_and_of_null_ids(spark):
    assigned, centroids = scalar_clusters.cluster(vector_table(spark, []), 40, 5)
    assert scalar_clusters.with_inertia(assigned, centroids).count() == 0
    rows = [(None, [0.5] * 64), (1, [0.25] * 64), (1, [-0.25] * 64)]
    assigned, centroids = scalar_clusters.cluster(vector_table(spark, rows), 2, 1)
    assert assigned.count() == 3 and len(centroids) == 2


def plain_words(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def plain_groups(counts, times=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_one_label_per_letter():
    letters = np.array([[ord(c)] for c in "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))], np.uint64)
    assert len(set(spelling_variants._label(spelling_variants._nodes(letters, 1), 0, 1).tolist())) == len(letters)


@pytest.mark.parametrize("letters", ["ab", "abcdeé"])
def test_near_words_by_brute_force(spark, letters):
    rnd = random.Random(len(letters))
    counts = {"".join(rnd.choice(letters) for _ in range(rnd.randint(7, 10))): rnd.choice([2, 3, 30, 400]) for _ in range(400)}
    for w in list(counts)[:60]:
        p = rnd.randrange(len(w))
        counts.setdefault(w[:p] + rnd.choice(letters) + w[p + rnd.randint(0, 1) :], rnd.choice([2, 3, 30]))
    counts |= {"a" * k: 10 ** (k % 4 + 1) for k in range(7, 40)}
    counts |= {"ab" * 1500: 2, "ab" * 1500 + "a": 50, "ab" * 700 + "b" + "ab" * 800: 7, "x" * 20_000: 3, "x" * 20_001: 40}
    counts = {w: n for w, n in counts.items() if len(w) >= 7}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling_variants.group_variants(words)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == plain_groups(counts)


def test_words_of_odd_documents(spark, odd_docs, odd_rows, no_docs):
    rows = odd_rows + [(i, "Wörterbuch wörterbuch ÉCLAIRAGE éclairage Éclairage naïvetés naïvetés aaaaaaaa×÷aaa") for i in range(20, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})
    counted = spelling_variants.counted_words(docs)
    assert {r["word"]: r["n"] for r in counted.collect()} == plain_words(rows)
    got = spelling_variants.group_variants(counted)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == plain_groups(plain_words(rows))
    assert spelling_variants.group_variants(spelling_variants.counted_words(odd_docs)).count() == len(plain_words(odd_rows))
    assert spelling_variants.group_variants(spelling_variants.counted_words(no_docs)).count() == 0


def test_spelling_query_on_the_smallest_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    wanted = plain_words(docs)
    got = queries.QUERIES["op13_spelling_variants"](spark, sf_dir).collect()
    assert {r["word"]: r["n"] for r in got} == wanted
    near = {}
    for w in wanted:  # words that agree after leaving out one letter of one or both
        for p in range(len(w) + 1):
            for key in {w, w[:p] + w[p + 1 :], w[:p] + "*" + w[p + 1 :]}:
                near.setdefault(key, set()).add(w)
    for r in got:
        w = r["word"]
        keys = {w} | {w[:p] + w[p + 1 :] for p in range(len(w))} | {w[:p] + "*" + w[p + 1 :] for p in range(len(w))}
        assert r["n_near"] == len({v for k in keys for v in near[k] if one_edit(w, v)})
