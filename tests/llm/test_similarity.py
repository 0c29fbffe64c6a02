"""Shingle joins, repeated strings and vector search against brute force."""

import itertools
import random

import numpy as np
import pytest

from tonemill.llm import components, jaccard_join, shingles, suffix_dedup, vector_search


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return sorted((i or 0, len(x), find(i) or 0) for i, x in sets)


def near_copies(seed, groups, size, words=60):
    """Groups of texts that differ by a few words each, texts that share a passage, and others."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage, texts = [word() for _ in range(40)], []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(6, words))]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own + (["extra"] * rnd.randint(0, 2))))
    texts += [" ".join([word() for _ in range(rnd.randint(1, 20))] + passage + [word() for _ in range(rnd.randint(1, 20))]) for _ in range(30)]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7))) for _ in range(40)]
    rnd.shuffle(texts)
    return list(enumerate(texts, 1))


def test_word_hashes_follow_words():
    texts = [b"A b\x0b c\xc2\xa0d", b"", b"  ", b"a B", b"x" * 3_000_000 + b" y", b"\xc3\x9f \xc3\x9f"]
    hashes, counts = shingles.word_hashes(texts)
    assert counts.tolist() == [3, 0, 0, 2, 2, 2]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[4] and hashes[7] == hashes[8] and len(set(hashes.tolist())) == 6
    whole = shingles.shingle_sets(texts)
    assert [len(s) for s in whole] == [1, 0, 0, 1, 1, 1] and whole[0][0] == shingles.shingle_sets([b"a b c\xc2\xa0d"])[0][0]


@pytest.mark.parametrize("common", [None, 0.0])
def test_links_against_all_pairs(spark, monkeypatch, common):
    rows = near_copies(1, 8, 9)
    if common is not None:  # every shingle counts as common and skips the sorted step
        monkeypatch.setattr(jaccard_join, "SKETCH", 1 << 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.link_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)


def test_one_large_group(spark, only_shuffles):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(80)] = f"x{rnd.random()}"
        rows.append((i + 1, " ".join(own)))
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)


def test_links_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = jaccard_join.link_components(odd_docs).collect()
    want = plain_components(odd_rows)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.link_components(no_docs).count() == 0


def test_an_id_with_several_texts_ties_them(spark):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (2, "p q r s t u"), (9, "a b c d e f"), (7, "z")]
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 2), (2, 2), (9, 2), (7, 7)}


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = components.label_components(spark.createDataFrame(links, "a long, b long"))
    assert {(r.node, r.label) for r in got.collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100)}


def plain_removal(rows):
    """(id, bytes, removed runs, kept) by the definition."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 99):
            window = data[k : k + 100]
            if window in seen:
                gone[k : k + 100] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out.append((i or 0, len(data), len(edges) // 2, bytes(b for b, g in zip(data, gone, strict=False) if not g)))
    return sorted(out)


def removal(docs):
    return sorted((r.doc_id or 0, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())


@pytest.mark.parametrize("gathered", [2_000, 2])
def test_repeats_against_all_windows(spark, monkeypatch, gathered):
    monkeypatch.setattr(suffix_dedup, "GATHERED", gathered)
    rnd = random.Random(6)
    prose = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    passages = [prose(rnd.randint(90, 300)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(rnd.randint(0, 200))]
        for _ in range(rnd.randint(0, 3)):
            passage = rnd.choice(passages)
            a = rnd.randint(0, 40)
            parts += [passage[a : len(passage) - rnd.randint(0, 40)], prose(rnd.randint(0, 60))]
        rows.append((i, "".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "ab" * 300), (203, "z" * 250), (204, "z" * 99), (205, "ab" * 49 + "a")]
    assert removal(spark.createDataFrame(rows, "doc_id long, text string")) == plain_removal(rows)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 512)
    rnd = random.Random(7)
    text = "".join(rnd.choice("abcdef ") for _ in range(5_000))
    rows = [(1, text), (2, text[700:3_300] + text[100:900]), (3, "q" * 4_000)]
    want = plain_removal(rows)
    part = [(i, t) for i, t in rows]
    found = [suffix_dedup.anchors([t.encode()]) for _, t in part]
    assert all((f[2] <= f[1]).all() and (f[3] - f[2] >= 100).all() for f in found)
    assert removal(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_repeats_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = removal(odd_docs)
    by_id = {i: (n, spans, kept) for i, n, spans, kept in got}
    want = {i: (n, spans, kept) for i, n, spans, kept in plain_removal([r for r in odd_rows if r[0] not in (10, 11)])}
    assert {i: x for i, x in by_id.items() if i not in (10, 11)} == want
    assert len(got) == 14 and by_id[10] == (7, 0, b"one row")  # equal rows are one document
    assert removal(no_docs) == []


def plain_nearest(rows, queries, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = set()
    for q in queries:
        for mine in (v for i, v in usable if i == q):
            best: dict = {}
            for i, v in usable:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), round(float(mine @ v), 9))
            out |= {(q, rank, i, s) for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


def search(table, k=20):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vector_search.nearest(table, table.where("vec_id % 20 = 0"), k).collect()}


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 4) * (1 + i % 3)).astype(float).tolist()) for i in range(70)]
    rows += [(100 + i, [1.0, 1.0, 0.0, -1.0]) for i in range(40)]  # one vector, many times
    rows += [(200, None), (201, [0.0, 0.0, -0.0, 0.0]), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 1.0, 0.0, 0.0]), (204, [float("inf"), 1.0, 0.0, 0.0])]
    rows += [(205, [1.0, 2.0]), (None, [9.0, 9.0, 9.0, 9.0]), (33, rows[33][1]), (220, []), (240, [-0.0, 0.0, 1.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, vector string, list string")
    four = [(i, v) for i, v in rows if v is not None and len(v) == 4]
    assert search(table) == plain_nearest(four, [i for i, _ in four if i is not None and i % 20 == 0], 20)
    assert search(table.limit(0)) == set()
    few = table.where("vec_id in (0, 1, 20)")
    assert {q: sum(r[0] == q for r in search(few)) for q in (0, 20)} == {0: 2, 20: 2}  # all there are


@pytest.mark.parametrize("norms", [False, True])
def test_recall(spark, norms):
    rng = np.random.default_rng(2)
    n, width = 4_000, 24
    centres = rng.normal(size=(12, width))
    points = centres[rng.integers(0, 12, n)] + 0.7 * rng.normal(size=(n, width))
    points *= (rng.random((n, 1)) + 0.5) if norms else 1 / np.linalg.norm(points, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = search(table)
    hits = 0
    for q in range(0, n, 20):
        scores = points @ points[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & {r[2] for r in got if r[0] == q})
    assert len(got) == n and hits >= 0.9 * n


def test_a_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "PIECE", 16)
    monkeypatch.setattr(vector_search, "BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 0.5]) if i % 3 == 0 else (i, rng.normal(size=3).round(3).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_nearest(rows, list(range(0, 600, 20)), 20)
    got = search(table)
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    assert {r for r in got if r[0] == 60} == {r for r in want if r[0] == 60}


def test_similar_sets_share_a_band(spark):
    """Sets that agree in a band are compared before whole lists are; unlike ones share none."""
    near = " ".join(f"w{i}" for i in range(150))
    texts = spark.createDataFrame([(1, near), (2, near.replace("w70 ", "x ")), (3, " ".join(f"y{i}" for i in range(150))), (4, "")], "node long, text string")
    nodes = spark.createDataFrame([(1, 146), (2, 146), (3, 146), (4, 0)], "node long, n long")
    bands = {}
    for r in jaccard_join._bands(texts, nodes).collect():
        bands.setdefault(r.node, set()).add(r.h)
        assert (r.n, r.pos) == (146, 0)
    assert set(bands) == {1, 2, 3} and all(len(b) == 16 for b in bands.values())
    assert bands[1] & bands[2] and not bands[3] & (bands[1] | bands[2])
