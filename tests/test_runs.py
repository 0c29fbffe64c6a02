"""Character runs that travel as fragments of their texts against a row per run."""

import random

import pytest

from tonemill.operators import counts, runs


def lines():
    seeded = random.Random(5)
    words = [(i, "ab"[i % 2], " ".join(seeded.choice(["haus", "maus", "größe", "the", "house", "zug"]) for _ in range(i % 40))) for i in range(60)]
    odd = ["", None, "x", "1234567", "12345678", "y" * 900, "été\n𝒳𝒴𝒵 𝒳𝒴𝒵 𝒳𝒴𝒵", "a\0b\0c\0d\0e", "".join(chr(0x4E00 + i % 700) for i in range(1500)), "".join(chr(0x1F300 + i) for i in range(40))]
    return words + [(100 + i, [None, "a", "c"][i % 3], t) for i, t in enumerate(odd)] + [(1, "b", "the house the house"), (None, "a", "the house of none"), (None, "a", None)]


def made(spark, order=8):
    return counts.with_char_grams(spark.createDataFrame(lines(), "doc_id long, label string, text string").repartition(3), order)


def answers(df):
    return sorted((str(r.doc_id), str(r.label), r.predicted, round(r.prob, 9), [(c.label, round(c.prob, 9)) for c in r.dist]) for r in df.collect())


@pytest.mark.parametrize("order", [1, 8])
def test_fragments_give_the_sums_of_single_runs(spark, monkeypatch, order):
    texts = made(spark, order)
    single = answers(counts.char_scores_among(texts.drop("_terms_of"), ["doc_id"], keep=["label"]))
    monkeypatch.setattr(counts, "_sums_of_terms", None)  # shuffles a row per run
    assert answers(counts.char_scores_among(texts, ["doc_id"], keep=["label"])) == single
    # Small chunks, and a bucket whose runs are compared in many slices.
    for name, value in {"BUCKETS": 2, "CHUNK_CHARS": 300, "CHUNK_TEXTS": 7, "SLICE_RUNS": 100, "BLOCK_RUNS": 40}.items():
        monkeypatch.setattr(runs, name, value)
    assert answers(counts.char_scores_among(texts, ["doc_id"], keep=["label"])) == single


def test_neighbouring_runs_share_their_characters(spark):
    """Fragments hold about half of the characters of their runs, before they are compressed."""
    text = " ".join(f"{random.Random(i).random()}" for i in range(3000))
    pieces = list(runs._fragments([text], 8))
    opened = [runs._opened(p) for _, p in pieces]
    assert sum(int(n.sum()) for n, _, _ in opened) == len(text) - 7
    assert sum(len(codes) for _, _, codes in opened) < 4.5 * len(text)
    cut = sorted("".join(map(chr, codes[s : s + 8])) for n, _, codes in opened for s in runs._ranges((n + 7).cumsum() - (n + 7), n))
    assert cut == sorted(text[i : i + 8] for i in range(len(text) - 7))
