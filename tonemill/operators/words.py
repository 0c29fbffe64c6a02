"""Word features: frequencies, vocabularies, presence vectors, information gain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.functions.text import char_ngrams, char_windows, is_stop, prefixes, shingles, unnest, word_ngrams, words
from tonemill.operators.joins import lookup_join, store_lookup
from tonemill.session import durable


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words": lambda w: w,
    "shingles": shingles,
    "ngrams": word_ngrams,
}


def with_terms(
    df: DataFrame, tokenizer: str | Callable[[Column], Column] = "words", text: str = "text", name: str = "terms",
    lemmas: DataFrame | None = None, key: str = "doc_id",
) -> DataFrame:
    """Add the array of terms of a text; the word array is made once and then reused.

    With a lemma table (word, lemma) the words become lemmas before they are joined to shingles, and keep their order;
    ``key`` then names a text.  A tokenizer of one's own makes the terms itself, and these are looked up.
    """
    if callable(tokenizer):
        made = df.withColumn(name, tokenizer(F.col(text)))
        return made if lemmas is None else with_lemmas(made, lemmas, key, name)
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}; choose from {sorted(TOKENIZERS)}")
    made = df.withColumn("_words", words(F.col(text)))
    if lemmas is not None:
        made = with_lemmas(made, lemmas, key, "_words")
    return made.withColumn(name, TOKENIZERS[tokenizer](F.col("_words"))).drop("_words")


def with_lemmas(df: DataFrame, lemmas: DataFrame, key: str, name: str) -> DataFrame:
    """The words of an array column replaced by their lemmas, each in its place.

    Rows must differ in ``key``; what is gathered again is one text at a time.
    """
    rows = unnest(df, F.col(name), [key], "term", "pos")
    found = lemmatised(rows, lemmas, [key])
    placed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("_p"))
    per_text = placed.select(key, F.transform("_p", lambda x: x["term"]).alias("_lemmas"))
    empty = F.array().cast("array<string>")
    return df.join(per_text, key, "left").withColumn(name, F.coalesce("_lemmas", empty)).drop("_lemmas")


def lemmatised(rows: DataFrame, lemmas: DataFrame, spread: list[str], term: str = "term") -> DataFrame:
    """Replace words by their lemma where the lemma table (word, lemma) has one."""
    named = lemmas.select(F.col("word").alias(term), "lemma")
    joined = lookup_join(rows, named, [term], "left", spread=spread)
    return joined.withColumn(term, F.coalesce("lemma", F.col(term))).drop("lemma")


def term_frequency(
    df: DataFrame, key: list[str], terms: str = "terms", lemmas: DataFrame | None = None
) -> DataFrame:
    """(key..., term, n, first_pos): how often a term occurs in a text and where it comes first."""
    rows = unnest(df, F.col(terms), key, "term", "pos")
    if lemmas is not None:
        rows = lemmatised(rows, lemmas, key)
    return rows.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def char_ngram_counts(df: DataFrame, low: int, high: int, terms: str = "terms") -> DataFrame:
    """(gram, n) over the characters of all terms.

    Every position gives one window of the longest length; the windows, which are
    few, are counted first, and the shorter grams are the starts of the windows.
    """
    terms_ = unnest(df, F.col(terms), [], "term")
    windows = unnest(terms_, char_windows(F.col("term"), low, high), [], "window")
    counted = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    grams = counted.select("n", F.explode(prefixes(F.col("window"), low, high)).alias("gram"))
    return grams.groupBy("gram").agg(F.sum("n").alias("n"))


def shingle_ngram_counts(df: DataFrame, low: int, high: int, text: str = "text") -> DataFrame:
    """(gram, n) over the characters of all shingles of the texts, as ``char_ngram_counts`` gives them.

    Every gram of a pair is a gram of one of its words or holds the blank between them.  So a word is cut into grams
    once, and counts as often as it stands in a pair, and by itself unless it is a stop word; what is left of a pair is
    a joint, the few characters at both sides of its blank.  Words and joints repeat much more than pairs do.
    """
    tail = high - 1
    cut = df.select(words(F.col(text)).alias("_words"))
    ends = F.zip_with("_words", F.slice("_words", F.lit(2), F.greatest(F.size("_words"), F.lit(1))), lambda a, b: F.concat(F.substring(a, -tail, tail), F.lit(" "), F.substring(b, 1, tail)))
    joints = F.filter(ends, lambda x: x.isNotNull())
    sized = cut.select(F.concat("_words", joints).alias("_pieces"), F.size("_words").alias("_n"))
    pieces = unnest(sized, F.col("_pieces"), ["_n"], "piece", "pos")
    # A word is in a pair with the word before it and in one with the word after it.
    pairs = ((F.col("pos") > 0) & (F.col("pos") < F.col("_n"))).cast("int") + (F.col("pos") < F.col("_n") - 1).cast("int")
    counted = pieces.groupBy("piece", pairs.alias("pairs")).agg(F.count(F.lit(1)).alias("n"))
    joint = F.col("piece").contains(" ")
    # A joint counts once, also one that is a blank alone.
    times = F.col("n") * (F.col("pairs") + F.when(is_stop(F.col("piece")) & ~joint, 0).otherwise(1))
    weighted = counted.select("piece", times.alias("n")).filter(F.col("n") > 0)
    kept = F.filter(char_ngrams(F.col("piece"), low, high), lambda g: ~joint | g.contains(" "))
    return unnest(weighted, kept, ["n"], "gram").groupBy("gram").agg(F.sum("n").alias("n"))


def joined_distinct_terms(terms: Column) -> Column:
    """The distinct terms of a text in order of first use, joined by blanks."""
    return F.array_join(F.array_distinct(terms), " ")


def presence(df: DataFrame, keep: list[str], terms: str = "terms") -> DataFrame:
    """One row per text and distinct term; repeats vanish inside the row, without a shuffle."""
    return unnest(df, F.array_distinct(terms), keep, "term")


def vocabulary(batch: DataFrame, terms: str = "terms", min_docs: int = 1) -> DataFrame:
    """(term, n_docs) of the batch that fixes the vocabulary."""
    counted = presence(batch, [], terms).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.filter(F.col("n_docs") >= min_docs) if min_docs > 1 else counted


def presence_vectors(df: DataFrame, vocab: DataFrame, key: list[str], terms: str = "terms") -> DataFrame:
    """Long form of the word vectors: (key..., term) for every known term a text holds.

    A vocabulary beyond a broadcast meets the texts in two steps: the head of the terms that are in most texts is
    broadcast, and only terms that it does not have are shuffled to the tail.
    """
    weight = "n_docs" if "n_docs" in vocab.columns else None
    lookup = store_lookup(vocab.select("term", *([weight] if weight else [])), "vocabulary", weight)
    rows = presence(df, key, terms)
    if lookup.head is None:
        return lookup_join(rows, replace(lookup, table=lookup.table.select("term")), ["term"], "left_semi", spread=key)
    head = lookup.head.select("term", F.lit(True).alias("_met"))
    # Stored, so that the texts are not cut into words again for the terms that were not met.
    stored = durable(rows.join(F.broadcast(head), "term", "left").select(*key, "term", "_met"), "presence")
    met, missed = stored.filter("_met"), stored.filter("_met is null").drop("_met")
    return met.drop("_met").union(missed.join(lookup.tail.select("term"), "term", "left_semi").select(*key, "term"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def information_gain(
    df: DataFrame, terms: str = "terms", label: str = "label", by: list[str] | None = None
) -> DataFrame:
    """(by..., term, n_docs, gain) for every term that has a gain among the texts of its group."""
    rows = df if by else df.withColumn("_whole", F.lit(0))
    keys = by or ["_whole"]
    totals = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).cast("double").alias("n_c"))
    counts = presence(rows, [*keys, label], terms).groupBy(*keys, "term", label).agg(F.count(F.lit(1)).cast("double").alias("n_tc"))
    return gains_from_counts(counts, totals, keys, label).select(*(by or []), "term", "n_docs", "gain")


def gains_from_counts(counts: DataFrame, totals: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by..., term, n_docs, gain) from the texts that hold a term (by..., term, label, n_tc) and all texts (by..., label, n_c).

    With counts n the gain is a sum of ``n log2 n`` parts: over the classes, over
    the texts that hold the term, and over those that do not.  A class in which
    a term never occurs adds nothing but its own total, so only counts that
    exist are stored.
    """
    totals = store_lookup(totals, "classes")
    overall = totals.table.groupBy(*by).agg(
        F.sum("n_c").alias("n_all"), F.sum(_xlogx(F.col("n_c"))).alias("classes_part"), F.count(F.lit(1)).alias("n_classes")
    )
    with_total = lookup_join(counts, totals, [*by, label], "inner", spread=["term"])
    n_tc, n_c = F.col("n_tc"), F.col("n_c")
    per_term = with_total.groupBy(*by, "term").agg(
        F.sum("n_tc").alias("n_t"),
        F.sum(_xlogx(n_tc)).alias("with_part"),
        F.sum(_xlogx(n_c - n_tc) - _xlogx(n_c)).alias("without_change"),
        F.collect_list(F.struct("n_tc", "n_c")).alias("per_class"),  # one entry per class
    )
    measured = lookup_join(per_term, overall, by, "inner", spread=["term"])
    n_t, n, class_part = F.col("n_t"), F.col("n_all"), F.col("classes_part")
    prior = _xlogx(n) - class_part
    present = _xlogx(n_t) - F.col("with_part")
    absent = _xlogx(n - n_t) - (class_part + F.col("without_change"))
    gain = F.greatest((prior - present - absent) / n, F.lit(0.0))
    # A term tells nothing exactly if every class has its share of it; in doubles a small
    # gain could vanish, so that is decided in whole numbers.
    whole = lambda c: c.cast("decimal(19,0)")
    uneven = F.exists("per_class", lambda x: whole(x["n_tc"]) * whole(n) != whole(n_t) * whole(x["n_c"]))
    tells = uneven | (F.size("per_class") < F.col("n_classes"))
    return measured.filter(tells).select(*by, "term", n_t.cast("long").alias("n_docs"), gain.alias("gain"))


def ranked_terms(gains: DataFrame, k: int | None = None) -> DataFrame:
    """Terms from the highest gain down; equal gains in term order."""
    ordered = gains.orderBy(F.desc("gain"), "term")
    return ordered if k is None else ordered.limit(k)


def select_terms(df: DataFrame, gains: DataFrame, key: list[str], terms: str = "terms") -> DataFrame:
    """Presence rows that keep only terms with a gain."""
    return presence_vectors(df, gains, key, terms)

