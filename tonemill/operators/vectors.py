"""Sentiment vectors: lexicon scores per sentence, averaged over the document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.functions.sentiment import centred_class, overall_class
from tonemill.functions.text import lookup_key, lookup_words, sentences
from tonemill.operators.joins import Lookup, lookup_join
from tonemill.sources.lexicon import POS_COLUMNS, prepare_lexicon

FEATURES = [*POS_COLUMNS.values(), "score_all"]
# Fixed value: the overall score counts twice.
FEATURE_WEIGHTS = {"score_all": 2.0}

# Part-of-speech tags that feed each lexicon mark.
TAGS = {
    "a": ["JJ", "JJR", "JJS"],
    "r": ["RB", "RBR", "RBS"],
    "n": ["NN"],
    "v": ["VB", "VBD", "VBG", "VBZ", "VBN", "VBP"],
}

Tagger = Callable[[Column], Column]


def sentence_terms(
    docs: DataFrame, key: str, text: str, keep: list[str], tagger: Tagger | None
) -> DataFrame:
    """One row per word, and one row with a null term for a sentence or text without words."""
    by_sentence = docs.select(
        key, *keep, F.posexplode_outer(sentences(F.col(text))).alias("sentence_no", "sentence")
    )
    if tagger is None:
        term = F.explode_outer(lookup_words(F.col("sentence"))).alias("term")
        return by_sentence.select(key, *keep, "sentence_no", term)
    tagged = by_sentence.select(
        key, *keep, "sentence_no", F.explode_outer(tagger(F.col("sentence"))).alias("word")
    )
    return tagged.select(
        key, *keep, "sentence_no", lookup_key(F.col("word.token")).alias("term"),
        F.col("word.pos").alias("tag"),
    )


def sentence_scores(
    docs: DataFrame,
    lexicon: DataFrame | Lookup,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    tagger: Tagger | None = None,
) -> DataFrame:
    """Lexicon scores by part of speech for every sentence.

    Without a tagger a word counts under every part of speech it has in the
    lexicon.  The words meet the lexicon where they are read and are summed per
    sentence before anything is shuffled, so only one narrow row per sentence
    moves.
    """
    keep = keep or []
    terms = sentence_terms(docs, key, text, keep, tagger)
    prepared = lexicon if isinstance(lexicon, Lookup) else prepare_lexicon(lexicon)
    scored = lookup_join(terms, prepared, ["term"], "left", spread=[key])

    def score(pos: str, column: str) -> Column:
        value = F.coalesce(F.col(column), F.lit(0.0))
        return value if tagger is None else F.when(F.col("tag").isin(TAGS[pos]), value).otherwise(0.0)

    # Columns to keep are grouping keys: strings as aggregates would force a sort of every word.
    return scored.groupBy(key, *keep, "sentence_no").agg(
        *[F.sum(score(pos, column)).alias(column) for pos, column in POS_COLUMNS.items()]
    )


def sentence_class(scores: list[str] | None = None) -> Column:
    """Class -2..2 of a sentence from its total; rounding keeps the edges free of summing noise."""
    total = sum((F.col(c) for c in (scores or POS_COLUMNS.values())), F.lit(0.0))
    return centred_class(overall_class(F.round(total, 9)))


def sentiment_vectors(
    docs: DataFrame,
    lexicon: DataFrame | Lookup,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    tagger: Tagger | None = None,
) -> DataFrame:
    """Five scores per document: the mean of its sentence scores, zeros without sentences."""
    keep = keep or []
    per_sentence = sentence_scores(docs, lexicon, key, text, keep, tagger)
    graded = per_sentence.withColumn("score_all", sentence_class().cast("double"))
    return graded.groupBy(key, *keep).agg(*[F.avg(c).alias(c) for c in FEATURES])
