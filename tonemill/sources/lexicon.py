"""Polarity lexicon: reading the tab-separated form and scoring its terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.functions.text import lookup_key, unnest
from tonemill.operators.joins import Lookup, store_lookup

# Part-of-speech marks of the lexicon and the score column each one feeds.
POS_COLUMNS = {"a": "score_adj", "r": "score_adv", "n": "score_noun", "v": "score_verb"}

FIELDS = 6


def parse_lines(lines: DataFrame, line: str = "value", order: list[str] | None = None) -> DataFrame:
    """Split lexicon lines into (pos, id, pos_score, neg_score, terms, gloss, line_no).

    Comment lines are skipped; any other line that has not exactly six fields
    fails the job, since a broken lexicon must not score anything.
    """
    kept = lines.filter(~F.trim(F.col(line)).startswith("#"))
    # Empty fields at the end of a line do not count.
    parts = F.split(F.rtrim(F.col(line), F.lit("\t")), "\t")
    message = F.concat(F.lit("lexicon line without six fields: "), F.col(line))
    checked = kept.withColumn(
        "_f", F.when(F.size(parts) == FIELDS, parts).otherwise(F.raise_error(message))
    )
    names = [F.col(c) for c in order or []]
    ordering = F.struct(*names) if len(names) > 1 else (names[0] if names else F.lit(0))
    return checked.select(
        F.col("_f")[0].alias("pos"),
        F.col("_f")[1].alias("id"),
        F.col("_f")[2].cast("double").alias("pos_score"),
        F.col("_f")[3].cast("double").alias("neg_score"),
        F.col("_f")[4].alias("terms"),
        F.col("_f")[5].alias("gloss"),
        ordering.alias("line_no"),
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon lines of one or more files, in file order."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return parse_lines(raw, order=["file", "block", "row"])


def lexicon_senses(lines: DataFrame) -> DataFrame:
    """One row per term of a line: (term, pos, rank, score, line_no)."""
    scored = lines.withColumn("score", F.col("pos_score") - F.col("neg_score"))
    senses = F.split("terms", " ")
    one = unnest(scored, senses, ["pos", "score", "line_no"], "sense").filter(F.col("sense") != "")
    return one.select(
        lookup_key(F.split("sense", "#")[0]).alias("term"),
        "pos",
        F.split("sense", "#")[1].cast("int").alias("rank"),
        "score",
        "line_no",
    ).filter(F.col("term") != "")


def score_lexicon(lines: DataFrame) -> DataFrame:
    """(term, pos, score): senses weighted by 1/rank; the last line of a rank wins."""
    per_rank = lexicon_senses(lines).groupBy("term", "pos", "rank").agg(
        F.max_by("score", "line_no").alias("score")
    )
    weight = F.lit(1.0) / F.col("rank")
    return per_rank.groupBy("term", "pos").agg(
        (F.sum(F.col("score") * weight) / F.sum(weight)).alias("score")
    )


def by_term(scores: DataFrame) -> DataFrame:
    """One row per term with a column for each part of speech and their sum."""

    def of(pos: str) -> Column:
        return F.sum(F.when(F.col("pos") == pos, F.col("score")).otherwise(0.0))

    wide = scores.groupBy("term").agg(*[of(p).alias(c) for p, c in POS_COLUMNS.items()])
    total = sum((F.col(c) for c in POS_COLUMNS.values()), F.lit(0.0))
    return wide.withColumn("score_total", total)


def prepare_lexicon(scores: DataFrame) -> Lookup:
    """The stored per-term form that vectorising joins with; prepare it once and reuse it."""
    return store_lookup(by_term(scores), "lexicon")
