"""Quality rules [native]: decision lists learned by sequential covering.

Statistics of every whole text are column expressions.  From the labelled rows a list of rules
for bad documents is learned: each rule is a conjunction of threshold conditions, grown by
information gain on two thirds of the labelled rows and pruned from its end on the other third;
the rows it covers are set aside and the next rule is learned from the rest.  The list becomes
one ordered conditional expression.

The labelled rows stay distributed: a growing step is one aggregate of (feature, bin) counts, of
which at most ``features x (bins + 1)`` rows reach the driver, whatever the size of the table.

Defined results: null text has no word.  Labels that are null, or whose id is null or has no
document, are not learned from; repeated labels count as often as they occur.  Without labels
of both kinds no rule is learned and every text that does not fail the base is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.session import durable

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "mark_share", "line_words"]


def repeated_words(hashes: Column, windows: Column, sorted_windows: Column) -> Column:
    """How many words lie in windows that occur twice or more.

    ``sorted_windows`` holds (hash, position) of every window, sorted; neighbours of equal hash
    are repeats.  Their positions, in order, each add the words not covered before.
    """
    last = F.size(sorted_windows) - 1
    alike = lambda x, j: ((j > 0) & (F.get(sorted_windows, j - 1)["h"] == x["h"])) | (
        (j < last) & (F.get(sorted_windows, j + 1)["h"] == x["h"])
    )
    places = F.sort_array(F.transform(F.filter(sorted_windows, alike), lambda x: x["p"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, features) of every whole text.

    Window hashes are 64 bits of the hashes of eight words and are only compared inside a text.
    Arrays that several expressions read are columns of their own projection, so that each is
    made once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.array_remove(F.split("t", SPACE), ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1))
    windows = F.when(F.size("hashes") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))))
    rows = rows.withColumn("windows", windows)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    rows = rows.withColumn("sorted", F.when(repeats, F.sort_array(placed)))
    without = lambda chars: F.length(F.translate("t", chars, ""))
    n = F.size("words").cast("long")
    word_chars = without(" \t\n\x0b\x0c\r").cast("long")
    per_char = lambda x: x / F.greatest(word_chars, F.lit(1))
    per_word = lambda x: x / F.greatest(n, F.lit(1))
    upper = F.length("t") - without("".join(map(chr, range(65, 91))))
    marks = F.length("t") - without("!?;:")
    n_repeat = F.coalesce(F.when(F.col("sorted").isNotNull(), repeated_words(F.col("hashes"), F.col("windows"), F.col("sorted"))), F.lit(0)).cast("long")
    n_dup = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    n_symbols = (F.length("t") - without(SYMBOLS)).cast("long")
    rows = rows.select(
        F.col("id").alias(id_col),
        n.alias("n_words"),
        word_chars.alias("word_chars"),
        n_symbols.alias("n_symbols"),
        n_dup.alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        per_word(F.size(F.array_distinct("words"))).alias("distinct_share"),
        per_char(upper).alias("upper_share"),
        per_char(marks).alias("mark_share"),
    )
    least_one = lambda c: F.greatest(F.col(c), F.lit(1))
    return rows.select(
        id_col,
        *COUNTS,
        (F.col("word_chars") / least_one("n_words")).alias("mean_word"),
        (F.col("n_symbols") / least_one("word_chars")).alias("symbol_share"),
        (F.col("n_dup_lines") / least_one("n_lines")).alias("dup_line_share"),
        (F.col("n_repeat_words") / least_one("n_words")).alias("repeat_share"),
        (F.col("n_words") / least_one("n_lines")).alias("line_words"),
        "distinct_share",
        "upper_share",
        "mark_share",
    )


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold``, or ``feature < threshold``."""

    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions, with the bad and good rows it covered when it was pruned."""

    conditions: tuple[Condition, ...]
    bad: int = field(default=0, compare=False)
    good: int = field(default=0, compare=False)

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class Learning:
    """Parameters: thresholds per feature, size of the list, and what a rule must reach when pruned."""

    bins: int = 64
    max_rules: int = 8
    max_conditions: int = 4
    min_precision: float = 0.95
    min_cover: int = 5


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    if p <= 0:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Cut points per feature: quantiles of the bad and of the good rows, from the least to the largest value."""
    shares = [i / (bins // 2 - 1) for i in range(bins // 2)]
    cut = [F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]
    found: dict[str, set[float]] = {f: set() for f in FEATURES}
    for row in rows.groupBy("bad").agg(*cut).collect():
        for f in FEATURES:
            found[f] |= set(row[f] or [])
    return {f: sorted(v) for f, v in found.items()}


def _counts(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """(bad, good) rows per feature and bin; a bin is how many cut points the value reaches."""
    bin_of = lambda f: F.size(F.filter(F.array(*map(F.lit, thresholds[f])), lambda t: t <= F.col(f)))
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in FEATURES if thresholds[f]])
    melted = rows.select("bad", F.explode(pairs).alias("x")).groupBy("x.f", "x.b")
    got = melted.agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect()
    found: dict[str, dict[int, tuple[int, int]]] = {}
    for r in got:
        found.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    return found


def _best(counts: dict[str, dict[int, tuple[int, int]]], thresholds: dict[str, list[float]]) -> tuple[float, Condition, int] | None:
    """The condition of the highest gain with the good rows it leaves; ties go to the first by name."""
    best: tuple[float, Condition, int] | None = None
    for f in sorted(counts):
        p0 = sum(p for p, _ in counts[f].values())
        n0 = sum(n for _, n in counts[f].values())
        if not p0:
            return None
        p = n = 0
        for k in range(len(thresholds[f]), 0, -1):  # rows that reach the k-th cut point
            p += counts[f].get(k, (0, 0))[0]
            n += counts[f].get(k, (0, 0))[1]
            for at_least, bad, good in ((True, p, n), (False, p0 - p, n0 - n)):
                gain = _gain(p0, n0, bad, good)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Condition(f, at_least, thresholds[f][k - 1]), good)
    return best


def _prune(rows: DataFrame, conditions: list[Condition]) -> Rule:
    """Cut conditions from the end where the rows not grown on say that fewer do as well."""
    prefixes = [Rule(tuple(conditions[: i + 1])) for i in range(len(conditions))]
    sums = []
    for i, rule in enumerate(prefixes):
        covered = rule.column()
        sums += [F.sum((covered & F.col("bad")).cast("long")).alias(f"p{i}"), F.sum((covered & ~F.col("bad")).cast("long")).alias(f"n{i}")]
    got = rows.agg(*sums).first()
    scored = []
    for i, rule in enumerate(prefixes):
        p, n = got[f"p{i}"] or 0, got[f"n{i}"] or 0
        scored.append(((p - n) / (p + n) if p + n else -1.0, p, -i, Rule(rule.conditions, p, n)))
    return max(scored, key=lambda s: s[:3])[3]


def learn_rules(labelled: DataFrame, how: Learning | None = None) -> list[Rule]:
    """An ordered list of rules for bad rows.  ``labelled`` has the features, ``bad`` and ``part`` (0 to 2)."""
    how = how or Learning()
    thresholds = _thresholds(labelled, how.bins)
    if not any(thresholds.values()):  # no labelled row
        return []
    rules: list[Rule] = []
    rest = labelled
    while len(rules) < how.max_rules:
        grow, conditions = rest.where("part > 0"), []
        while len(conditions) < how.max_conditions:
            found = _best(_counts(grow, thresholds), thresholds)
            if found is None:
                break
            conditions.append(found[1])
            grow = grow.where(found[1].column())
            if not found[2]:
                break
        if not conditions:
            break
        rule = _prune(rest.where("part = 0"), conditions)
        if rule.bad < how.min_cover or rule.bad < how.min_precision * (rule.bad + rule.good):
            break
        rules.append(rule)
        rest = rest.where(~rule.column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: false for the first rule that fits, else true."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.column(), F.lit(False)).otherwise(kept)
    return kept


def rule_name(rules: list[Rule]) -> Column:
    """Which rule decided, as text; null if none."""
    name = F.lit(None).cast("string")
    for rule in reversed(rules):
        name = F.when(rule.column(), F.lit(str(rule))).otherwise(name)
    return name


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge_quality(docs: DataFrame, labels: DataFrame, how: Learning | None = None, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """(id, counts, base_failed, kept, rule) of every document, judged by rules learned from its labels.

    The statistics are narrow and stored once; learning and judging read them.
    """
    stats = durable(text_statistics(docs, id_col, text_col), "quality-statistics")
    marks = labels.select(F.col(id_col), F.col(quality_col).alias("quality")).where("quality is not null")
    part = F.pmod(F.xxhash64(id_col), F.lit(3))
    labelled = stats.join(marks, id_col).select(*FEATURES, (F.col("quality") == 0).alias("bad"), part.alias("part"))
    rules = learn_rules(durable(labelled, "quality-labelled"), how)
    out = stats.withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & verdict(rules)
    return out.select(id_col, *COUNTS, "base_failed", kept.alias("kept"), rule_name(rules).alias("rule"))
