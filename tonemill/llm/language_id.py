"""Language identification by interpolated Kneser-Ney character models.

For every language one model of four characters is estimated: absolute discounting with the
discounted mass given to the lower order, whose counts are continuation counts (distinct
characters before).  The models of all languages share sorted arrays of gram hashes, one per order,
each with a column of log-probabilities per language and, for contexts, of back-off weights; a
text is scored by binary search of its gram hashes.  The language of the lowest cross-entropy per
character wins.  A text whose cross-entropy lies far above what calibration documents of
that language have is marked as rejected.

Texts are read as lower-cased letters with single separators for whatever is between them.

Sizes: models are fitted on about ``sample_docs`` documents per language, picked by a hash of the
id (a documented bound on a fit), so arrays are bounded by it and are broadcast.  Every row
is predicted from its whole text, in the task that reads it; nothing is shuffled.

Defined results: a null text, or one without a letter, gets ``und`` and score 0 and is rejected.
Without labelled training text every row is ``und``.  Ties go to the first language by name.
Null or repeated ids and repeated rows are answered one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill.llm.pretokens import in_groups
from tonemill.llm.workers import map_batches

ORDER = 4
UNKNOWN = "und"
#: The share of calibration documents whose cross-entropy is usual; a single odd one does not set the limit.
USUAL_SHARE = 0.995
#: Characters, and rows of any kind, that are scored at a time.
SCORED_AT_ONCE = 150_000
ROWS_AT_ONCE = 1_000
#: Parameter: languages that models may be fitted for.
MAX_LANGUAGES = 1_000
#: How sharply a lower cross-entropy per character raises the score.
SHARPNESS = 12.0
#: A text is rejected above this multiple of the usual cross-entropy, if it has this many letters.
REJECT_ABOVE, REJECT_LETTERS = 1.7, 20
#: Calibration documents that a language must have; with fewer, all its documents calibrate in turns.
CALIBRATED_BY = 20
#: Turns of a language with few documents; each leaves out another part of them.
FOLDS = 5


@cache
def folding() -> np.ndarray:
    """The 16-bit symbol of every code point: its lower case, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint16)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = min(ord(low) if len(low) == 1 else point, 0xFFFF)
    return table


def mixed(grams: np.ndarray) -> np.ndarray:
    """A hash of packed grams; it maps one to one, so different grams never meet."""
    with np.errstate(over="ignore"):
        x = grams ^ (grams >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        return x * np.uint64(0xBF58476D1CE4E5B9)


def gram_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed grams of four symbols, index of their text, letters per text).

    Each text stands after three separators, so its first characters have a context too.
    """
    pad = ORDER - 1
    joined = "".join("\0" * pad + t for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) + pad for t in texts], np.int64)
    symbols = folding()[points]
    owner = np.repeat(np.arange(len(texts)), lengths)
    pads = np.zeros(len(points), bool)
    starts = np.cumsum(lengths) - lengths
    for i in range(pad):
        pads[starts + i] = True
    gap = symbols == 0
    keep = pads | ~gap
    keep[1:] |= ~gap[:-1]
    letters = np.bincount(owner[~gap], minlength=len(texts))
    symbols, owner, pads = symbols[keep].astype(np.uint64), owner[keep], pads[keep]
    grams = symbols.copy()
    for back in range(1, ORDER):
        grams[back:] |= symbols[:-back] << np.uint64(16 * back)
    real = ~pads
    return grams[real], owner[real], letters


@dataclass
class LanguageModels:
    """Sorted gram hashes per order, with a column per language."""

    languages: list[str]
    hashes: list[np.ndarray] = field(default_factory=list)  # by order, 1 first
    logs: list[np.ndarray] = field(default_factory=list)  # log-probability of the last symbol
    contexts: list[np.ndarray] = field(default_factory=list)  # by length of the context, 1 first
    backoffs: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """log p of each gram's last symbol for every language, backing off where the gram is new."""
        out = np.empty((len(grams), len(self.languages)), np.float32)
        todo = np.arange(len(grams))
        weight = None
        for order in range(ORDER, 0, -1):
            part = grams if order == ORDER else grams[todo] & np.uint64((1 << 16 * order) - 1)
            at, known = _find(self.hashes[order - 1], mixed(part))
            logs = self.logs[order - 1][at]
            if order == ORDER:
                out[:] = logs
                todo = np.flatnonzero(~known)
                part, weight = part[todo], np.zeros((len(todo), len(self.languages)), np.float32)
            else:
                out[todo[known]] = logs[known] + weight[known]
                todo, part, weight = todo[~known], part[~known], weight[~known]
            if not len(todo):
                return out
            if order > 1:
                at, known = _find(self.contexts[order - 2], mixed(part >> np.uint64(16)))
                weight = weight + np.where(known[:, None], self.backoffs[order - 2][at], 0)
        out[todo] = self.unseen + weight
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text for every language, and its letters."""
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts), np.int64)
        letters = np.zeros(len(texts), np.int64)
        for a, b in in_groups(texts, SCORED_AT_ONCE):
            grams, owner, n = gram_stream(texts[a:b])
            logs = self.log_probs(grams)
            for k in range(len(self.languages)):
                total[a:b, k] = np.bincount(owner, logs[:, k], minlength=b - a)
            count[a:b] = np.bincount(owner, minlength=b - a)
            letters[a:b] = n
        return -total / np.maximum(count, 1)[:, None], letters


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def estimate(languages: list[str], language: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> LanguageModels:
    """Interpolated Kneser-Ney models from the four-symbol gram counts of each language."""
    models = LanguageModels(languages)
    n_lang = len(languages)
    table: list[np.ndarray] = []  # by order: the grams of any language, sorted as numbers
    weights: list[np.ndarray] = []  # counts (of the highest order) or continuation counts
    top = np.unique(grams)
    full = np.zeros((len(top), n_lang))
    full[np.searchsorted(top, grams), language] = counts
    table, weights = [top], [full]
    for order in range(ORDER - 1, 0, -1):
        low = table[0] & np.uint64((1 << 16 * order) - 1)
        keys, group = np.unique(low, return_inverse=True)
        kinds = np.zeros((len(keys), n_lang))
        np.add.at(kinds, group, weights[0] > 0)
        table.insert(0, keys)
        weights.insert(0, kinds)
    symbols = len(table[0]) + 1
    lower = np.full((1, n_lang), 1.0 / symbols)
    models.unseen = np.zeros(n_lang, np.float32)
    for order in range(1, ORDER + 1):
        keys, c = table[order - 1], weights[order - 1]
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        discount = np.clip(discount, 0.1, 0.9)
        contexts, group = np.unique(keys >> np.uint64(16), return_inverse=True)
        total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        np.add.at(total, group, c)
        np.add.at(kinds, group, c > 0)
        share = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)  # of the lower order
        if order == 1:
            below = np.repeat(lower, len(keys), 0)
            models.unseen = np.log(share[0] * lower[0]).astype(np.float32)
        else:
            below = lower[np.searchsorted(table[order - 2], keys & np.uint64((1 << 16 * (order - 1)) - 1))]
        p = np.maximum(c - discount, 0) / np.maximum(total, 1)[group] + share[group] * below
        lower = p
        hashed = mixed(keys)
        by_hash = np.argsort(hashed)
        models.hashes.append(hashed[by_hash])
        models.logs.append(np.log(p[by_hash]).astype(np.float32))
        if order > 1:
            hashed = mixed(contexts)
            by_hash = np.argsort(hashed)
            models.contexts.append(hashed[by_hash])
            models.backoffs.append(np.log(share[by_hash]).astype(np.float32))
    return models


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of a table (lang, text), added up per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for a, b in in_groups(own):
                    grams, n = np.unique(gram_stream(own[a:b])[0], return_counts=True)
                    names = pa.array([lang] * len(grams), pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return map_batches(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, sample_docs: int = 2_000) -> LanguageModels:
    """Models from a table (id, text, lang), of which null texts and languages are left out.

    About ``sample_docs`` documents per language are used, four in five to count and the rest to calibrate.
    """
    rows = labelled.where("lang is not null and text is not null").select("id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModels([])
    # A document is drawn if its hash is below the share of its language that is wanted.
    share = F.lit(0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1_000_000, -(-sample_docs * 1_000_000 // sizes[lang]))).otherwise(share)
    draw = F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(1_000_000))
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(5)) == 0).where(draw < share)
    counts: pd.DataFrame = _gram_counts(rows.where("not calibrates").select("lang", "text")).toPandas()
    uncounted = sorted(set(languages) - set(counts["lang"]))
    if uncounted:  # so few documents that all of them calibrate
        counts = pd.concat([counts, _gram_counts(rows.where(F.col("lang").isin(uncounted)).select("lang", "text")).toPandas()])
    if not len(counts):
        return LanguageModels([])
    counts = counts.sort_values(["lang", "gram"])
    learned = sorted(counts["lang"].unique())
    index = counts["lang"].map({lang: i for i, lang in enumerate(learned)}).to_numpy()
    models = estimate(learned, index, counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy(np.float64))
    models.usual = np.full(len(learned), np.nan)
    for lang, high, n in _usual(rows.where("calibrates"), models):
        if n >= CALIBRATED_BY:
            models.usual[learned.index(lang)] = high
    few = [lang for lang, usual in zip(learned, models.usual, strict=True) if np.isnan(usual)]
    if few:
        _calibrate_in_turns(rows.where(F.col("lang").isin(few)), models, few, counts)
    return models


def _usual(rows: DataFrame, models: LanguageModels) -> list[tuple[str, float, int]]:
    """(lang, high quantile of the cross-entropy, documents) of the rows (id, lang, text) that are found to be of their language."""
    found = identify(rows.select("id", "text", "lang"), models, "id", "text", keep=["lang"])
    found = found.where(f"lang = lang_pred and n_letters >= {REJECT_LETTERS}").groupBy("lang")
    return [tuple(r) for r in found.agg(F.percentile_approx("entropy", USUAL_SHARE, 10_000).alias("high"), F.count("*").alias("n")).collect()]


def _calibrate_in_turns(rows: DataFrame, models: LanguageModels, few: list[str], counts: pd.DataFrame) -> None:
    """Sets the usual cross-entropy of languages with few documents; it is always finite.

    The documents are dealt to ``FOLDS`` parts; in turn each is scored by models that have not counted
    it, beside the models of all other languages.  The result is no lower than what gives the limit
    of letters drawn by the language's frequencies, which have no order to predict.  A language
    of which no document can be scored so gets the highest value of the others, if that is higher.
    """
    fold = F.pmod(F.xxhash64("id", "text", F.lit(29)), F.lit(FOLDS))
    rows = rows.select("id", "lang", "text", fold.alias("fold"))
    keyed = _gram_counts(rows.select(F.concat(F.col("fold").cast("string"), F.lit(":"), F.col("lang")).alias("lang"), "text")).toPandas()
    keyed["fold"] = keyed["lang"].str.split(":", n=1).str[0].astype(int)
    keyed["lang"] = keyed["lang"].str.split(":", n=1).str[1]
    others = counts[~counts["lang"].isin(few)]
    usual: dict[str, float] = {}
    for turn in sorted(keyed["fold"].unique()):
        own = keyed[keyed["fold"] != turn].groupby(["lang", "gram"], as_index=False)["n"].sum()
        known = pd.concat([others, own])
        learned = sorted(known["lang"].unique())
        if not learned:
            continue
        index = known["lang"].map({lang: i for i, lang in enumerate(learned)}).to_numpy()
        turned = estimate(learned, index, known["gram"].to_numpy().view(np.uint64), known["n"].to_numpy(np.float64))
        turned.usual = np.zeros(len(learned))
        for lang, high, _ in _usual(rows.where(F.col("fold") == int(turn)), turned):
            usual[lang] = max(high, usual.get(lang, 0.0))
    highest = max([*usual.values(), *models.usual[~np.isnan(models.usual)]], default=0.0)
    for lang in few:
        own = keyed[keyed["lang"] == lang]
        shares = own.groupby(own["gram"].to_numpy() & 0xFFFF)["n"].sum().to_numpy(np.float64)
        shares = shares / shares.sum()
        models.usual[models.languages.index(lang)] = max(usual.get(lang, highest), -(shares * np.log(shares)).sum() / REJECT_ABOVE)


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, lang_pred, score, entropy, n_letters, rejected) for every row."""
    keep = keep or []
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text"))
    new = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("entropy", T.DoubleType()), ("n_letters", T.LongType()), ("rejected", T.BooleanType())]
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, t) for n, t in new]])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep) + 1).to_pylist()]
            columns = predict(model, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return map_batches(rows, run, schema)


def without_rejected(docs: DataFrame, models: LanguageModels, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the models do not reject, as they are; each row goes to a worker once, whatever its columns."""
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                rejected = predict(shared.value, [t or "" for t in part.column(place).to_pylist()])[-1]
                yield part.filter(pc.invert(rejected))

    return map_batches(docs, run, docs.schema)


def predict(model: LanguageModels, texts: list[str]) -> list[pa.Array]:
    """Language, score, entropy, letters and rejection of each text."""
    n = len(texts)
    if not model.languages:
        letters = np.array([sum(map(str.isalpha, t)) for t in texts], np.int64)
        return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.float64()), pa.array(letters), pa.array([True] * n)]
    entropy, letters = model.entropies(texts)
    best = entropy.argmin(1) if n else np.zeros(0, np.int64)
    low = entropy[np.arange(n), best]
    odds = np.exp(-SHARPNESS * (entropy - low[:, None])).sum(1)
    silent = letters == 0
    rejected = silent | ((letters >= REJECT_LETTERS) & (low > REJECT_ABOVE * model.usual[best]))
    names = [UNKNOWN if s else model.languages[b] for s, b in zip(silent, best, strict=True)]
    return [
        pa.array(names, pa.string()),
        pa.array(np.where(silent, 0.0, 1 / odds)),
        pa.array(low, mask=silent),
        pa.array(letters.astype(np.int64)),
        pa.array(rejected),
    ]


def held_out(id_col: Column) -> Column:
    """Whether the CRC-32 of the id as text divides by five; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learnable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, text, lang) of the rows that models may be fitted on."""
    return docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def train_and_identify(docs: DataFrame, sample_docs: int = 2_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Fit on the rows that are not held out, then predict every row; adds ``held_out``."""
    found = identify(docs, fit(learnable(docs, id_col, text_col, lang_col), sample_docs), id_col, text_col, keep)
    return found.withColumn("held_out", held_out(F.col(id_col)))
