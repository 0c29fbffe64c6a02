"""Text functions as native column expressions.

Functions that look at the same array more than once expect a column that is
already materialised by an earlier ``select``; tokenising inside a lambda would
repeat the work for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The English stop words of the tokenizer.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with"
).split()

# Characters deleted before a text is analysed.
NOISE = "-+^:"
# What may not stay in a word that is looked up in the lexicon.
NON_LOOKUP = r"[^a-zA-Z\s]"
SENTENCE_END = r"[.!?\n]+"
NON_LETTERS = r"[^\p{L}]+"

# An acronym with dots, a word with inner apostrophes, or a run of letters and digits.
# Possessive quantifiers keep the matcher iterative on very long runs; a plain word that
# no digit follows is settled by the second branch without being read again.
WORD = (
    r"\p{L}\.(?:\p{L}\.)++"
    r"|\p{L}++(?:(?:['’]\p{L}++)++|(?!\p{N}))"
    r"|[\p{L}\p{N}]++"
)


def strip_noise(text: Column) -> Column:
    return F.translate(text, NOISE, "")


def lookup_key(word: Column) -> Column:
    """The form both sides of the lexicon join agree on: ASCII letters, lower case."""
    return F.lower(F.regexp_replace(word, NON_LOOKUP, ""))


def non_blank(items: Column) -> Column:
    return F.filter(items, lambda x: F.trim(x) != "")


def sentences(text: Column) -> Column:
    return non_blank(F.split(strip_noise(text), SENTENCE_END))


def letter_words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(text), NON_LETTERS), lambda x: x != "")


def lookup_words(text: Column) -> Column:
    """Words of a text in lexicon form.

    Letters outside ASCII are deleted from the whole text first; what then stands
    between ASCII letters is no letter, so one split gives the same words as
    cleaning them one by one.  A blank entry can stand at either end.
    """
    return F.split(F.regexp_replace(F.lower(text), r"[\p{L}&&[^a-z]]+", ""), "[^a-z]+")


def _clean_word(word: Column) -> Column:
    apostrophe = word.contains("'") | word.contains("’")
    owner = F.when(apostrophe, F.regexp_replace(word, "['’][sS]$", "")).otherwise(word)
    return F.lower(F.when(owner.contains("."), F.replace(owner, F.lit("."), F.lit(""))).otherwise(owner))


def words(text: Column) -> Column:
    """Lower-case words: acronym dots and a final possessive ``'s`` are removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _clean_word)


def is_stop(term: Column) -> Column:
    """A listed English word or one printable ASCII character."""
    return term.isin(STOP_WORDS) | term.rlike("^[ -~]$")


def drop_stops(terms: Column) -> Column:
    return F.filter(terms, lambda x: ~is_stop(x))


def _from(items: Column, start: int) -> Column:
    return F.slice(items, F.lit(start), F.greatest(F.size(items) - (start - 1), F.lit(0)))


def word_pairs(items: Column) -> Column:
    """Neighbouring words joined by one space."""
    joined = F.zip_with(items, _from(items, 2), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(joined, lambda x: x.isNotNull())


def word_triples(items: Column) -> Column:
    two = F.zip_with(items, _from(items, 2), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(two, _from(items, 3), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(three, lambda x: x.isNotNull())


def shingles(items: Column) -> Column:
    """Single words and pairs; stop words go only as single words."""
    return drop_stops(F.concat(items, word_pairs(items)))


def word_ngrams(items: Column) -> Column:
    """Runs of one, two and three words."""
    return F.concat(items, word_pairs(items), word_triples(items))


def char_windows(text: Column, low: int, high: int) -> Column:
    """At each character the run of up to ``high`` characters, if it has at least ``low``.

    Each match takes one character and captures the run that starts there, so a
    long text is read once; cutting by position would count from the start each time.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{low},{high}}}))."), F.lit(1))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """Character runs of ``low`` to ``high`` characters, spaces included."""
    parts = [char_windows(text, n, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def prefixes(window: Column, low: int, high: int) -> Column:
    """The starts of a window with ``low`` to ``high`` characters."""
    cut = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.substring(window, F.lit(1), n))
    return F.slice(cut, 1, F.greatest(F.length(window) - (low - 1), F.lit(0)))


def distinct_terms(items: Column) -> Column:
    return F.array_distinct(items)


def truncate(text: Column, length: int, suffix: str) -> Column:
    """Cut to ``length`` characters and add the suffix; blank or short texts stay."""
    cut = F.concat(F.substring(text, 1, length), F.lit(suffix))
    return F.when((F.trim(text) != "") & (F.length(text) > length), cut).otherwise(text)


def elapsed(millis: Column) -> Column:
    minutes = F.floor(millis / 60000)
    rest = millis - minutes * 60000
    seconds = F.floor(rest / 1000)
    return F.concat(
        minutes.cast("string"), F.lit(" min "), seconds.cast("string"), F.lit(" sec "),
        (rest - seconds * 1000).cast("string"), F.lit(" ms"),
    )


# What stands for each character when a text is shown in a page, and the frame.
ESCAPES = (("<", "&lt;"), (">", "&gt;"), ("\n", "<br />"), (" ", "&nbsp;"))
PAGE_HEAD = '<html><body><pre id="content">'
PAGE_TAIL = "</pre></body></html>"


def escape_markup(text: Column) -> Column:
    """A trimmed text as one preformatted page; the blank inside ``<br />`` is escaped too, as blanks go last."""
    body = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    for char, entity in ESCAPES:
        body = F.replace(body, F.lit(char), F.lit(entity))
    return F.concat(F.lit(PAGE_HEAD), body, F.lit(PAGE_TAIL))


def clean_name(name: Column) -> Column:
    return F.translate(name, "/\\:", "___")


def unnest(df: DataFrame, items: Column, keep: list[str], name: str, position: str | None = None) -> DataFrame:
    """One row per array item.

    A plain explode makes the optimizer test the array for emptiness in a filter of
    its own, which computes a costly array several times over; the outer form with
    the empty rows dropped afterwards computes it once.
    """
    if position is None:
        rows = df.select(*keep, F.explode_outer(items).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    return rows.filter(F.col(name).isNotNull())
