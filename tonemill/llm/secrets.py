"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Base spans come from three patterns.  Beside them, candidate strings are maximal runs of one
character class; a window of the class's length slides over each, its symbol counts and the sum
of ``c log2 c`` are kept up to date by the character that enters and the one that leaves, and
windows whose entropy reaches the class's threshold are joined to spans.  Shorter windows and those of
only two kinds of characters count unless they are ordinary words and numbers.  Runs that the allow
list knows (identifiers in the usual notations, placeholders, alphabets, addresses) and spans inside a base
span are left out; base spans always stay.

Every row is worked on by itself in Arrow batches, whole texts only; nothing is shuffled.

Defined results: a null or empty text has no spans.  Null or repeated ids and repeated rows are
answered one by one.  Positions are code points, ends exclusive.  An empty table gives an empty
result.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill.llm.workers import map_batches

# The base patterns and their least lengths, and the order of kinds.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "entropy"]

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
# A run of hex digits that is too short fails whatever follows it, so only long ones are looked for.
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])


@dataclass(frozen=True)
class CharacterClass:
    """Candidate strings of one class: the window and the bits per character that make it suspect.

    A suspect window must hold so many digits, upper and lower case letters, and so many of these three kinds.
    With ``words`` set, strings of ordinary words and numbers are no candidates either.
    """

    name: str
    run: str
    window: int
    bits: float
    digits: int = 0
    upper: int = 0
    lower: int = 0
    kinds: int = 0
    words: bool = False


CLASSES = (
    CharacterClass("base64", r"[A-Za-z0-9+/_=-]", 24, 3.9, digits=1, upper=1, lower=1),
    CharacterClass("upper", r"[A-Z0-9]", 20, 3.5, digits=2, upper=1),
    CharacterClass("hex", r"[0-9A-F]", 24, 3.2, digits=3, upper=1),
    CharacterClass("two kinds", r"[A-Za-z0-9+/_=-]", 24, 3.9, kinds=2, words=True),
    CharacterClass("short", r"[A-Za-z0-9+/_=-]", 16, 3.3, kinds=2, words=True),
    CharacterClass("lower", r"[a-z0-9]", 16, 3.0, digits=1, lower=1, words=True),
)

#: Between separators: words, also in camel case, with a number before or after; numbers; very short parts.
WORD = re.compile(r"[0-9]{0,4}(?:[a-z]*(?:[A-Z][a-z]{2,}|[A-Z]{2,5}[a-z]{3,}|By|Id|In|Is|Of|On|To)*|[A-Z]+)[0-9]{0,8}|[0-9]+|[A-Za-z0-9]{1,3}")
_BETWEEN = re.compile(r"[+/_=.-]+")

#: Characters that a candidate string may go on with, and whole strings of them that are no secrets.
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]+")
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i).*(example|placeholder|changeme|your[-_]?(key|token|secret)|dummy|redacted).*",
    r"(?i).*(abcdefghijkl|0123456789|zyxwvuts|qwertyuiop).*",
    r"(/[A-Za-z_][A-Za-z0-9_.-]*){2,}/?",
    r"(sha(1|256|512)[-=]).*",
)


def hot_windows(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined ranges of the windows whose Shannon entropy is ``bits`` or more.

    ``h = log2 n - (sum of c log2 c) / n``; a step changes the counts of two symbols.
    """
    if len(text) < window:
        return []
    clog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = (math.log2(window) - bits) * window + 1e-9  # the largest sum that is still suspect
    counts: dict[str, int] = {}
    total = 0.0
    found: list[tuple[int, int]] = []
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += clog[c + 1] - clog[c] if c < window else 0.0
        if i >= window:
            left = text[i - window]
            c = counts[left]
            counts[left] = c - 1
            total += clog[c - 1] - (clog[c] if c <= window else clog[window])
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if found and found[-1][1] >= start:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def ordinary(token: str) -> bool:
    """Whether all parts of a token are words or numbers."""
    return all(WORD.fullmatch(part) for part in _BETWEEN.split(token) if part)


class Tokens:
    """The tokens of a text, each judged once however many candidate strings it holds."""

    def __init__(self, text: str, allow: re.Pattern):
        self.text, self.allow = text, allow
        self.bounds = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.bounds]
        self.allowed: dict[int, bool] = {}
        self.plain: dict[int, bool] = {}

    def known(self, start: int, words: bool) -> bool:
        """Whether the allow list has the token around the position, or it is ordinary words."""
        number = bisect.bisect_right(self.starts, start) - 1
        a, b = self.bounds[number]
        if number not in self.allowed:
            self.allowed[number] = bool(self.allow.fullmatch(self.text, a, b))
        if words and not self.allowed[number] and number not in self.plain:
            self.plain[number] = ordinary(self.text[a:b])
        return self.allowed[number] or words and self.plain[number]


class Scanner:
    """Finds the spans of a text: (kind, start, end), sorted by start, then kind.

    The time grows with the length of the text, whatever it is made of: runs are counted once for all
    windows, tokens are judged once, and base spans are looked up in their order.
    """

    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = [(c, re.compile(f"{c.run}{{{c.window},}}"), _needs(c)) for c in classes]
        self.allow = re.compile("|".join(f"(?:{a})" for a in self._hoisted(allow)), re.DOTALL)

    @staticmethod
    def _hoisted(allow: tuple[str, ...]) -> list[str]:
        """Flags inside an alternative must be local to it."""
        return [f"(?i:{a[4:]})" if a.startswith("(?i)") else a for a in allow]

    def base(self, text: str) -> list[tuple[str, int, int]]:
        spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
        return spans

    def suspects(self, text: str) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        tokens = Tokens(text, self.allow)
        hot: dict[tuple[int, int, int, float], list[tuple[int, int]]] = {}  # classes may share runs and windows
        for kind, run, needs in self.classes:
            for m in run.finditer(text):
                start, end = m.span()
                if not _holds(text, start, end, needs, kind.kinds) or tokens.known(start, kind.words):
                    continue
                key = (start, end, kind.window, kind.bits)
                if key not in hot:
                    hot[key] = hot_windows(m.group(), kind.window, kind.bits)
                for a, b in hot[key]:
                    if _holds(text, start + a, start + b, needs, kind.kinds) and not (kind.words and ordinary(text[start + a : start + b])):
                        found.append((start + a, start + b))
        joined: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        return joined

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        spans = self.base(text)
        held = sorted((a, b) for _, a, b in spans)
        starts = [a for a, _ in held]
        reach = list(itertools.accumulate((b for _, b in held), max))  # how far any span begun by then goes
        for a, b in self.suspects(text):
            before = bisect.bisect_right(starts, a)
            if not before or reach[before - 1] < b:
                spans.append(("entropy", a, b))
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


_KINDS = {"digits": "[0-9]", "upper": "[A-Z]", "lower": "[a-z]"}
_ANY = {name: re.compile(one) for name, one in _KINDS.items()}


def _needs(kind: CharacterClass) -> list[re.Pattern]:
    """Patterns that find so many characters of each kind; none of them reads a character twice."""
    wanted = [(one, getattr(kind, name)) for name, one in _KINDS.items() if getattr(kind, name)]
    return [re.compile(f"[^{one[1:-1]}]*".join([one] * count)) for one, count in wanted]


def _holds(string: str, a: int, b: int, needs: list[re.Pattern], kinds: int) -> bool:
    return all(n.search(string, a, b) for n in needs) and (not kinds or sum(k.search(string, a, b) is not None for k in _ANY.values()) >= kinds)


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def redact_text(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """The text with every span, overlapping ones as one, replaced by the mask."""
    parts, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scanner.scan(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=schema.names)

    return map_batches(rows, run, schema)


def redact_secrets(docs: DataFrame, mask: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced by the mask; null texts stay null."""
    place = docs.columns.index(text_col)
    schema = docs.withColumn(text_col, F.col(text_col).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = [redact_text(t, scanner.scan(t), mask) if t else t for t in batch.column(place).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(docs, run, schema)


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
