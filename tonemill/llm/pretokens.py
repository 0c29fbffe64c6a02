"""Cutting whole texts into the pieces that byte-level BPE works on, and remembering pieces.

The pieces are the matches of ``public_tokenizers.PATTERN``.  Since each of its alternatives is
a run of one character class, with at most a space before it, the piece starts follow from
comparing neighbouring characters; they are found for a whole batch of texts at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Pieces that one worker remembers from batch to batch, in each of two generations.
REMEMBERED = 100_000
#: Characters of text that are worked on at once (a longer text makes a batch of its own).
BATCH_CHARS = 1_000_000


@cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    text = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, text):
            kinds[points[run.start()] : points[run.end() - 1] + 1] = kind
    return kinds


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in texts laid end to end; ``ends`` are the ends of the texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = character_classes()[points]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    last = first[1:].copy()  # the last character of a text
    first = first[:-1]
    last[-1] = True
    changes = np.ones(n, bool)
    changes[1:] = kind[1:] != kind[:-1]
    changes |= first
    space = kind == SPACE
    starts = changes.copy()
    # A run of spaces that something follows gives up its last character: a blank to the piece
    # that follows, any other as a piece of its own.
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = space[:-1] & changes[1:] & ~last[:-1]
    starts |= ends_run
    lent = ends_run & (points == 32)
    starts[1:] &= ~(lent[:-1] & ~first[1:])
    # 's 't 'm 'd 're 've 'll are pieces where a piece starts at the apostrophe.
    for at in np.flatnonzero(starts & (points == 39)):
        stop = ends[np.searchsorted(ends, at, side="right")]
        tail = points[at + 1 : min(at + 3, stop)].tobytes().decode("utf-32-le")
        length = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
        if length:
            starts[at + 1 : at + length] = False
            if at + length < stop:
                starts[at + length] = True
                if at + length + 1 < stop and _lends(points, kind, at + length, stop):
                    starts[at + length + 1] = False
    return np.flatnonzero(starts)


def _lends(points: np.ndarray, kind: np.ndarray, at: int, stop: int) -> bool:
    """Whether the character is a single blank that belongs to the piece that follows."""
    return points[at] == 32 and kind[at + 1] != SPACE


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts, in order, and how many each text has."""
    joined = "".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    # Empty texts at the end or between others share the end of their neighbour.
    bounds = np.unique(ends[ends > 0]) if len(ends) else ends
    starts = piece_starts(points, bounds)
    stops = np.append(starts[1:], len(points))[: len(starts)]
    found = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    upto = np.searchsorted(starts, ends, side="left")
    return found, np.diff(upto, prepend=0)


class Memory:
    """Values of pieces, kept in two generations so that the size is bounded and common pieces stay."""

    def __init__(self, size: int = REMEMBERED):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, wanted: set[str], make) -> dict[str, bytes]:
        """The value of every wanted piece; ``make`` gives those of a list of unknown ones."""
        young, old = self.young, self.old
        found, unknown = {}, []
        for piece in wanted:
            value = young.get(piece)
            if value is None:
                value = old.get(piece)
                if value is None:
                    unknown.append(piece)
                    continue
                young[piece] = value
            found[piece] = value
        if unknown:
            unknown.sort()
            for piece, value in zip(unknown, make(unknown), strict=True):
                found[piece] = value
                if len(piece) <= 64:
                    young[piece] = value
        if len(young) > self.size:
            self.old, self.young = young, {}
        return found


def encode_texts(texts: list[str], memory: Memory, make) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the texts laid end to end, and how many each text has.

    ``make`` gives the ids of unknown pieces as little-endian 32-bit integers.
    """
    found, counts = pieces(texts)
    value = memory.values(set(found), make).__getitem__
    blobs, at = [], 0
    for n in counts.tolist():
        blobs.append(b"".join(map(value, found[at : at + n])))
        at += n
    lengths = np.array([len(b) >> 2 for b in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), np.int32), lengths


def encode_in_order(texts: list[str], memory: Memory, make) -> tuple[np.ndarray, np.ndarray]:
    """What ``encode_texts`` gives, where most pieces are young ones of the memory: these are looked up once, where they
    stand, and only the others are gathered."""
    found, counts = pieces(texts)
    values = list(map(memory.young.get, found))
    if None in values:
        gaps = [i for i, value in enumerate(values) if value is None]
        known = memory.values({found[i] for i in gaps}, make)
        for i in gaps:
            values[i] = known[found[i]]
    blobs, at = [], 0
    for n in counts.tolist():
        blobs.append(b"".join(values[at : at + n]))
        at += n
    lengths = np.array([len(b) >> 2 for b in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), np.int32), lengths


def in_groups(texts: list[str], most: int = BATCH_CHARS):
    """Ranges of texts with a bounded number of characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
