"""Sets of hashed word shingles of whole texts, made for a batch of texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np

#: The characters between words, and the words of a shingle.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORDS = 5
#: Bytes that are hashed at once; a longer text is hashed in one piece with a longer table.
CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A random value per byte, equal for A-Z and a-z, and which bytes are spaces."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    spaces = np.zeros(256, bool)
    spaces[list(SPACES)] = True
    return values, spaces


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64th."""
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        row = np.full(size, b, np.uint64)
        row[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, in order, and how many words each text has."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    values, spaces = _byte_values()
    gap = spaces[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    if len(starts) > len(ends):
        ends = np.append(ends, len(data))
    size = 1 << max(CHUNK.bit_length(), len(data).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * inverse[starts]
    hashes = mixed(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted.

    A text with fewer words than a shingle has its whole sequence as one, one without words none.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < CHUNK):
            size += len(texts[upto]) + 1
            upto += 1
        out += _sets(texts[at:upto])
        at = upto
    return out


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    words, counts = word_hashes(texts)
    factors = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - WORDS + 1)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for k in range(WORDS):
            rolled += words[k : k + n] * factors[k]
    rolled = mixed(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= WORDS:
            out.append(np.unique(rolled[at : at + count - WORDS + 1]))
        elif count:
            with np.errstate(over="ignore"):
                whole = (words[at : at + count] * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
