"""Removal of repeated byte strings by sorted, range-partitioned suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a smaller
document, or earlier in the same).  Comparing the suffixes at all positions would move many times
the input, so a sample of them is sorted that no string of that length can avoid: the anchor of
a string is the start of the smallest ``LEAD``-byte hash inside it (the leftmost one).  Equal
strings have the same anchor at the same offset, so only strings of equal anchor hash, the
suffixes' leading tokens, need to be compared.

1. Every anchor gives one row: the hash of its leading tokens, the hash of the stretch that all
   strings of this anchor cover, and its place.  Spark range-partitions the rows by sampled
   splitters over all of these columns, so that even a token that is in every document is
   split, and sorts each bucket.  A stretch whose row follows an equal one is repeated as a
   whole.  The first of its kind is checked further if its leading tokens have other stretches
   as well.  At a bucket's ends rows are not decided alone: one row per stretch and bucket goes on, and
   these meet across boundaries.
2. Of the stretches to be checked the bytes are fetched and all strings of a leading token are
   sorted together by their hashes (two of 64 bits); every string but the first of its kind is
   repeated.  Leading tokens with very many stretches are not gathered: their strings become rows that are
   combined before they are shuffled.
3. Ranges are joined and cut from the texts.

Texts are dealt by document once for steps 2 and 3, which share that exchange.

Defined results: a null text is empty.  A null id counts as smaller than every id.  Rows that
repeat an id are documents of their own, ordered by the hash of their text; rows that are equal
in both are one document and get the same answer.  Texts shorter than ``LENGTH`` bytes
lose nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.llm.shingles import mixed
from tonemill.llm.workers import map_batches
from tonemill.operators.joins import lookup_join
from tonemill.session import durable

#: Bytes of a string that counts, and of its leading tokens (a power of two).
LENGTH, LEAD = 100, 32
#: Stretches per leading token that are compared in one task; those with more become rows.
GATHERED = 2_000
#: Bytes that are hashed at once (places in them take less than 20 bits).
CHUNK = 1 << 17

_ODD = 0xD6E8FEB86659FD93


@cache
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@cache
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        row = np.full(size, b, np.uint64)
        row[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class RangeHash:
    """Hashes of any ranges of a byte string."""

    def __init__(self, data: np.ndarray, base: int = _ODD):
        size = 1 << max(12, (len(data) + 1).bit_length())
        power, self.inverse = _powers(size, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_byte_values()[data] * power[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _sliding(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text index, anchor, first string start, last end, lead hash, stretch hash) of every anchor, in order.

    Places count from the start of their text.  A very long text is worked on in pieces that
    overlap by less than a string; a stretch ends where a piece does.
    """
    pieces = [(i, at, t[at : at + CHUNK + LENGTH - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - LENGTH + 1), CHUNK)]
    pieces = [p for p in pieces if len(p[2]) >= LENGTH]
    parts: list[tuple[np.ndarray, ...]] = []
    start = size = 0
    for k, piece in enumerate(pieces):
        if size and size + len(piece[2]) > CHUNK:
            parts.append(_anchors(pieces[start:k]))
            start, size = k, 0
        size += len(piece[2])
    if pieces:
        parts.append(_anchors(pieces[start:]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _anchors(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    with np.errstate(over="ignore"):
        h, factor, step = _byte_values()[data], np.uint64(_ODD), 1
        while step < LEAD:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, step * 2
    h = mixed(h)
    # The least hash of every string, and the leftmost place that has it: 44 bits of hash, 20 of
    # place.  Strings that run over the end of a piece are left out, so it does not matter that
    # hashes there mix two pieces.
    ranked = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    least = _sliding(ranked, LENGTH - LEAD + 1, np.minimum)
    counts = sizes - LENGTH + 1
    starts = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    own = (least[starts] & np.uint64((1 << 20) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin, end, anchor = starts[first], starts[last] + LENGTH, own[first]
    stretch = RangeHash(data).of(begin, end)
    with np.errstate(over="ignore"):
        stretch = mixed(stretch ^ ((end - begin) * 128 + (anchor - begin)).astype(np.uint64))
    piece = np.searchsorted(ends, begin, side="right")
    move = np.array([p[1] for p in pieces])[piece] - begins[piece]
    return np.array([p[0] for p in pieces])[piece], anchor + move, begin + move, end + move, h[anchor], stretch


def _numbers(text: np.ndarray) -> np.ndarray:
    """The number of each anchor within its text."""
    new = np.ones(len(text), bool)
    new[1:] = text[1:] != text[:-1]
    at = np.flatnonzero(new)
    return np.arange(len(text)) - np.repeat(at, np.diff(np.append(at, len(text))))


def _bytes(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, u, id, t, nth) of every anchor of a table (id, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                text, _, _, _, h, u = anchors(_bytes(part, 2))
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [_signed(h), _signed(u), part.column(0).take(rows), part.column(1).take(rows), pa.array(_numbers(text).astype(np.int32))],
                    names=["h", "u", "id", "t", "nth"],
                )

    return map_batches(docs, run, "h long, u long, id long, t long, nth int")


#: What is known of an anchor: its stretch is repeated, it is to be checked, or it lies at a bucket's end.
REPEATED, CHECK, END = 0, 1, 2


def decide(rows: DataFrame) -> DataFrame:
    """(what, h, u, id, t, nth) of sorted buckets of anchor rows; rows that need nothing are left out.

    A row that follows one of the same stretch is repeated.  Leading tokens that touch an end of
    a batch or bucket may go on beyond it: the first row of each of their stretches is passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for batch in batches:
            h, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(h):
                continue
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            repeated = np.zeros(len(h), bool)
            repeated[1:] = same[1:] & (u[1:] == u[:-1])
            repeated[0] = before == (h[0], u[0])
            before = (h[-1], u[-1])
            group = np.cumsum(~same) - 1
            several = np.bincount(group[~repeated & same], minlength=group[-1] + 1) > 0
            end = ~repeated & ((group == 0) | (group == group[-1]))
            check = ~repeated & several[group]
            keep = pa.array(repeated | end | check)
            what = pa.array(np.where(repeated, REPEATED, np.where(end, END, CHECK)).astype(np.int32))
            # Only what later steps compare is carried on.
            h = pa.array(h, mask=repeated)
            u = pa.array(u, mask=~end)
            out = pa.RecordBatch.from_arrays([what, h, u, *batch.columns[2:]], names=["what", "h", "u", "id", "t", "nth"])
            yield out.filter(keep)

    return map_batches(rows, run, "what int, h long, u long, id long, t long, nth int")


def _across(decided: DataFrame) -> DataFrame:
    """Decide the rows at bucket ends: (what, h, id, t, nth)."""
    place = F.struct("id", "t", "nth")
    ends = decided.where(F.col("what") == END)
    firsts = ends.groupBy("h", "u").agg(F.min(place).alias("first"))
    kinds = firsts.groupBy("h").agg((F.count("*") > 1).alias("several"))
    met = ends.join(firsts, ["h", "u"]).join(kinds, "h")
    later = F.struct("id", "t", "nth") > F.col("first")
    what = F.when(later, F.lit(REPEATED)).when(F.col("several"), F.lit(CHECK))
    rows = met.select(what.alias("what"), "h", "id", "t", "nth").where("what is not null")
    return rows.union(decided.where(F.col("what") != END).select("what", "h", "id", "t", "nth"))


def _per_document(rows: DataFrame) -> DataFrame:
    """(id, t, repeated, gathered, spread): the numbers of a document's anchors by what is to be done."""
    crowded = rows.where(F.col("what") == CHECK).groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > GATHERED).select("h")
    marked = lookup_join(rows, crowded.withColumn("crowded", F.lit(True)), ["h"], "left", spread=["id", "nth"])
    chosen = lambda cond: F.collect_set(F.when(cond, F.col("nth")))
    check, many = F.col("what") == CHECK, F.col("crowded").isNotNull()
    return marked.groupBy("id", "t").agg(
        chosen(F.col("what") == REPEATED).alias("repeated"), chosen(check & ~many).alias("gathered"), chosen(check & many).alias("spread")
    )


def _stretches(batch: pa.RecordBatch, text: int, wanted: int) -> Iterator[tuple[int, bytes, np.ndarray, tuple[np.ndarray, ...]]]:
    """For each row with wanted anchors: (row, text, wanted numbers, its anchors)."""
    lists = batch.column(wanted).to_pylist()
    rows = [i for i, x in enumerate(lists) if x]
    texts = batch.column(text).cast(pa.binary()).take(pa.array(rows, pa.int64())).to_pylist()
    owner, *rest = anchors(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, i in enumerate(rows):
        own = slice(bounds[k], bounds[k + 1])
        yield i, texts[k], np.array(sorted(lists[i])), tuple(c[own] for c in rest)


def gathered_rows(docs: DataFrame) -> DataFrame:
    """(h, id, t, begin, lead, bytes): the stretches to be compared in one task; ``lead`` is the anchor's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                row, out = [], ([], [], [], [])
                for i, text, wanted, (anchor, begin, end, h, _) in _stretches(part, 2, 3):
                    row += [i] * len(wanted)
                    out[0].append(h[wanted].view(np.int64))
                    out[1].append(begin[wanted])
                    out[2].append((anchor - begin)[wanted])
                    out[3].extend(text[x:y] for x, y in zip(begin[wanted].tolist(), end[wanted].tolist(), strict=True))
                if row:
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out[0])), part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]).astype(np.int32)), pa.array(out[3], pa.binary())],
                        names=["h", "id", "t", "begin", "lead", "bytes"],
                    )

    return map_batches(docs, run, "h long, id long, t long, begin long, lead int, bytes binary")


def _strings(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(stretch, offset, hash, second hash) of all strings of stretches."""
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(parts)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(sizes) - sizes)[owner] + offset
    return owner, offset, RangeHash(data).of(at, at + LENGTH), RangeHash(data, 0x9E3779B97F4A7C15).of(at, at + LENGTH)


def compare_gathered(rows: DataFrame) -> DataFrame:
    """(id, t, start, end): repeated ranges of stretches sorted by (h, id, t, begin)."""

    def ranges(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, begin, lead = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
        owner, offset, one, two = _strings(batch.column(5).to_pylist())
        with np.errstate(over="ignore"):
            one = mixed(one ^ mixed(h.view(np.uint64)[owner] + (lead[owner] - offset).astype(np.uint64)))
        order = np.argsort(one, kind="stable")  # the rows come in order of place
        again = np.zeros(len(order), bool)
        again[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        repeated = np.zeros(len(order), bool)
        repeated[order] = again
        # Neighbouring repeated strings of a stretch make one range.
        who, start = owner[repeated], (begin[owner] + offset)[repeated]
        if not len(who):
            return pa.RecordBatch.from_arrays([batch.column(1).slice(0, 0), batch.column(2).slice(0, 0), pa.array(who), pa.array(who)], names=["id", "t", "start", "end"])
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(who)) - 1
        names = pa.array(who[first])
        return pa.RecordBatch.from_arrays([batch.column(1).take(names), batch.column(2).take(names), pa.array(start[first]), pa.array(start[last] + LENGTH)], names=["id", "t", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last token, at most GATHERED rows
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            h = batch.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            held = batch.slice(cut)
            for a, b in _whole_tokens(h[:cut], 8192):
                yield ranges(batch.slice(a, b - a))
        if held is not None:
            yield ranges(held)

    return map_batches(rows, run, "id long, t long, start long, end long")


def _whole_tokens(h: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` rows that do not part equal tokens."""
    at = 0
    while at < len(h):
        upto = min(len(h), at + most)
        if upto < len(h):
            upto = int(np.searchsorted(h, h[upto - 1], side="right"))
        yield at, upto
        at = upto


def spread_rows(docs: DataFrame) -> DataFrame:
    """(one, two, id, t, start): the strings of stretches whose leading token has very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, wanted, (_, begin, end, _, _) in _stretches(batch, 2, 3):
                for a in range(0, len(wanted), 4096):
                    some = wanted[a : a + 4096]
                    owner, offset, one, two = _strings([text[x:y] for x, y in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
                    row = pa.array(np.full(len(owner), i))
                    yield pa.RecordBatch.from_arrays(
                        [_signed(one), _signed(two), batch.column(0).take(row), batch.column(1).take(row), pa.array(begin[some][owner] + offset)],
                        names=["one", "two", "id", "t", "start"],
                    )

    return map_batches(docs, run, "one long, two long, id long, t long, start long")


def compare_spread(rows: DataFrame) -> DataFrame:
    """(id, t, start, end): strings that are not the first of their kind."""
    firsts = rows.groupBy("one", "two").agg(F.min(F.struct("id", "t", "start")).alias("first"), F.count("*").alias("k")).where("k > 1")
    again = rows.join(firsts.drop("k"), ["one", "two"]).where(F.struct("id", "t", "start") > F.col("first"))
    return again.select("id", "t", "start", (F.col("start") + LENGTH).alias("end"))


def cut_texts(docs: DataFrame) -> DataFrame:
    """(id, n_bytes, spans, kept) from (id, t, text, repeated, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts, found = _bytes(part, 2), [[(r["start"], r["end"]) for r in x or []] for x in part.column(4).to_pylist()]
                for i, _, wanted, (_, begin, end, _, _) in _stretches(part, 2, 3):
                    found[i] += list(zip(begin[wanted].tolist(), end[wanted].tolist(), strict=True))
                spans, kept = [], []
                for text, ranges in zip(texts, found, strict=True):
                    runs = _union(ranges)
                    spans.append([{"start": x, "end": y} for x, y in runs])
                    edges = [0, *[e for r in runs for e in r], len(text)]
                    kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"]
                )

    return map_batches(docs, run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) for every row: the removed ranges of bytes, and the bytes that stay."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Only ids that repeat are told apart by the hash of the text.
    twice = rows.groupBy("id").count().where("count > 1").limit(1).count() > 0
    tie: Column = F.xxhash64("text") if twice else F.lit(0).cast("long")
    # Order and equality treat null ids as the smallest number.
    rows = rows.select(F.coalesce("id", F.lit(-(2**63))).alias("id"), tie.alias("t"), "text")

    # Rows that are equal are looked at once, and all get the answer.
    single = rows.dropDuplicates(["id", "t"]) if twice else rows
    order = ["h", "u", "id", "t", "nth"]
    buckets = anchor_rows(single.select("id", "t", "text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    decided = durable(decide(buckets), "suffix-decided")
    status = durable(_per_document(_across(decided)), "suffix-status")

    dealt = single.select("id", "t", "text").repartition(parts, "id", "t")
    known = dealt.join(status, ["id", "t"], "left")
    gathered = gathered_rows(known.where(F.size("gathered") > 0).select("id", "t", "text", "gathered"))
    gathered = compare_gathered(gathered.repartition(parts, "h").sortWithinPartitions("h", "id", "t", "begin"))
    spread = spread_rows(known.where(F.size("spread") > 0).select("id", "t", "text", "spread"))
    ranges = gathered.union(compare_spread(spread))
    ranges = ranges.groupBy("id", "t").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    every = rows.select("id", "t", "text").repartition(parts, "id", "t").join(status, ["id", "t"], "left") if twice else known
    cut = cut_texts(every.join(ranges, ["id", "t"], "left").select("id", "t", "text", "repeated", "ranges"))
    return cut.select(F.when(F.col("id") != -(2**63), F.col("id")).alias(id_col), "n_bytes", "spans", "kept")
