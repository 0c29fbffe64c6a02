"""Character runs counted and summed up by text, without a row per run.

Neighbouring runs share all their characters but one, so they are shuffled as the fragments of text they come from.
A run goes to the bucket of its least group of a few characters by hash, which neighbours mostly have in common: about two and a
half runs travel as one fragment of ten characters, and all equal runs meet in one bucket.  There the fragments are cut
into runs again, a bounded number at a time, and equal runs are compared by all of their characters.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The worker functions travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a group whose hash chooses the bucket.
GROUP = 5
BUCKETS = 2048
#: Characters and texts that are cut into fragments at a time; a text is numbered by two bytes.
CHUNK_CHARS, CHUNK_TEXTS = 4_000_000, 65_000
#: Runs that are compared at a time, and those that are cut at a time.
SLICE_RUNS, BLOCK_RUNS = 3_000_000, 500_000
#: Runs of one fragment at most; their number takes a byte.
FRAGMENT = 255
#: Partitions for each core: sums of a text leave every partition, so more of them move more sums.
PARTS_PER_CORE = 4
PIECES = "_part int, _bucket int, _chunk long, _piece binary"
HEAD = "<III"
TABLE, TABLE_FIRST = -1, -2

Batches = Iterator[pa.RecordBatch]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 32 bits in an order that looks random."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the run that starts at each character."""
    group = min(GROUP, order)
    hashed = codes[: len(codes) - group + 1].copy()
    for j in range(1, group):
        hashed *= np.uint32(0x9E3779B1)
        hashed += codes[j : len(codes) - group + 1 + j]
    least, width = _mixed(hashed), 1
    while width < order - group + 1:
        step = min(width, order - group + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    # The least of several hashes is small as a rule, so it is mixed again.
    return (_mixed(least + np.uint32(0x51ED27)) % np.uint32(BUCKETS)).astype(np.uint16)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _fragments(texts: list[str], order: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, piece): the fragments of some texts that go to one bucket, with the number of each one's text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    runs = np.maximum(sizes - order + 1, 0)
    if not runs.sum():
        return
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = _ranges(np.cumsum(sizes) - sizes, runs)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), runs)
    bucket = _buckets(codes, order)[at]
    cut = at % FRAGMENT == 0
    cut[0] = True
    cut[1:] |= (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(cut)
    n = np.diff(np.append(first, len(at)))
    dealt = np.argsort(bucket[first], kind="stable")
    first, n = first[dealt], n[dealt]
    bucket, text, start = bucket[first], text[first], at[first]
    chars = codes[_ranges(start, n + order - 1)]
    char_ends = np.concatenate([[0], np.cumsum(n + order - 1)])
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        steps = np.diff(text[lo:hi], prepend=0)
        body = b"".join([
            n[lo:hi].astype(np.uint8).tobytes(), (steps & 255).astype(np.uint8).tobytes(), (steps >> 8).astype(np.uint8).tobytes(),
            chars[char_ends[lo] : char_ends[hi]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"),
        ])
        yield int(bucket[lo]), struct.pack(HEAD, hi - lo, int(n[lo:hi].sum()), len(body)) + pa.compress(body, "zstd", asbytes=True)


def _opened(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs, text, codes) of the fragments of a piece."""
    count, _, size = struct.unpack_from(HEAD, piece)
    body = pa.decompress(memoryview(piece)[struct.calcsize(HEAD) :], size, "zstd", asbytes=True)
    n, low, high = np.frombuffer(body, dtype=np.uint8, count=3 * count).reshape(3, count).astype(np.int64)
    codes = np.frombuffer(body[3 * count :].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return n, np.cumsum(low | high << 8), codes


def _cut(order: int, shown: list[str], parts: int) -> Callable[[Batches], Batches]:
    """Rows (shown..., _no, _text) to pieces; every partition also gets the rows of a chunk without their texts."""

    def pieces(rows: pa.Table, texts: list[str], chunk: int) -> Batches:
        none = pa.array([len(t) < order for t in texts], pa.bool_())
        table = rows.select([*shown, "_no"]).append_column("_none", none).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        stored = sink.getvalue().to_pybytes()
        own = chunk % parts
        found = [(p, TABLE_FIRST if p == own else TABLE, chunk, stored) for p in range(parts)]
        yield _batch(found)
        found = []
        for bucket, piece in _fragments(texts, order):
            found.append((bucket % parts, bucket, chunk, piece))
            if len(found) == 256:
                yield _batch(found)
                found = []
        if found:
            yield _batch(found)

    def run(batches: Batches) -> Batches:
        task = TaskContext.get().partitionId() << 32
        held, texts, size = [], [], 0
        for batch in batches:
            of = [(b or b"").decode("utf-8", "replace") for b in batch.column("_text").cast(pa.binary()).to_pylist()]
            lo = 0
            for hi, text in enumerate(of, 1):
                texts.append(text)
                size += len(text)
                if size >= CHUNK_CHARS or len(texts) == CHUNK_TEXTS:
                    held.append(batch.slice(lo, hi - lo))
                    yield from pieces(pa.Table.from_batches(held), texts, task)
                    held, texts, size, lo, task = [], [], 0, hi, task + 1
            if lo < len(of):
                held.append(batch.slice(lo))
        if texts:
            yield from pieces(pa.Table.from_batches(held), texts, task)

    return run


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    part, bucket, chunk, piece = zip(*rows, strict=True)
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(piece, pa.binary())], ["_part", "_bucket", "_chunk", "_piece"])


def _packed(codes: np.ndarray, length: int, bits: int) -> np.ndarray:
    """At each character the number made of ``length`` characters of ``bits`` bits from there on."""
    if length == 1:
        return codes
    half = length // 2
    one = _packed(codes, half, bits)
    both = one[:-half] << np.uint64(half * bits) | one[half:]
    return both if length % 2 == 0 else both[:-1] << np.uint64(bits) | codes[length - 1 :]


def _names(words: list[np.ndarray]) -> np.ndarray:
    """One number for each row of several numbers, the same for equal rows only."""
    name = words[0]
    for word in words[1:]:
        left, right = np.unique(name, return_inverse=True)[1], np.unique(word, return_inverse=True)[1]
        name = left.astype(np.uint64) * np.uint64(right.max(initial=0) + 1) + right.astype(np.uint64)
    return name


def _slices(pieces: list[tuple[int, bytes]], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(name, text) of all runs of a bucket, equal runs in one slice and under one name; ``pieces`` are (first text, piece)."""
    slices = -(-sum(struct.unpack_from(HEAD, p)[1] for _, p in pieces) // SLICE_RUNS)
    kept = [(first, _opened(p)) for first, p in pieces] if slices == 1 else None
    opened = lambda: kept if kept is not None else ((first, _opened(p)) for first, p in pieces)
    met = np.zeros(0x110000, dtype=bool)
    for _, (_, _, codes) in opened():
        met[codes] = True
    rank = (np.cumsum(met) - 1).astype(np.uint64)
    bits = max(1, int(rank[-1]).bit_length())
    each = min(order, 64 // bits)

    def blocks() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        held, size = [], 0
        for first, (n, text, codes) in opened():
            held.append((n, text + first, codes))
            size += int(n.sum())
            if size >= BLOCK_RUNS:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)

    def cut(held: list) -> tuple[list[np.ndarray], np.ndarray]:
        n, text, codes = (np.concatenate(x) for x in zip(*held, strict=True))
        at = _ranges(np.cumsum(n + order - 1) - (n + order - 1), n)
        ranks = rank[codes]
        words = [_packed(ranks, min(each, order - j), bits)[at + j] for j in range(0, order, each)]
        return words, np.repeat(text, n).astype(np.int32)

    for s in range(slices):
        found, texts = [], []
        for words, text in blocks():
            if slices > 1:
                spread = sum(words[1:], words[0]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                mine = spread % np.uint64(slices) == s
                words, text = [w[mine] for w in words], text[mine]
            found.append(words)
            texts.append(text)
        yield _names([np.concatenate(w) for w in zip(*found, strict=True)]), np.concatenate(texts)


def _sums(order: int, shown: list[str], classes: int, alpha: float) -> Callable[[Batches], Batches]:
    """Pieces in the order of their buckets to rows (shown..., _n, _new, _g0...): what the runs of a partition add to a text."""

    def run(batches: Batches) -> Batches:
        tables, firsts, labels = [], {}, []
        n_texts, sums, label = 0, None, None
        bucket, pieces = None, []

        def add() -> None:
            for name, text in _slices(pieces, order):
                by_name = np.argsort(name)
                name, text_of = name[by_name], text[by_name]
                new = np.ones(len(name), dtype=bool)
                new[1:] = name[1:] != name[:-1]
                group = np.cumsum(new) - 1
                counts = np.bincount(group * (classes + 1) + label[text_of] + 1, minlength=(group[-1] + 1) * (classes + 1) if len(group) else 0)
                counts = counts.reshape(-1, classes + 1)[:, 1:]
                sums[0] += np.bincount(text_of, minlength=n_texts)
                sums[1] += np.bincount(text_of[new], weights=counts.any(axis=1), minlength=n_texts)
                for i in range(classes):
                    gain = np.log(counts[:, i] + alpha) - np.log(alpha)
                    sums[2 + i] += np.bincount(text_of, weights=gain[group], minlength=n_texts)

        for batch in batches:
            for to, chunk, piece in zip(*(batch.column(c).to_pylist() for c in ("_bucket", "_chunk", "_piece")), strict=True):
                if to < 0:
                    table = pa.ipc.open_stream(piece).read_all()
                    firsts[chunk] = n_texts
                    tables.append((table, to == TABLE_FIRST))
                    labels.append(table.column("_no").to_numpy())
                    n_texts += len(table)
                    continue
                if sums is None:
                    sums, label = np.zeros((2 + classes, n_texts)), np.concatenate(labels)
                if to != bucket and pieces:
                    add()
                    pieces = []
                bucket = to
                pieces.append((firsts[chunk], piece))
        if pieces:
            add()
        if sums is None:
            sums = np.zeros((2 + classes, n_texts))
        first = 0
        for table, own in tables:
            mine = sums[:, first : first + len(table)]
            first += len(table)
            met = mine[0] > 0
            if own:
                # The row of a text without a run leaves one partition only.
                met |= table.column("_none").to_numpy(zero_copy_only=False)
            if not met.any():
                continue
            made = table.select(shown).filter(pa.array(met))
            columns = [pa.array(mine[i][met].astype(np.int64)) for i in (0, 1)] + [pa.array(mine[2 + i][met]) for i in range(classes)]
            names = ["_n", "_new", *[f"_g{i}" for i in range(classes)]]
            yield from pa.Table.from_arrays([*made.columns, *columns], names=[*shown, *names]).to_batches()

    return run


def run_sums(rows: DataFrame, shown: list[str], order: int, classes: int, alpha: float) -> DataFrame:
    """(shown..., _n, _new, _g0...) of rows (shown..., _no, _text): partial sums by text of the runs of ``order`` characters.

    ``_no`` is the number of the row's class or -1.  ``_n`` are the runs, ``_g`` what each adds to a class, ``log((count + alpha) / alpha)``
    with its count in all texts of that class; ``_new`` has each different run that a class knows once, at one of its texts.
    """
    spark = rows.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_CORE * spark.sparkContext.defaultParallelism))
    pieces = rows.select(*shown, "_no", "_text").mapInArrow(_cut(order, shown, parts), PIECES)
    dealt = pieces.repartitionById(parts, "_part").sortWithinPartitions("_bucket")
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.select(*shown).schema.fields]
    fields += [T.StructField(n, T.LongType(), True) for n in ("_n", "_new")]
    fields += [T.StructField(f"_g{i}", T.DoubleType(), True) for i in range(classes)]
    return dealt.mapInArrow(_sums(order, shown, classes, alpha), T.StructType(fields))
