"""Token files: patched frame-of-reference blocks with an index of block starts.

Layout of a file, all integers little-endian::

    "TNPF" | blocks | starts: 8 bytes per block | ids per document: 8 bytes each |
    document ids: 8 bytes each | null flags: 1 byte each | blocks, documents, ids, BLOCK: 8 bytes each | "TNPF"

    block: count 4, minimum 4, width 1, exceptions 4 | count x width bits | positions 4 each | high parts 4 each

A block holds ``BLOCK`` ids (the last one of a file fewer).  Their minimum is subtracted; the
width is that of a high percentile of the differences; what is above the width goes to the
exception list.  Documents run on through the blocks.

Documents are dealt out by ranges of the id, so the files, in the order of their numbers, hold
them in ascending order.  A file's name is new for every attempt of a task, and only files named
in the committed manifest are read: lost tasks leave nothing that counts.

Defined results: a null text is an empty one and has the end id alone.  Null ids come first;
rows of equal id are ordered by their text.  Repeated rows are all written.  An empty table
gives no documents.  Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill.llm.pretokens import Memory, encode_in_order, in_groups
from tonemill.llm.workers import map_batches
from tonemill.session import durable, scratch

MAGIC = b"TNPF"
BLOCK = 4096
#: Pieces that a worker remembers in each of two generations; encoding unknown ones is the costly part.
REMEMBERED = 300_000
#: Share of a block's ids that the packed width must hold.
PERCENTILE = 0.95
HEAD = struct.Struct("<IIBI")
TAIL = struct.Struct("<QQQQ4s")


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    at = min(len(rest) - 1, int(len(rest) * percentile))
    width = max(1, int(np.partition(rest, at)[at]).bit_length())
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    patched = np.flatnonzero(high)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little")
    return HEAD.pack(len(ids), low, width, len(patched)) + packed.tobytes() + patched.astype("<u4").tobytes() + high[patched].astype("<u4").tobytes()


def unpack_block(data: memoryview, at: int = 0) -> np.ndarray:
    count, low, width, patched = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = -(-count * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * width, bitorder="little").reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits
    rest = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    if patched:
        places = np.frombuffer(data, "<u4", patched, at)
        rest[places] |= np.frombuffer(data, "<u4", patched, at + 4 * patched) << np.uint32(width)
    return rest + np.uint32(low)


class Writer:
    """Writes one file; holds less than a block and one document at a time."""

    def __init__(self, sink):
        self.sink = sink
        self.place = sink.write(MAGIC)
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.starts: list[int] = []
        self.counts: list[int] = []
        self.docs: list[int | None] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        for a in range(0, upto, BLOCK):
            self.starts.append(self.place)
            self.place += self.sink.write(pack_block(ids[a : min(a + BLOCK, upto)]))
        self.open, self.waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> int:
        self._flush(self.waiting)
        total = sum(self.counts)
        known = [0 if d is None else d for d in self.docs]
        self.sink.write(np.array(self.starts, "<u8").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(known, "<i8").tobytes())
        self.sink.write(bytes(d is None for d in self.docs))
        self.sink.write(TAIL.pack(len(self.starts), len(self.docs), total, BLOCK, MAGIC))
        self.sink.close()
        return total


def read_file(source) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, first id in the file, ids) of every document, in order."""
    size = source.size()
    source.seek(size - TAIL.size)
    n_blocks, n_docs, _, _, magic = TAIL.unpack(source.read(TAIL.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    index = size - TAIL.size - n_docs * 17 - n_blocks * 8
    source.seek(index)
    starts = np.frombuffer(source.read(8 * n_blocks), "<u8").astype(np.int64).tolist() + [index]
    counts = np.frombuffer(source.read(8 * n_docs), "<u8").astype(np.int64)
    docs = np.frombuffer(source.read(8 * n_docs), "<i8")
    nulls = source.read(n_docs)
    block, ready = 0, np.zeros(0, np.uint32)
    first = 0
    for k, count in enumerate(counts.tolist()):
        parts = [ready]
        have = len(ready)
        while have < count:
            upto = min(block + 64, n_blocks)
            source.seek(starts[block])
            data = source.read(starts[upto] - starts[block])
            for b in range(block, upto):
                parts.append(unpack_block(data, starts[b] - starts[block]))
                have += len(parts[-1])
            block = upto
        ready = np.concatenate(parts) if len(parts) > 1 else ready
        yield (None if nulls[k] else int(docs[k])), first, ready[:count]
        ready = ready[count:]
        first += count


def _open(path: str):
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), parsed.path
    return pyarrow.fs.FileSystem.from_uri(path)


class PieceEncoder:
    """A worker's tokenizer with the pieces it remembers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memory = Memory(REMEMBERED)

    def encode_pieces(self, found: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(found), 20_000):
            got = self.tokenizer.encode_batch_fast(found[at : at + 20_000], add_special_tokens=False)
            out += [np.array(e.ids, "<i4").tobytes() for e in got]
        return out


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


MANIFEST = "part int, file string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write the files; the manifest, (part, file, n_docs, n_ids, first)."""
    spark = docs.sparkSession
    target = folder or scratch(spark, "token-files")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = _open(target)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tnpf"
        writer, tool = None, encoder(path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    writer = Writer(store.open_output_stream(f"{base}/{name}"))
                ids, lengths = encode_in_order(texts[a:b], tool.memory, tool.encode_pieces)
                at = 0
                for key, n in zip(keys[a:b], lengths.tolist(), strict=True):
                    writer.add(key, np.append(ids[at : at + n], end_id).astype(np.uint32))
                    at += n
        if writer is not None:
            total = writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{target}/{name}"]), pa.array([len(writer.docs)]), pa.array([total])],
                names=["part", "file", "n_docs", "n_ids"],
            )

    manifest = durable(map_batches(placed, run, MANIFEST), "token-manifest")
    # One row per file: the only window over everything is over these.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document, read from the files; ``ids`` are 4 bytes each."""
    schema = T.StructType(
        [T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, base = _open(file)
                rows, size = [], 0
                with store.open_input_file(base) as source:
                    for key, start, ids in read_file(source):
                        rows.append((key, first + start, len(ids), ids.astype("<u4").tobytes()))
                        size += len(ids)
                        if size >= 1 << 20:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    files = manifest.select("file", "first")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(files.repartition(parts, F.xxhash64("file")), run, schema)
