"""Byte-level BPE by recursive DuckDB queries inside each partition.

Encoding: the distinct pieces of a batch of texts enter a recursive query as lists of byte
tokens.  In each step the token-position rows of every unfinished piece join the merge table,
the leftmost pair of the lowest rank is contracted, and a piece is finished when no pair joins.
Long pieces (white space, underlines) take the same steps as rows, contracting all occurrences
of the lowest rank at once, leftmost first, unless one of them would open a pair that goes first.
Decoding: token rows join the vocabulary and an ordered aggregate puts their bytes together.

Spark deals the texts out, nothing is shuffled, and a lost task is simply run again.  Each
worker holds one small in-memory database with the merge table.

Defined results: a null text has no tokens, like an empty one, and decodes to no bytes; a null
list of ids decodes to no bytes; an unknown id fails the job.  Rows are answered one by one, so
null or repeated ids and repeated rows are kept as they are.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill.llm.pretokens import Memory, encode_texts, in_groups
from tonemill.llm.workers import map_batches

#: Pieces per recursive query, bytes from which a piece is long, and tokens per decoding query.
PIECES, LONG, TOKENS = 40_000, 400, 400_000

SHORT_SQL = """
WITH RECURSIVE s AS (
  SELECT w, toks, true AS live FROM given
  UNION ALL
  SELECT s.w,
         CASE WHEN b.p IS NULL THEN s.toks ELSE list_concat(list_append(s.toks[:b.p - 1], b.m), s.toks[b.p + 2:]) END,
         b.p IS NOT NULL
  FROM s LEFT JOIN (
    SELECT w, arg_min(p, m * 4294967296::BIGINT + p) AS p, min(m) AS m
    FROM (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(1, len(toks))) AS p FROM s WHERE live) x
    JOIN merges USING (l, r) GROUP BY w) b USING (w)
  WHERE s.live)
SELECT w, toks FROM s WHERE NOT live ORDER BY w
"""

LONG_SQL = """
WITH RECURSIVE s AS (
  SELECT w, p, t, true AS live FROM given
  UNION ALL
  SELECT w, p, coalesce(here, t), best IS NOT NULL
  FROM (SELECT w, p, t, best, here, lag(here) OVER (PARTITION BY w ORDER BY p) AS before
        FROM (SELECT *, CASE WHEN m = best AND CASE WHEN one THEN nth = 1
                             ELSE row_number() OVER (PARTITION BY w, m = best, seq - nth ORDER BY p) % 2 = 1 END THEN m END AS here
              FROM (SELECT c.*, row_number() OVER (PARTITION BY w, c.m = best ORDER BY p) AS nth,
                           bool_or(c.m = best AND least(x.m, y.m, z.m) <= best) OVER (PARTITION BY w) AS one
                    FROM (SELECT a.*, merges.m, min(merges.m) OVER (PARTITION BY w) AS best
                          FROM (SELECT w, p, t, lag(t) OVER v AS before, lead(t) OVER v AS n, lead(t, 2) OVER v AS after,
                                       row_number() OVER v AS seq
                                FROM s WHERE live WINDOW v AS (PARTITION BY w ORDER BY p)) a
                          LEFT JOIN merges ON l = t AND r = n) c
                    LEFT JOIN merges x ON x.l = c.before AND x.r = c.m AND c.m = best
                    LEFT JOIN merges y ON y.l = c.m AND y.r = c.after AND c.m = best
                    LEFT JOIN merges z ON z.l = c.m AND z.r = c.m AND c.m = best)))
  WHERE before IS NULL)
SELECT w, list(t ORDER BY p) AS toks FROM s WHERE NOT live GROUP BY w ORDER BY w
"""

DECODE_SQL = """
SELECT g, unhex(string_agg(hex, '' ORDER BY p)) AS bytes FROM tokens JOIN vocabulary USING (t) GROUP BY g ORDER BY g
"""


class BpeDatabase:
    """A worker's database with the vocabulary and the merge table of one rank file."""

    def __init__(self, path: str):
        import duckdb

        lines = (line.split() for line in open(path, "rb") if line.strip())  # noqa: SIM115
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        ranks = self.ranks
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        split = ((k, k[:i], k[i:]) for k in ranks for i in range(1, len(k)))
        rows = np.array([(ranks[a], ranks[b], ranks[k]) for k, a, b in split if a in ranks and b in ranks], np.int32).reshape(-1, 3)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        merges = pa.table({"l": rows[:, 0], "r": rows[:, 1], "m": rows[:, 2]})
        vocabulary = pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "hex": [k.hex() for k in ranks]})
        for name, rows_ in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("rows_", rows_)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_")
            self.con.unregister("rows_")
        self.memory = Memory()

    def _ask(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def encode_pieces(self, found: list[str]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers."""
        raw = [p.encode() for p in found]
        out: list[bytes | None] = []
        for piece in raw:
            whole = self.ranks.get(piece)
            out.append(None if whole is None else whole.to_bytes(4, "little"))
        rest = [i for i, x in enumerate(out) if x is None]
        short = [i for i in rest if len(raw[i]) < LONG]
        chunks = [(SHORT_SQL, short[i : i + PIECES]) for i in range(0, len(short), PIECES)]
        chunks += [(LONG_SQL, [i]) for i in rest if len(raw[i]) >= LONG]
        for sql, part in chunks:
            sizes = np.array([len(raw[i]) for i in part])
            tokens = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            if sql is SHORT_SQL:
                lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(tokens))
                given = pa.table({"w": np.arange(len(part), dtype=np.int32), "toks": lists})
            else:
                place = np.arange(len(tokens)) - np.repeat(offsets[:-1], sizes)
                given = pa.table({"w": np.repeat(np.arange(len(part)), sizes).astype(np.int32), "p": place, "t": tokens})
            got = self._ask(sql, "given", given).column("toks").combine_chunks()
            ids, ends = got.flatten().to_numpy().astype("<i4"), got.offsets.to_numpy()
            ends = ends - ends[0]
            for k, i in enumerate(part):
                out[i] = ids[ends[k] : ends[k + 1]].tobytes()
        return out

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of lists of ids laid end to end."""
        ends = np.cumsum(lengths)
        group = np.repeat(np.arange(len(lengths)), lengths)
        parts: list[list[bytes]] = [[] for _ in lengths]
        for at in range(0, len(ids), TOKENS):  # a list may continue in the next query
            part = slice(at, at + TOKENS)
            tokens = pa.table({"g": group[part], "p": np.arange(len(ids[part])), "t": ids[part].astype(np.int32)})
            got = self._ask(DECODE_SQL, "tokens", tokens)
            size = 0
            for g, b in zip(got.column("g").to_pylist(), got.column("bytes").to_pylist(), strict=True):
                parts[g].append(b)
                size += len(b)
        del ends
        return [b"".join(p) for p in parts]


@cache
def database(path: str) -> BpeDatabase:
    return BpeDatabase(path)


def _list_array(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(ids))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row: the token ids of the whole text by the rank file at ``path``."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = database(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_groups(texts):
                ids, lengths = encode_texts(texts[a:b], bpe.memory, bpe.encode_pieces)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _list_array(ids, lengths)], names=[id_col, "ids"])

    return map_batches(rows, run, schema)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, bytes) for every row of token ids."""
    rows = tokens.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids"))
    schema = T.StructType([rows.schema[0], rows.schema[1], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = database(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                lengths = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(bpe.ranks)):
                    raise ValueError("a token id is not in the vocabulary")
                found = bpe.decode(ids, lengths)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(found, pa.binary())], names=[id_col, "ids", "bytes"])

    return map_batches(rows, run, schema)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, bytes) for every row, as ``decode(encode(...))`` gives them, by one worker and one database per task.

    The database goes with its task, so that workers that live on for other stages do not hold it.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BpeDatabase(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_groups(texts):
                ids, lengths = encode_texts(texts[a:b], bpe.memory, bpe.encode_pieces)
                found = bpe.decode(ids, lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _list_array(ids, lengths), pa.array(found, pa.binary())], names=[id_col, "ids", "bytes"])
        bpe.con.close()

    return map_batches(rows, run, schema)
