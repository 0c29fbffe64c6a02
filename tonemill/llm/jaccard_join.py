"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A text's set is its distinct shingles of five words.  Texts with equal sets form a class and
one of them stands for all.  Shingles are ordered rarest first; a set's prefix is just long
enough that two sets of Jaccard similarity 0.8 must share a shingle of their prefixes (a shorter
one for the smaller of the two).  Pairs that share one pass the length and the positional filter,
then the suffix filter (the two sets' shingles are counted in 64 hash ranges; the differences
bound the size of the symmetric difference from below), and only then are both texts fetched and
the Jaccard similarity taken once.

The order by rarity comes from a count sketch of fixed size over all shingles of all texts.  Any
order that all texts share gives the same links; the sketch keeps common passages out of prefixes.

Groups are never expanded into pairs.  First every set is compared with one pivot per shared
shingle; links make components.  Then, in turns, sets outside the largest component of a
list are compared with a few of its members, as long as that finds links: first in lists of sets that
agree in a band (the least shingles of four hash ranges; similar sets likely share one of the sixteen, unlike ones
hardly any), then in the lists of prefix shingles.  What remains
are pairs of different components that share a prefix shingle; these are all compared, and
since most members of a large group are in one component by then, few are left.  Only connectedness is asked for, so
pairs inside a component need no comparison.

Very common shingles are known from the sketch and skip the step that drops unshared shingles,
the only one where all prefix rows of a shingle meet; all others combine before they shuffle or
are joins that adaptive execution splits.

Defined results: texts without words, null texts among them, have an empty set and are linked
with nothing.  Rows that repeat an id are one node with all their links.  A null id takes no part:
its component is null.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill.llm.components import label_components
from tonemill.llm.shingles import shingle_sets
from tonemill.llm.workers import map_batches
from tonemill.operators.joins import lookup_join
from tonemill.session import durable

#: Counters of the sketch, and how many travel in one row.
SKETCH, PIECE = 1 << 20, 1 << 12
#: Hash ranges of the suffix filter.
RANGES = 64
#: Hash ranges whose least shingles make one band.
BAND = 4
#: Members drawn of a list's largest component per turn, the most that a set outside it is compared
#: with in one turn, and the share of such comparisons that must find a link for another turn to be made.
DRAWS, TRIALS, WORTH = 6, 32, 0.02

INFO = "id long, n long, key long, digest binary, sig binary, piece int, counters binary"
PREFIX = "h long, key long, n int, pos int, common boolean"


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of texts in slices, so that the sets of few are held at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _key(digest: bytes | None) -> int | None:
    """The name of a set: the start of its digest."""
    return None if digest is None else int.from_bytes(digest[:8], "big", signed=True)


def describe(rows: DataFrame) -> DataFrame:
    """Per text (id, n, key, digest, sig), and per task the counters of its shingles."""
    names = [c.split()[0] for c in INFO.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def batch_of(count: int, **columns: list) -> pa.RecordBatch:
        arrays = [pa.array(columns[n], k) if n in columns else pa.nulls(count, k) for n, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint32)
        for batch in _parts(batches):
            sets = shingle_sets(_texts(batch, 1))
            if sets:
                flat = np.concatenate(sets)
                sketch += np.bincount((flat & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            digests = [_digest(s) for s in sets]
            ranges = [np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes() for s in sets]
            yield batch_of(len(sets), id=batch.column(0), n=[len(s) for s in sets], key=[_key(d) for d in digests], digest=digests, sig=ranges)
        if sketch.any():
            k = SKETCH // PIECE
            yield batch_of(k, piece=list(range(k)), counters=[sketch[i * PIECE : (i + 1) * PIECE].tobytes() for i in range(k)])

    return map_batches(rows, run, INFO)


def sketch_of(info: DataFrame) -> np.ndarray:
    """The counters of all tasks added up; their number is fixed, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, np.zeros(PIECE, np.int64)) + np.frombuffer(counters, np.uint32)
        if sums:
            clipped = [np.minimum(s, 2**31 - 1).astype(np.int32).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(clipped, pa.binary())], names=["piece", "counters"])

    rows = info.where("piece is not null").select("piece", "counters")
    # First in parts by the task they come from, then in whole.
    for fan in (16, 1):
        salt = F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(fan))
        rows = map_batches(rows.repartition(16, "piece", salt), run, "piece int, counters binary")
    sketch = np.zeros(SKETCH, np.int32)
    for r in rows.collect():
        sketch[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["counters"], np.int32)
    return sketch


def prefixes(rows: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(h, key, n, pos, common): the prefix shingles of every set, rarest first.

    Equal sets of one batch are written once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(sketch)
    # A counter this far above the average must hold a shingle of several texts.
    common_from = 3 * float(sketch.mean()) + 200

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in _parts(batches):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            seen = set()
            for s in shingle_sets(_texts(batch, 1)):
                n = len(s)
                key = _key(_digest(s))
                if not n or key in seen:
                    continue
                seen.add(key)
                counts = counters[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                length = n - (4 * n + 4) // 5 + 1
                first = np.lexsort((s, counts))[:length]
                columns[0].append(s[first].view(np.int64))
                columns[1].append(np.full(length, key, np.int64))
                columns[2].append(np.full(length, n, np.int32))
                columns[3].append(np.arange(length, dtype=np.int32))
                columns[4].append(counts[first] >= common_from)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["h", "key", "n", "pos", "common"])

    return map_batches(rows, run, PREFIX)


def shared_only(rows: DataFrame) -> DataFrame:
    """Of rows sorted by (h, key): one row per (h, key), if the shingle is common or has two keys.

    The rows stream through; of the shingle at the end of a batch one row is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            batch = batch.select(["h", "key", "n", "pos", "common"])
            h, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
            fresh[:1] = last is None or not len(h) or (h[0], key[0]) != last
            batch = batch.filter(pa.array(fresh))
            h, key = h[fresh], key[fresh]
            if not len(h):
                continue
            met = np.zeros(len(h) + 1, bool)  # whether a row's shingle is that of the row before
            met[0] = last is not None and h[0] == last[0]
            met[1:-1] = h[1:] == h[:-1]
            keep = met[:-1] | met[1:] | batch.column(4).to_numpy(zero_copy_only=False)
            if met[0] and held is not None:
                yield held
            last, held = (h[-1], key[-1]), None if keep[-1] else batch.slice(len(h) - 1).select([0, 1, 2, 3])
            yield batch.filter(pa.array(keep)).select([0, 1, 2, 3])

    return map_batches(rows, run, "h long, key long, n int, pos int")


def _passes(short: str, long: str) -> Column:
    """Length, index prefix and positional filter for two prefix rows of one shingle; ``short`` has the smaller set."""
    ns, nl = F.col(f"{short}.n").cast("long"), F.col(f"{long}.n").cast("long")
    ps, pl = F.col(f"{short}.pos"), F.col(f"{long}.pos")
    length = 5 * ns >= 4 * nl
    index = ps <= ns - F.floor((8 * ns + 8) / 9)
    position = F.least(ns - ps, nl - pl) >= F.floor((4 * (ns + nl) + 8) / 9)
    return length & index & position


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The suffix filter: drop pairs whose range counts differ by more than the similarity allows."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int32) for i in (2, 3))
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            apart = np.abs(left - right).sum(1)
            # |x| + |y| - 2 overlap, with overlap >= 4/9 of |x| + |y|
            yield batch.filter(pa.array(9 * apart <= total)).select([0, 1])

    return map_batches(both, run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are similar; both whole texts are cut into shingles again."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            left, right = shingle_sets(_texts(batch, 2)), shingle_sets(_texts(batch, 3))
            linked = []
            for x, y in zip(left, right, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield batch.filter(pa.array(linked, pa.bool_())).select([0, 1])

    return map_batches(both, run, "a long, b long")


def _star_pairs(rows: DataFrame, pick: Column) -> DataFrame:
    """Each set with one pivot per shared shingle, if they are of different components and may be similar."""
    index = rows.where("pos <= n - floor((8 * n + 8) / 9)")
    pivots = index.groupBy("h").agg(F.min(F.struct(pick.alias("by"), "node", "n", "pos", "label")).alias("p")).select("h", "p.*")
    s, x = pivots.alias("s"), rows.alias("x")
    met = s.join(x, "h").where(F.col("s.label") != F.col("x.label"))
    smaller = F.struct("s.n", "s.node") < F.struct("x.n", "x.node")
    met = met.where(F.when(smaller, _passes("s", "x")).otherwise(_passes("x", "s")))
    return _distinct_pairs(met.select(F.col("s.node").alias("u"), F.col("x.node").alias("v")))


def _trial_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Sets outside the largest component of a shared shingle's list with ``TRIALS`` members of such components.

    The members are drawn by a hash, others in each turn.
    """
    draw = lambda i: F.min(F.struct(F.xxhash64("node", "h", F.lit(turn * DRAWS + i)).alias("by"), "node", "n", "pos"))
    parts = rows.groupBy("h", "label").agg(F.count("*").alias("k"), *[draw(i).alias(f"d{i}") for i in range(DRAWS)])
    drawn = F.transform(F.array(*[f"d{i}" for i in range(DRAWS)]), lambda d: F.struct(d["node"].alias("node"), d["n"].alias("n"), d["pos"].alias("pos")))
    main = parts.groupBy("h").agg(F.max(F.struct("k", "label", drawn.alias("drawn"))).alias("m"), F.count("*").alias("c")).where("c > 1")
    main = main.select("h", "m.label", F.explode(F.array_distinct("m.drawn")).alias("p"))
    s, x = main.select("h", "label", "p.*").alias("s"), rows.alias("x")
    met = s.join(x, "h").where(F.col("s.label") != F.col("x.label"))
    smaller = F.struct("s.n", "s.node") < F.struct("x.n", "x.node")
    met = met.where(F.when(smaller, _passes("s", "x")).otherwise(_passes("x", "s")))
    pairs = met.select(F.col("s.node").alias("u"), F.col("x.node").alias("v")).distinct()
    few = W.partitionBy("v").orderBy(F.xxhash64("u", F.lit(turn)))
    return _distinct_pairs(pairs.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= TRIALS))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components that share a prefix shingle and may be similar.

    In each shingle's list only members outside its largest component look for partners.
    """
    sizes = rows.groupBy("h", "label").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("h").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("c")).where("c > 1").select("h", F.col("m.label").alias("main"))
    outside = rows.join(largest, "h").where("label <> main").drop("main").alias("s")
    met = outside.join(rows.alias("x"), "h").where(F.col("s.label") != F.col("x.label"))
    smaller = F.struct("s.n", "s.node") < F.struct("x.n", "x.node")
    met = met.where(F.when(smaller, _passes("s", "x")).otherwise(_passes("x", "s")))
    return _distinct_pairs(met.select(F.col("s.node").alias("u"), F.col("x.node").alias("v")))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b").distinct()


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): one text per wanted (id, node); an id may have texts of other sets too."""
    found = lookup_join(rows, wanted, ["id"], "inner").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            keys = [_key(_digest(s)) for s in shingle_sets(_texts(batch, 1))]
            yield batch.filter(pa.array([a == b for a, b in zip(keys, batch.column(0).to_pylist(), strict=True)], pa.bool_()))

    return map_batches(found, run, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def _bands(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h, node, n, pos): a row for each band of a set that has a shingle; to be used like prefix rows."""
    factor = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = shingle_sets(_texts(batch, 1))
            least = np.full((len(sets), RANGES), np.iinfo(np.uint64).max, np.uint64)
            for row, s in zip(least, sets, strict=True):
                _, first = np.unique(s >> np.uint64(58), return_index=True)  # a set is sorted
                row[(s[first] >> np.uint64(58)).astype(np.int64)] = s[first]
            by_band = least.reshape(len(sets), RANGES // BAND, BAND)
            h = np.broadcast_to(np.arange(RANGES // BAND, dtype=np.uint64), by_band.shape[:2]).copy()
            for i in range(BAND):
                h = (h ^ by_band[:, :, i]) * factor
                h ^= h >> np.uint64(29)
            filled = (by_band != np.iinfo(np.uint64).max).any(2)
            keys = np.broadcast_to(batch.column(0).to_numpy()[:, None], filled.shape)
            yield pa.RecordBatch.from_arrays([pa.array(h[filled].view(np.int64)), pa.array(keys[filled])], names=["h", "node"])

    found = map_batches(texts, run, "h long, node long")
    return found.join(nodes.select("node", "n"), "node").select("h", "node", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"))


def _carried_on(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after more links: only components that the new links touch are labelled again."""
    names = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    between = found.join(names("a"), "a", "left").join(names("b"), "b", "left")
    ends = durable(between.select("a", "b", F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y")), "jaccard-links")
    merged = label_components(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    new = ends.select(F.col("a").alias("node"), F.col("x").alias("label")).union(ends.select("b", "y")).where("node = label")
    every = labels.union(new).distinct()
    changed = every.join(merged.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left")
    return durable(changed.select("node", F.coalesce("lower", "label").alias("label")), "jaccard-labels")


def _labelled_sets(rows: DataFrame, tie_ids: bool) -> tuple[DataFrame, DataFrame]:
    """((id, n, key) of every text, (node, label, id) of every set with its smallest id) of rows (id, text).

    With ``tie_ids`` the sets of one id are linked, and texts without an id take no part.
    """
    spark = rows.sparkSession
    info = durable(describe(rows), "jaccard-sets")
    per_text = info.where("piece is null").select("id", "n", "key", "digest", "sig")
    sets = per_text.where("key is not null" + (" and id is not null" if tie_ids else ""))
    nodes = durable(sets.select(F.col("key").alias("node"), "digest", "n", "sig").distinct(), "jaccard-nodes")
    if nodes.groupBy("node").count().where("count > 1").limit(1).count():
        raise ValueError("two sets have the same 64-bit name; change the digest")
    firsts = sets.groupBy(F.col("key").alias("node")).agg(F.min("id").alias("id"))

    # Common shingles are dealt by their sets as well; nothing waits for all their rows to meet.
    deal = F.when(F.col("common"), F.xxhash64("h", "key")).otherwise(F.col("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = prefixes(rows.where("id is not null") if tie_ids else rows, sketch_of(info)).repartition(parts, deal).sortWithinPartitions("h", "key")
    listed = durable(shared_only(found).withColumnRenamed("key", "node"), "jaccard-prefixes")

    if tie_ids:  # an id that comes with several texts ties their sets together
        repeated = sets.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("id", "a")
        tied = sets.join(repeated, "id").where("key <> a").select("a", F.col("key").alias("b")).distinct()
        labels = label_components(durable(tied, "jaccard-links"))
    else:
        labels = spark.createDataFrame([], "node long, label long")

    texts = durable(_texts_of(rows, firsts.join(listed.select("node").distinct(), "node")), "jaccard-texts")
    bands = durable(_bands(texts, nodes), "jaccard-bands")

    def linked(rows: DataFrame, pairs_of: Callable[[DataFrame], DataFrame], labels: DataFrame) -> tuple[DataFrame, bool]:
        """The labels after the pairs made from rows, and whether enough of these were links."""
        made = pairs_of(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        pairs = durable(_plausible(made, nodes.select("node", "n", "sig")), "jaccard-pairs")
        found = durable(_verified(pairs, texts), "jaccard-found")
        return _carried_on(labels, found), found.count() > WORTH * pairs.count()

    labels, _ = linked(listed, lambda rows: _star_pairs(rows, F.struct("n", "node")), labels)
    for lists in (bands, listed):  # go on drawing while it pays, then compare all that is left
        turn, pays = 0, True
        while pays:
            turn += 1
            labels, pays = linked(lists, partial(_trial_pairs, turn=turn), labels)
    labels, _ = linked(listed, _all_pairs, labels)
    return per_text.select("id", "n", "key"), firsts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row; see the module for what is linked."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    per_text, named = _labelled_sets(rows, tie_ids=True)
    # A component is named after the smallest id of any of its texts.
    names = named.groupBy("label").agg(F.min("id").alias("component_id"))
    by_set = named.join(names, "label").select(F.col("node").alias("key"), "component_id")
    answer = per_text.join(by_set, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return answer.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row for each group of linked texts: that of the smallest id, then of the smallest text.

    Texts decide, not ids: rows of one id stay apart unless their texts are linked, and of equal rows one stays.  A row
    with a null id, or without any word, is linked with nothing and stays.  Columns must be comparable.
    """
    ids, texts = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(ids.alias("id"), texts.alias("text")).where("id is not null")
    # Without ties an id is needed for naming only; the texts of one id are sets of their own.
    per_text, named = _labelled_sets(rows, tie_ids=False)
    labelled = per_text.where("key is not null").join(named.select(F.col("node").alias("key"), "label"), "key")
    crowded = labelled.groupBy("label").agg(F.count("*").alias("rows")).where("rows > 1").select("label")
    crowded = durable(named.join(crowded, "label").select(F.col("node").alias("_set"), F.col("label").alias("_group")), "jaccard-crowded")

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), ids.alias("_id"))
    place = docs.columns.index(text_col)
    schema = T.StructType([*whole.select("_row").schema.fields, T.StructField("_id", T.LongType()), T.StructField("_set", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            words = pa.RecordBatch.from_arrays([batch.column(0).flatten()[place]], names=["text"])  # the row holds its text once
            keys = [_key(_digest(s)) for s in shingle_sets(_texts(words, 0))]
            keys = [None if i is None else k for i, k in zip(batch.column(1).to_pylist(), keys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["_row", "_id", "_set"])

    marked = lookup_join(map_batches(whole, run, schema), crowded, ["_set"], "left", spread=["_id"])
    alone = marked.where("_group is null").select("_row.*")
    least = F.min(F.struct("_id", F.col(f"_row.`{text_col}`").alias("_text"), "_row")).alias("_least")
    first = marked.where("_group is not null").groupBy("_group").agg(least).select("_least._row.*")
    return alone.union(first)
