"""Groups of spelling variants: words one edit apart, found by a frontier over a relational trie.

The trie is a table of edges (node and label, child).  A node is the 64-bit hash of a prefix, so equal prefixes of all
words meet in one node without numbering; there is one trie of the words and one of the reversed words.  An
edit lies either in the second half of a word, whose first half is then untouched, or in the second half of the
reversed word, so the frontier starts at the nodes of the second halves: the root and other crowded nodes are never
visited.  States without an edit are kept only at nodes that another word visits too.  There the edit is made: a letter of the
trie put in or put in place, or the word's own letter left out.  Level by level the states then follow edges for the letters that are
left, in strides of the largest power of two that fits, up to the edge that marks the end of a word; the first stride is
part of the edit's join, so that only edits that go on become rows.  A state without an edge is gone.
A level is one equi-join; there are as many levels as binary ones in the longest rest of a word, and one.  States that
arrive are pairs of near words; both words are compared at last, so that equal hashes make no pair, and none is lost.

Defined results: a null text has no words; a null id counts as an empty one; repeated rows count each time.
No words, no rows.  Words may be of any length.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonemill.functions.text import unnest
from tonemill.llm.workers import map_batches
from tonemill.operators.joins import lookup_join
from tonemill.session import durable

# The contract's letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[a-zÀ-ÿ]"

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
ROOTS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Label of the edge that ends a word; labels of letters are not negative.  ``EDITED - label`` is the label of a stride that
#: begins with a letter of the trie's own, NO_LETTER stands in an edge without such a letter, and LAST
#: after the last letter of a state's word.
END, EDITED, NO_LETTER, LAST = -1, -3, -1, -2
#: Letters of words that are laid out at a time.
LAID_OUT = 200_000


def counted_words(docs: DataFrame, shortest: int = 7, fewest: int = 2, drop_one_in: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, a letter dropped from some, of enough letters and occurrences."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    # A shorter run cannot become a word.
    runs = unnest(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), low.alias("low")), F.regexp_extract_all("low", F.lit(f"{LETTERS}{{{shortest},}}"), 0), ["id"], "run")
    hashed = runs.where("run is not null").select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.col("h") % F.char_length("run")
    dropped = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % drop_one_in == 0, dropped).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _power(span: int) -> np.uint64:
    return np.uint64(pow(BASE, span, 1 << 64))


def _nodes(letters: np.ndarray, root: int) -> np.ndarray:
    """(words, length + 1): the node after each letter."""
    nodes = np.empty((letters.shape[0], letters.shape[1] + 1), np.uint64)
    nodes[:, 0] = root
    for d in range(letters.shape[1]):
        nodes[:, d + 1] = nodes[:, d] * _power(1) + letters[:, d]
    return nodes


def _label(nodes: np.ndarray, d: int, span: int) -> np.ndarray:
    """The label of the ``span`` letters after depth ``d``: they alone decide it, not the node."""
    part = nodes[:, d + span] - nodes[:, d] * _power(span)
    part = (part + np.uint64(span)) * MIX
    part ^= part >> np.uint64(32)
    return ((part * MIX) >> np.uint64(33)).astype(np.int32)


def _stride(rest: int) -> int:
    return 1 << (rest.bit_length() - 1)


def _ways(nodes: np.ndarray, start: int) -> dict[int, np.ndarray]:
    """Depth -> (words, steps): the labels from there to the end of the word and over its last edge."""
    length = nodes.shape[1] - 1
    ways = {length: np.full((len(nodes), 1), END, np.int32)}
    for d in range(length - 1, start - 1, -1):
        span = _stride(length - d)
        ways[d] = np.concatenate([_label(nodes, d, span)[:, None], ways[d + span]], axis=1)
    return ways


def _laid_out(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(numbers, letters, nodes forwards and backwards) of words of one length at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        same = np.flatnonzero(lengths == length)
        most = max(1, LAID_OUT // length)
        for a in range(0, len(same), most):
            some = same[a : a + most]
            text = "".join(words[i] for i in some)
            letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)
            yield some, letters, [_nodes(letters, ROOTS[0]), _nodes(letters[:, ::-1], ROOTS[1])]


def _signed(nodes: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(nodes).view(np.int64))


def _batch(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def _named(words: DataFrame) -> DataFrame:
    """(word, n, whole, reverse): the words with the nodes at their ends in both tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for some, _, both in _laid_out(texts):
                yield _batch(["word", "n", "whole", "reverse"], [*(c.take(pa.array(some)) for c in batch.columns), *(_signed(nodes[:, -1]) for nodes in both)])

    return map_batches(words.select("word", "n"), run, "word string, n long, whole long, reverse long")


def _visited(named: DataFrame) -> DataFrame:
    """(node, origin, place): the nodes of the second halves of all words; a place is twice the depth, plus one in the reversed word.

    A word is named by its whole hash.  A word of one letter less may start its frontier one node early.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters, both in _laid_out(batch.column(0).to_pylist()):
                length, count = letters.shape[1], len(letters)
                places = [2 * d + back for back in (0, 1) for d in range((length - 1 + back) // 2, length + 1)]
                nodes = np.concatenate([both[p % 2][:, p // 2] for p in places])
                yield _batch(["node", "origin", "place"], [_signed(nodes), _signed(np.tile(both[0][:, -1], len(places))), pa.array(np.repeat(places, count).astype(np.int32))])

    return map_batches(named.select("word"), run, "node long, origin long, place int")


def _shared(named: DataFrame) -> DataFrame:
    """(word, places): the words with the places whose node another word visits too; at others no edit leads to a word."""
    at_node = Window.partitionBy("node").orderBy("origin")
    company = F.coalesce(F.lag("origin").over(at_node), F.lead("origin").over(at_node)).isNotNull()
    met = _visited(named).withColumn("met", company).where("met")
    places = met.groupBy("origin").agg(F.collect_set("place").alias("places"))  # bounded by the word's own length
    return named.select("word", F.col("whole").alias("origin")).join(places, "origin").select("word", "places")


def _masks(places: pa.ListArray, some: np.ndarray, length: int) -> list[np.ndarray]:
    """Which depths of some words are places, forwards and backwards."""
    chosen = places.take(pa.array(some))
    row = np.repeat(np.arange(len(some)), np.diff(chosen.offsets.to_numpy()))
    place = chosen.flatten().to_numpy()
    masks = [np.zeros((len(some), length + 1), bool) for _ in range(2)]
    for back, mask in enumerate(masks):
        mine = (place % 2 == back) & (place // 2 <= length)
        mask[row[mine], place[mine] // 2] = True
    return masks


def _next(nodes: np.ndarray, d: int) -> tuple[np.ndarray, int]:
    """The label of the stride from depth ``d`` and the depth it leads to; the end of a word leads to itself."""
    length = nodes.shape[1] - 1
    if d == length:
        return np.full(len(nodes), END, np.int32), d
    span = _stride(length - d)
    return _label(nodes, d, span), d + span


def edges(placed: DataFrame) -> DataFrame:
    """(key, met, child): strides along the words, and strides that begin with another letter than a state has.

    The latter, one for each letter ``met`` at a place, have labels of their own; ``met`` is NO_LETTER in the former.
    The key stands for node and label.  Equal edges of several words are one, in the place they are dealt to by their key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, letters, both in _laid_out(batch.column(0).to_pylist()):
                length, cells = letters.shape[1], []
                masks = _masks(batch.column(1), some, length)
                for back, (nodes, mask) in enumerate(zip(both, masks, strict=True)):
                    own, along = letters[:, ::-1] if back else letters, mask.copy()
                    along[:, 1:] |= mask[:, :-1]
                    for d in range(length + 1):
                        at = np.flatnonzero(along[:, d] if d < length else mask[:, d])
                        if not len(at):
                            continue
                        label, to = _next(nodes[at], d)
                        along[at, to] = True
                        cells.append((nodes[at, d], label, np.full(len(at), NO_LETTER), nodes[at, to]))
                        at = np.flatnonzero(mask[:, d]) if d < length else at[:0]
                        if len(at):
                            label, to = _next(nodes[at], d + 1)
                            cells.append((nodes[at, d], EDITED - label, own[at, d].astype(np.int64), nodes[at, to]))
                if cells:
                    node, label, met, child = (np.concatenate([c[k] for c in cells]) for k in range(4))
                    yield _batch(["node", "label", "met", "child"], [_signed(node), pa.array(label), pa.array(met.astype(np.int16)), _signed(child)])

    made = map_batches(placed, run, "node long, label int, met short, child long")
    return made.select(F.xxhash64("node", "label").alias("key"), "met", "child").repartition("key").distinct()


def _lists(ways: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.repeat([w.shape[1] for w in ways], [len(w) for w in ways]).cumsum()])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([w.ravel() for w in ways])))


def states(placed: DataFrame) -> DataFrame:
    """(key, origin, letter, rest): one-edit states at the places of the second halves, by the stride each takes first.

    Put in before or in place of the word's own ``letter`` may be any other letter; of equal letters in a row only the last
    is left out.  ``rest`` is the way after the first stride, without the last edge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, letters, both in _laid_out(batch.column(0).to_pylist()):
                length, origin, cells = letters.shape[1], both[0][:, -1], []
                masks = _masks(batch.column(1), some, length)
                for back, (nodes, mask) in enumerate(zip(both, masks, strict=True)):
                    own, start = letters[:, ::-1] if back else letters, (length + back) // 2
                    ways = _ways(nodes, start)
                    for d in range(start, length + 1):
                        at = np.flatnonzero(mask[:, d])
                        if not len(at):
                            continue
                        letter = np.full(len(at), LAST) if d == length else own[at, d].astype(np.int64)
                        way = ways[d][at]
                        cells.append((origin[at], nodes[at, d], EDITED - way[:, 0], letter, way[:, 1:-1]))
                        if d < length:
                            way = ways[d + 1][at]
                            cells.append((origin[at], nodes[at, d], EDITED - way[:, 0], letter, way[:, 1:-1]))
                            last = np.ones(len(at), bool) if d + 1 == length else own[at, d] != own[at, d + 1]
                            cells.append((origin[at][last], nodes[at, d][last], way[last, 0], letter[last], way[last, 1:-1]))
                if cells:
                    flat = [np.concatenate([c[k] for c in cells]) for k in range(4)]
                    columns = [_signed(flat[0]), _signed(flat[1]), pa.array(flat[2]), pa.array(flat[3].astype(np.int16)), _lists([c[4] for c in cells])]
                    yield _batch(["origin", "node", "label", "letter", "rest"], columns)

    made = map_batches(placed, run, "origin long, node long, label int, letter short, rest array<int>")
    return made.select(F.xxhash64("node", "label").alias("key"), "origin", "letter", "rest")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words that differ by one inserted, deleted or replaced letter, both ways round."""
    named = durable(_named(words), "words")
    placed = durable(_shared(named), "word-places")
    edited = states(placed).join(edges(placed), "key").where("met <> letter")
    stored = durable(edited.select("origin", F.col("child").alias("node"), "rest"), "word-states")
    arrived = stored.where(F.size("rest") == 0).select("origin", "node")
    along = edges(placed).where(F.col("met") == NO_LETTER).select("key", "child")
    while stored.where(F.size("rest") > 0).limit(1).count():
        step = F.xxhash64("node", F.element_at("rest", 1)).alias("key")
        waiting = stored.where(F.size("rest") > 0).select("origin", step, F.slice("rest", 2, F.size("rest")).alias("rest"))
        stored = durable(waiting.join(along, "key").select("origin", F.col("child").alias("node"), "rest"), "word-states")
        arrived = arrived.union(stored.where(F.size("rest") == 0).select("origin", "node"))
    ends = named.select(F.col("whole").alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    ends = ends.union(named.select("reverse", "word", "n"))
    pairs = arrived.distinct().join(ends, "node").join(named.select(F.col("whole").alias("origin"), "word"), "origin")
    exact = pairs.where(F.levenshtein("word", "near", 1) == 1)
    return exact.select("word", "near", "near_n").distinct()


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n).

    The form is the near word of most occurrences, equal ones in code-point order, if it has ``times`` as many as the
    word.  Occurrences grow along forms, so they end; each round doubles the distance that is followed.
    """
    stored = durable(words, "counted-words")
    near = durable(near_words(stored), "near-words")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    judged = stored.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))
    enough = F.col("near_n") >= times * F.col("n")
    formed = durable(judged.select("word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")), "word-forms")
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = durable(lookup_join(roots, further, ["root"], "left", spread=["word"]), "word-roots")
        roots = stepped.select("word", F.coalesce("further", "root").alias("root"))
        if not stepped.where("further is not null").limit(1).count():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
