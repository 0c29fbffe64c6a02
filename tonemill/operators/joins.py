"""Joins against a lookup side that is stored first and broadcast only if it is small."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.session import durable

BROADCAST_ROWS = "spark.tonemill.broadcastRows"
BROADCAST_BYTES = "spark.tonemill.broadcastBytes"
SALTS = "spark.tonemill.salts"
DEFAULT_BROADCAST_ROWS = 300_000
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_SALTS = 8


@dataclass(frozen=True)
class Lookup:
    """A stored table with one row per key and the outcome of its size check.

    A table that is too large may have ``head``, the rows of the keys that were met most often, which is small.
    """

    table: DataFrame
    small: bool
    head: DataFrame | None = None
    tail: DataFrame | None = None


def _setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


def _stored_bytes(table: DataFrame) -> int:
    """Bytes of the files of a stored table, from the file listing alone."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    folders = {jvm.org.apache.hadoop.fs.Path(f).getParent().toString() for f in table.inputFiles()}
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in folders]
    return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)


def as_lookup(table: DataFrame, weight: str | None = None) -> Lookup:
    """Check a table that is stored already: it is small with few rows of few bytes.

    Keys differ, so a row takes a byte of the files at least: files of fewer bytes than rows are allowed settle the
    small tables without a job, and files beyond the allowed bytes the large ones.  Only those between are read,
    once, to count their rows and the bytes they have written out as text.

    With a column ``weight``, how often each key was met in training, a large table is split: its keys of the greatest
    weights are a head within the limits, the others the tail.
    """
    spark = table.sparkSession
    rows, most = _setting(spark, BROADCAST_ROWS, DEFAULT_BROADCAST_ROWS), _setting(spark, BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES)
    if rows <= 0:
        return Lookup(table, False)
    on_disk = _stored_bytes(table)
    if on_disk <= min(rows, most):
        return Lookup(table, True)
    if on_disk <= most or weight is not None:
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))
        measured = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
        if measured["rows"] <= rows and measured["bytes"] <= most:
            return Lookup(table, True)
        if weight is not None:
            return _split(table, weight, min(1.0, rows / measured["rows"], most / measured["bytes"]))
    return Lookup(table, False)


def _split(table: DataFrame, weight: str, share: float) -> Lookup:
    """The large table with a head of about half the ``share`` of its rows that may be broadcast, heaviest first."""
    cut = table.agg(F.percentile_approx(weight, 1 - share / 2, 10_000).alias("cut")).first()["cut"]
    return Lookup(table, False, table.filter(F.col(weight) > cut), table.filter(F.col(weight) <= cut))


def store_lookup(df: DataFrame, name: str = "lookup", weight: str | None = None) -> Lookup:
    """Compute a lookup side once, into the shared folder, and check what is there.

    The check reads the stored files, so it costs no second pass over whatever the
    table was made from.
    """
    return as_lookup(durable(df, name), weight)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame | Lookup,
    on: list[str],
    how: str = "left",
    spread: list[str] | None = None,
) -> DataFrame:
    """Join many rows to a lookup side that has one row per key.

    A lookup side within the limits is broadcast: the big side does not
    move.  Beyond it both sides are shuffled, and since a single key may hold a
    large share of ``rows``, each key is spread over a fixed number of salts
    taken from ``spread`` (columns that differ between rows of one key).  Every
    salt meets its own copy of the lookup row, so the result is the same.
    """
    if not isinstance(lookup, Lookup):
        lookup = store_lookup(lookup)
    if lookup.small:
        return rows.join(F.broadcast(lookup.table), on, how)
    salts = _setting(rows.sparkSession, SALTS, DEFAULT_SALTS)
    if spread is None or salts <= 1:
        return rows.join(lookup.table, on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = lookup.table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
