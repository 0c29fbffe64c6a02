"""Many small files of the machines' own (shared) file system, listed, read and written by the workers.

The reader of the engine keeps the state of every file in the driver, and its writer runs a command for each file that it makes.
Here the names are rows of a stored table, so the driver holds a line per directory.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.session import scratch

# The worker functions travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = "label string, file string, path string, size long"
#: Names of one batch, files and bytes of a task, and bytes of one batch of contents.
NAMES, TASK_FILES, TASK_BYTES, BATCH_BYTES = 10_000, 2_000, 32 << 20, 4 << 20
#: What may not stand for itself in the path of a URI; letters and signs of other scripts may.
NOT_PLAIN = re.compile(r"[^\w/\-.!~*'(),;:$&+=@]")

Batches = Iterator[pa.RecordBatch]


def local_path(spark: SparkSession, path: str) -> str | None:
    """The whole path if it lies in the machines' own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _uri(path: str) -> str:
    def quoted(match: re.Match) -> str:
        c = match[0]
        return quote(c) if c.isascii() or c.isspace() or not c.isprintable() else c

    return "file:" + NOT_PLAIN.sub(quoted, path)


def _is_data(name: str) -> bool:
    """The rule of the file sources for names that are not data."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _listed(batches: Batches) -> Batches:
    """(no, label, folder) to a row per file that is not empty and lies directly in the folder."""

    def made(no: int, label: str, rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        file, path, size = zip(*rows, strict=True)
        return pa.record_batch([pa.array([no] * len(rows), pa.int32()), pa.array([label] * len(rows), pa.string()), pa.array(file, pa.string()), pa.array(path, pa.string()), pa.array(size, pa.int64())], ["no", "label", "file", "path", "size"])

    for batch in batches:
        for row in batch.to_pylist():
            rows = []
            with os.scandir(row["folder"]) as entries:
                for entry in entries:
                    if not _is_data(entry.name) or not entry.is_file() or not (size := entry.stat().st_size):
                        continue
                    rows.append((_uri(entry.path), entry.path, size))
                    if len(rows) == NAMES:
                        yield made(row["no"], row["label"], rows)
                        rows = []
            if rows:
                yield made(row["no"], row["label"], rows)


def list_folders(spark: SparkSession, folders: list[tuple[str, str]]) -> DataFrame:
    """(label, file, path, size) of the files directly in the given (label, folder), a stored table with a part per folder."""
    named = spark.createDataFrame([(i, *f) for i, f in enumerate(folders)], "no int, label string, folder string")
    stored = scratch(spark, "files")
    named.mapInArrow(_listed, f"no int, {LISTING}").write.partitionBy("no").parquet(stored)
    at = spark._jvm.org.apache.hadoop.fs.Path(stored)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    parts = sorted(p for p in (s.getPath().getName() for s in found) if p.startswith("no="))
    if not parts:
        return spark.createDataFrame([], LISTING)
    return spark.read.schema(LISTING).parquet(*[f"{stored}/{p}" for p in parts])


def _whole(path: str) -> bytes:
    """The bytes of a file, held against the checksums beside it if there are any."""
    with open(path, "rb") as file:
        data = file.read()
    folder, name = os.path.split(path)
    try:
        with open(f"{folder}/.{name}.crc", "rb") as file:
            sums = file.read()
    except FileNotFoundError:
        return data
    step = int.from_bytes(sums[4:8], "big")
    if sums[:4] == b"crc\0" and step:
        view = memoryview(data)
        made = b"".join(zlib.crc32(view[i : i + step]).to_bytes(4, "big") for i in range(0, len(data), step))
        if made != sums[8:]:
            raise OSError(f"checksum error: {path}")
    return data


def _read(batches: Batches) -> Batches:
    def made(rows: list[tuple[bytes, str, str]]) -> pa.RecordBatch:
        content, label, file = zip(*rows, strict=True)
        return pa.record_batch([pa.array(content, pa.binary()), pa.array(label, pa.string()), pa.array(file, pa.string())], ["content", "label", "file"])

    rows, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append((_whole(row["path"]), row["label"], row["file"]))
            size += len(rows[-1][0])
            if size >= BATCH_BYTES:
                yield made(rows)
                rows, size = [], 0
    if rows:
        yield made(rows)


def read_files(listing: DataFrame) -> DataFrame:
    """(text, label, file): each listed file as one text."""
    size = listing.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, size["files"]), -(-size["files"] // TASK_FILES), -(-size["bytes"] // TASK_BYTES), 1)
    read = listing.select("path", "label", "file").repartition(tasks, "file").mapInArrow(_read, "content binary, label string, file string")
    return read.select(F.col("content").cast("string").alias("text"), "label", "file")


def _written(root: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        context, met = TaskContext.get(), Counter()
        for batch in batches:
            label, text = batch.column("label").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            for folder, body in zip(label, text, strict=True):
                data = (body or b"") + b"\n"
                digest = hashlib.md5(data, usedforsecurity=False).digest()
                met[folder, digest] += 1
                # A task that is tried again writes the same files, whatever the order of its rows.
                name = f"part-{context.partitionId():05d}-{digest.hex()}-{met[folder, digest]}.txt"
                part = f"{root}/{folder}/.{name}.{context.taskAttemptId()}"
                with open(part, "wb") as file:
                    file.write(data)
                os.replace(part, f"{root}/{folder}/{name}")
            yield pa.record_batch([pa.array([len(label)], pa.int64())], ["n"])

    return run


def write_files(rows: DataFrame, root: str, labels: list[str]) -> None:
    """A file per row (label, text) in the folder of its label, which is one of ``labels``; a text ends with a line break."""
    for label in labels:
        os.makedirs(os.path.join(root, label))
    rows.select("label", "text").mapInArrow(_written(root), "n long").agg(F.sum("n")).collect()
