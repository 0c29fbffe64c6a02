"""Labelled text from class directories and from tab-separated lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.sources import files

# Classes of the score codes when a format names none.
DEFAULT_SCORES = {0: "neg", 1: "pos"}

NOT_TWO_FIELDS = "line has not two fields"
UNKNOWN_CLASS = "class code is not in the format"


@dataclass(frozen=True)
class LineFormat:
    """Field order and class names of tab-separated lines."""

    class_first: bool
    scores: dict[int, str]


def parse_format(spec: str | None) -> LineFormat:
    """``"<first> <second> [0=neg;1=pos]"``: a first word that starts with SCORE puts the class first."""
    words = (spec or "").split(" ")
    scores: dict[int, str] = {}
    if len(words) >= 3:
        for entry in words[2].split(";"):
            code, sep, name = entry.partition("=")
            if sep and name and "=" not in name and re.fullmatch(r"[+-]?[0-9]+", code):
                scores[int(code)] = name
    return LineFormat(words[0].upper().startswith("SCORE"), scores or dict(DEFAULT_SCORES))


def map_class(code: Column, scores: dict[int, str]) -> Column:
    """The class of a score code; anything else stays as it is."""
    pairs = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    number = F.when(code.rlike("^[+-]?[0-9]+$"), code.try_cast("int"))
    return F.coalesce(pairs[number], code)


def split_lines(lines: DataFrame, fmt: LineFormat, line: str = "value") -> DataFrame:
    """Add (text, label, reason); ``reason`` is null for good lines.

    Empty fields at the end of a line do not count as fields.
    """
    fields = F.split(F.rtrim(F.col(line), F.lit("\t")), "\t")
    c, t = (0, 1) if fmt.class_first else (1, 0)
    parts = lines.withColumn("_f", fields)
    two = F.size("_f") == 2
    mapped = map_class(F.col("_f")[c], fmt.scores)
    reason = F.when(~two, NOT_TWO_FIELDS).when(~F.col("label").isin(list(fmt.scores.values())), UNKNOWN_CLASS)
    return (
        parts.withColumn("text", F.when(two, F.col("_f")[t]))
        .withColumn("label", F.when(two, mapped))
        .withColumn("reason", reason)
        .drop("_f")
    )


def good_lines(split: DataFrame) -> DataFrame:
    return split.filter(F.col("reason").isNull()).drop("reason")


def bad_lines(split: DataFrame, line: str = "value") -> DataFrame:
    kept = [c for c in split.columns if c not in {"text", "label"}]
    return split.filter(F.col("reason").isNotNull()).select(*kept)


def read_labelled_lines(spark: SparkSession, path: str, spec: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of the files directly in a directory."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    split = split_lines(lines, parse_format(spec))
    return good_lines(split).drop("value"), bad_lines(split)


def _path_part(path: Column, from_end: int) -> Column:
    part = F.element_at(F.split(path, "/"), -from_end)
    # The path is a URI, in which a plus sign stands for itself.
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _local_classes(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(class, folder) of the directories in a ``root`` of the machines' own file system; none for a root of another kind."""
    if files.local_path(spark, root) is None:
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted((s.getPath().getName(), s.getPath().toUri().getPath()) for s in fs.listStatus(at) if s.isDirectory())


def _in_class_dirs(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(..., label, file): what a reader finds in the files directly in the sub-directories of ``root``.

    The directories are listed, one call each; naming every file by a pattern would make each of them a path to
    look up and to list on its own.  Files elsewhere below ``root`` do not count.
    """
    root = root.rstrip("/")
    reader = spark.read.format(kind).option("recursiveFileLookup", "true")
    found = (reader.option("wholetext", "true") if kind == "text" else reader).load(f"{root}/*")
    file = F.col("_metadata.file_path")
    top = root.rsplit("/", 1)[-1]
    # Names that a directory below a class has in common with ``root`` are told apart by their depth.
    path = F.regexp_replace(file, "^[^/]*:(//[^/]*)?", "")
    deep = F.size(F.split(path, "/")) == _path_of(spark, root).count("/") + 3
    return found.select("*", _path_part(file, 2).alias("label"), file.alias("file")).filter(deep & (_path_part(file, 3) == top))


def _path_of(spark: SparkSession, path: str) -> str:
    """The whole path without its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath()


def read_class_dirs(spark: SparkSession, root: str) -> DataFrame:
    """(text, label, file): one row per file of each sub-directory, whose name is the class.

    Files are read whole and decoded in one piece; empty files give no row.  Workers list and read the files of the machines'
    own file system, so that the driver knows the classes only; those of other systems are found by the engine's reader.
    """
    if classes := _local_classes(spark, root):
        return files.read_files(files.list_folders(spark, classes))
    return _in_class_dirs(spark, root, "text").select(F.col("value").alias("text"), "label", "file")


def class_dir_files(spark: SparkSession, root: str) -> DataFrame:
    """(file): every file in the class directories, by name only."""
    if classes := _local_classes(spark, root):
        return files.list_folders(spark, classes).select("file")
    return _in_class_dirs(spark, root, "binaryFile").select("file")
