"""Unbounded inputs: training messages, labelled files, and trigger files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tonemill.functions.identity import domain_or_default
from tonemill.sources.requests import parse_manifests, parse_requests

TRIGGER_GLOB = "*.train"
DEFAULT_FILES_PER_TRIGGER = 1000


def file_stream(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet",
    files_per_trigger: int = DEFAULT_FILES_PER_TRIGGER, glob: str | None = None, **options: str,
) -> DataFrame:
    """New files of a directory and those already there; a micro-batch takes a bounded number."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def raw_messages(
    spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None,
    files_per_trigger: int = DEFAULT_FILES_PER_TRIGGER,
) -> DataFrame:
    """(value): training messages as they come, lines of text files or the values of a Kafka topic."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        return raw.select(F.col("value").cast("string").alias("value"))
    return file_stream(spark, path, "value string", "text", files_per_trigger)


def message_stream(
    spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None,
    files_per_trigger: int = DEFAULT_FILES_PER_TRIGGER,
) -> DataFrame:
    """(domain, use_sentiment_vector, row_no, text, label) rows of JSON training messages.

    Messages are lines of text files, or the values of a Kafka topic when its
    options are given.  The domain is a column, so one stream serves all models.
    ``store_messages`` keeps what is no usable row as well.
    """
    return parse_requests(raw_messages(spark, path, kafka, files_per_trigger))


def trigger_stream(
    spark: SparkSession, path: str, files_per_trigger: int = 100, glob: str = TRIGGER_GLOB
) -> DataFrame:
    """(file, dir, domain, tabbed, format) of job manifests; files without the trigger ending are ignored."""
    raw = file_stream(
        spark, path, "value string", "text", files_per_trigger, glob, wholetext="true"
    )
    return parse_manifests(
        raw.select("value", F.col("_metadata.file_path").alias("file")), "value", ["file"]
    )


def with_default_domain(stream: DataFrame) -> DataFrame:
    return stream.withColumn("domain", domain_or_default(F.col("domain")))
