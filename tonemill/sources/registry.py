"""The model registry: append-only tables of model headers and parameters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.functions.identity import model_ids, registry_key, row_digest
from tonemill.session import durable

HEADER_SCHEMA = (
    "registry_key string, algorithm string, combiner string, features string, model_id string, "
    "generated_on long, n_rows long, n_params long, domain string"
)
PARAM_SCHEMA = "model_id string, label string, feature string, n long, mean double, m2 double, domain string"

# Parameters per file of a stored model.
ROWS_PER_FILE = 2_000_000

# Outcomes of a save.
CREATED, EXISTS, IGNORED = "CREATED", "EXISTS", "IGNORED"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry table; a missing one is empty.  Files that cannot be read are skipped, and with
    them, by ``complete_headers``, the models they belong to."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_headers(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/headers", HEADER_SCHEMA)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/params", PARAM_SCHEMA)


def headers_of(
    params: DataFrame, algorithm: str, combiner: str = "voting", features: str = "sentiment",
    keys: list[str] | None = None,
) -> DataFrame:
    """One header per model (keys...) with its id, key, and size."""
    keys = keys or ["domain"]
    named = params.withColumn("algorithm", F.lit(algorithm))
    numbers = [c for c in ("n", "mean", "m2") if c in params.columns]
    ids = model_ids(named, [*keys, "algorithm"], ["label", "feature"], numbers)
    # Count models keep the number of texts under the empty feature; in the others
    # every feature of a class carries the row count of the class.
    texts = F.max(F.when(F.col("feature") == "", F.col("n")))
    per_class = params.groupBy(*keys, "label").agg(F.coalesce(texts, F.max("n")).alias("n"))
    sizes = per_class.groupBy(*keys).agg(F.sum("n").cast("long").alias("n_rows"))
    return (
        ids.join(sizes, keys)
        .withColumn("combiner", F.lit(combiner))
        .withColumn("features", F.lit(features))
        .withColumn("registry_key", registry_key(F.col("algorithm"), F.col("domain"), F.col("combiner")))
    )


def new_headers(headers: DataFrame, existing: DataFrame) -> DataFrame:
    """Headers whose model is not under their registry key yet."""
    return headers.join(existing.select("registry_key", "model_id").distinct(), ["registry_key", "model_id"], "left_anti")


def save_status(headers: DataFrame, existing: DataFrame) -> DataFrame:
    """Each header with its ``status`` and, in ``_renew``, whether a stored model has to become the newest again.

    Models are compared within their registry key: equal parameters in another domain
    are another model.
    """
    known = existing.groupBy("registry_key", "model_id").agg(F.max("generated_on").alias("_stored_on"))
    newest = latest_headers(existing).select("registry_key", F.col("model_id").alias("_newest"))
    stored = F.col("_stored_on").isNotNull()
    status = F.when(F.col("n_rows") <= 0, IGNORED).when(stored, EXISTS).otherwise(CREATED)
    joined = headers.join(known, ["registry_key", "model_id"], "left").join(newest, "registry_key", "left")
    renew = (F.col("status") == EXISTS) & (F.col("_newest") != F.col("model_id"))
    if "generated_on" in headers.columns:
        renew = renew & (F.col("generated_on") > F.col("_stored_on"))
    return joined.withColumn("status", status).withColumn("_renew", renew).drop("_stored_on", "_newest")


def save_models(
    params: DataFrame, path: str, algorithm: str, generated_on: int | Column, combiner: str = "voting",
    features: str = "sentiment", keys: list[str] | None = None,
) -> DataFrame:
    """Append the models that are new; returns one status row per model.

    ``generated_on`` is the time of all models, or a column made from their keys.
    A model has a folder of its own, named by domain and id, and is written before its
    header: a header never names a model that is not there, and a save that is
    repeated after a crash replaces the folder.  A model that is stored already but is not the
    newest of its key gets another header with the new time, and so is the newest again.
    """
    spark, keys = params.sparkSession, keys or ["domain"]
    # Ids, sizes and the rows themselves are taken from one table: training is not repeated for each.
    params = durable(params, "params")
    headers = headers_of(params, algorithm, combiner, features, keys)
    made_on = generated_on if isinstance(generated_on, Column) else F.lit(generated_on)
    timed = headers.withColumn("generated_on", made_on.cast("long"))
    status = durable(save_status(timed, load_headers(spark, path)), "status")
    fresh = status.filter(F.col("status") == CREATED)
    body = params.join(fresh.select(*keys, "model_id", "n_params"), keys)
    for name in ("mean", "m2"):
        if name not in body.columns:
            body = body.withColumn(name, F.lit(None).cast("double"))
    rows = body.select("model_id", "label", "feature", "n", "mean", "m2", "domain", "n_params").dropDuplicates(
        ["domain", "model_id", "label", "feature"]
    )
    # As many files as a model needs, however many tasks there are.  Models are few bytes but a file each, so that
    # their partitions are not to be merged: one task would write the files of thousands.
    files = F.ceil(F.col("n_params") / ROWS_PER_FILE)
    part = F.pmod(F.xxhash64("label", "feature"), files)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartition(tasks, "domain", "model_id", part).drop("n_params").write
    writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("domain", "model_id").parquet(f"{path}/params")
    columns = [f.split()[0] for f in HEADER_SCHEMA.split(", ")]
    named = status.filter((F.col("status") == CREATED) | F.col("_renew")).select(*columns)
    rest = [c for c in columns if c not in ("registry_key", "model_id")]
    newest = F.max_by(F.struct(*rest), "generated_on").alias("_h")
    new = named.groupBy("registry_key", "model_id").agg(newest).select("registry_key", "model_id", "_h.*")
    new.repartition("domain").write.mode("append").partitionBy("domain").parquet(f"{path}/headers")
    return status.drop("_renew")


def latest_headers(headers: DataFrame) -> DataFrame:
    """The newest model per registry key; equal times go to the higher id."""
    rest = [c for c in headers.columns if c != "registry_key"]
    newest = F.max_by(F.struct(*rest), F.struct("generated_on", "model_id"))
    return headers.groupBy("registry_key").agg(newest.alias("_h")).select("registry_key", "_h.*")


def complete_headers(headers: DataFrame, params: DataFrame) -> DataFrame:
    """Headers of models all of whose parameters can be read; damaged models are left out whole."""
    read = params.groupBy("domain", "model_id").agg(F.count(F.lit(1)).alias("_read"))
    return headers.join(read, ["domain", "model_id"]).filter(F.col("_read") == F.col("n_params")).drop("_read")


def model_folder(spark: SparkSession, path: str, domain: str, model_id: str) -> str:
    """The folder of one model's parameters, with names escaped as the writer does."""
    part = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return f"{path}/params/{part('domain', domain)}/{part('model_id', model_id)}"


def read_models(spark: SparkSession, path: str, models: list[tuple[str, str]]) -> DataFrame:
    """The parameters of some models (domain, id): their folders are listed and read, and no others."""
    jvm, conf, folders = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for domain, model_id in models:
        at = jvm.org.apache.hadoop.fs.Path(model_folder(spark, path, domain, model_id))
        if at.getFileSystem(conf).exists(at):
            folders.append(at.toString())
    if not folders:
        return spark.createDataFrame([], PARAM_SCHEMA)
    reader = spark.read.schema(PARAM_SCHEMA).option("ignoreCorruptFiles", "true").option("basePath", f"{path}/params")
    return reader.parquet(*folders)


def latest_model(spark: SparkSession, path: str, domain: str | None = None, algorithm: str | None = None) -> DataFrame:
    """Parameters of the newest complete model of each registry key, or of one domain.

    A header says how many parameters its model has.  The newest model of each key is read and counted; only where
    one is not whole is the one before it tried, so what is read does not grow with the versions stored.
    """
    headers = load_headers(spark, path)
    if domain is not None:
        headers = headers.filter(F.col("domain") == domain)
    if algorithm is not None:
        headers = headers.filter(F.col("algorithm") == algorithm)
    ordered = headers.groupBy("registry_key").agg(F.sort_array(F.collect_set(F.struct("generated_on", "model_id", "domain", "n_params")), asc=False).alias("versions"))
    newest = {r["registry_key"]: r["newest"] for r in ordered.select("registry_key", F.col("versions")[0].alias("newest")).collect()}  # one per model in use
    sound: list[tuple[str, str]] = []
    depth = 0
    while newest:
        asked = sorted({(v["domain"], v["model_id"]) for v in newest.values()})
        counted = read_models(spark, path, asked).groupBy("domain", "model_id").agg(F.count(F.lit(1)).alias("n")).collect()
        found = {(r["domain"], r["model_id"]): r["n"] for r in counted}
        whole = {key for key, v in newest.items() if found.get((v["domain"], v["model_id"])) == v["n_params"]}
        sound += [(newest[key]["domain"], newest[key]["model_id"]) for key in whole]
        broken, depth = [key for key in newest if key not in whole], depth + 1
        before = ordered.filter(F.col("registry_key").isin(broken)).select("registry_key", F.try_element_at("versions", F.lit(depth + 1)).alias("newest"))
        newest = {r["registry_key"]: r["newest"] for r in before.filter("newest is not null").collect()} if broken else {}
    return read_models(spark, path, sorted(set(sound)))


def models_version(spark: SparkSession, path: str, algorithm: str) -> str | None:
    """A text that changes whenever another set of models is the newest; None while there is none.

    It is made of the headers alone: no parameters are read.
    """
    newest = latest_headers(load_headers(spark, path).filter(F.col("algorithm") == algorithm))
    cells = row_digest([F.col("registry_key"), F.col("model_id"), F.col("generated_on").cast("string")])
    row = newest.agg(F.sum(cells).cast("string").alias("digest"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}-{row['digest']}" if row["n"] else None


def export_json(params: DataFrame) -> DataFrame:
    """One JSON document per parameter row, for export as text."""
    return params.select("domain", F.to_json(F.struct(*params.columns)).alias("value"))
