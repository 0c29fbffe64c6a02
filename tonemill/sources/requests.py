"""Training requests in JSON, payloads of unknown form, and job manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.functions.identity import DEFAULT_DOMAIN, domain_or_default
from tonemill.functions.text import unnest
from tonemill.operators.rows import usable_rows

REQUEST_SCHEMA = (
    "domain string, classes array<string>, "
    "dataSet array<struct<text:string,textClass:string>>, useSentimentVector boolean"
)


# Why a request or a row of it is set aside.
NO_JSON, NO_ROWS, NO_TEXT_OR_CLASS = "no JSON object", "no rows", "row has no text or no class"


def split_requests(df: DataFrame, payload: str = "value", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON training requests.

    Rows are (keep..., domain, use_sentiment_vector, row_no, text, label).  Rejects are
    (keep..., row_no, reason, payload): whole requests without a row number, and single rows.
    """
    keep = keep or []
    named = df.select(*keep, F.col(payload).alias("payload"), F.from_json(F.col(payload), REQUEST_SCHEMA).alias("r"))
    is_object = F.get_json_object("payload", "$").startswith("{")
    reason = F.when(F.coalesce(is_object, F.lit(False)), F.when(F.coalesce(F.size("r.dataSet"), F.lit(-1)) <= 0, NO_ROWS)).otherwise(NO_JSON)
    staged = named.withColumn("_reason", reason).select(
        *keep, "payload", "_reason",
        domain_or_default(F.col("r.domain")).alias("domain"),
        F.coalesce("r.useSentimentVector", F.lit(True)).alias("use_sentiment_vector"),
        F.when(F.col("_reason").isNull(), F.col("r.dataSet")).alias("_rows"),
    )
    # A text or class that is missing leaves null here.
    flat = unnest(
        staged, F.col("_rows"), [*keep, "domain", "use_sentiment_vector"], "_t", "row_no"
    ).select(
        *keep, "domain", "use_sentiment_vector", "row_no", F.col("_t.text").alias("text"), F.col("_t.textClass").alias("label")
    )
    unusable = F.col("text").isNull() | F.col("label").isNull() | (F.col("label") == "")
    whole = staged.filter("_reason is not null").select(*keep, F.lit(None).cast("int").alias("row_no"), F.col("_reason").alias("reason"), "payload")
    single = flat.filter(unusable).select(
        *keep, F.col("row_no").cast("int").alias("row_no"), F.lit(NO_TEXT_OR_CLASS).alias("reason"), F.to_json(F.struct("text", "label")).alias("payload")
    )
    return usable_rows(flat), whole.union(single)


def parse_requests(df: DataFrame, payload: str = "value", keep: list[str] | None = None) -> DataFrame:
    """The usable rows of JSON training requests; ``split_requests`` gives what is set aside as well."""
    return split_requests(df, payload, keep)[0]


def to_requests(df: DataFrame, domain: str, classes: list[str], rows: Column, keep: list[str]) -> DataFrame:
    """One JSON request per row; ``rows`` is an array of (text, textClass) structs."""
    body = F.struct(
        F.col(domain).alias("domain"),
        F.array(*[F.lit(c) for c in classes]).alias("classes"),
        rows.alias("dataSet"),
        F.lit(True).alias("useSentimentVector"),
    )
    return df.select(*keep, F.to_json(body).alias("value"))


# Forms of a payload.
ARFF, JSON, CSV, REJECT = "arff", "json", "csv", "reject"
_ROW = "text string, label string"
_TABLE_JSON = "data array<struct<values:array<string>>>"


def _first_line(payload: Column) -> Column:
    """The line that follows blanks and ``%`` lines; what comes after it is not read."""
    return F.regexp_extract(payload, r"^(?:\s*+(?:%[^\n]*+\n)?)*+([^\n]*+)", 1)


def _form_of(first_line: Column) -> Column:
    return (
        F.when(first_line.isNull(), REJECT)
        .when(F.lower(F.substring(first_line, 1, len("@relation"))) == "@relation", ARFF)
        .when(first_line.startswith("{") | first_line.startswith("["), JSON)
        .when(first_line.contains(","), CSV)
        .otherwise(REJECT)
    )


def payload_form(payload: Column) -> Column:
    """ARFF by its ``@relation`` head, JSON by its brace, CSV by a header of two fields or more."""
    return _form_of(_first_line(payload))


def _class_first_arff(lines: Column) -> Column:
    declared = F.filter(lines, lambda x: F.lower(F.trim(x)).startswith("@attribute"))
    return ~F.lower(F.trim(F.get(declared, F.lit(0)))).rlike(r"string\s*$")


def parse_payloads(df: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of payloads that are ARFF, CSV or JSON.

    Rows are (keep..., form, row_no, text, label).  Each payload is parsed as the
    form it shows, into an array inside its row; what shows no form, or has no usable
    row, goes to the rejects (keep..., form, payload).  ``payload_row_rejects`` has
    the unusable rows of the others.
    """
    keep = keep or []
    parsed = _parsed_payloads(df, payload, keep)
    usable = F.filter("_all", _usable)
    rows = unnest(parsed, usable, [*keep, "form"], "_r").select(
        *keep, "form", F.col("_r.row_no").alias("row_no"), F.col("_r.text").alias("text"), F.col("_r.label").alias("label")
    )
    # A payload without a usable row leaves null here.  A test of the array itself would be pushed below the steps of
    # the parser, each of which it would then repeat wherever the next one names it.
    first = parsed.select(*keep, "form", payload, F.explode_outer(F.slice(usable, 1, 1)).alias("_r"))
    return rows, first.filter("_r is null").drop("_r")


def payload_row_rejects(df: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """(keep..., form, row_no, text, label) of the unusable rows of payloads that have usable ones."""
    keep = keep or []
    parsed = _parsed_payloads(df, payload, keep)
    others = F.when(F.exists("_all", _usable), F.filter("_all", lambda x: ~_usable(x)))
    rows = unnest(parsed, others, [*keep, "form"], "_r")
    return rows.select(*keep, "form", "_r.row_no", "_r.text", "_r.label")


def _usable(row: Column) -> Column:
    return row["text"].isNotNull() & row["label"].isNotNull() & (row["label"] != "")


def _parsed_payloads(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Payloads with their form and ``_all``, the array of (row_no, text, label) of all their rows."""
    trimmed = lambda lines: F.transform(lines, lambda x: F.rtrim(x, F.lit("\r")))
    # A line break inside quotes does not end a record of a CSV payload.
    records = F.regexp_extract_all(F.col(payload), F.lit(r'((?:[^"\n]++|"(?:[^"]++|"")*+")++)'), 1)
    # Only these two forms are read line by line.
    lines = F.when(F.col("form") == CSV, trimmed(records)).when(F.col("form") == ARFF, trimmed(F.split(payload, "\n")))
    formed = (
        df.select(*keep, payload).withColumn("_first", _first_line(F.col(payload)))
        .withColumn("form", _form_of(F.col("_first"))).withColumn("_lines", lines)
    )
    is_data = lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("%") & ~F.trim(x).startswith("@")
    header = F.split(F.lower(F.get("_lines", F.lit(0))), ",")
    data = (
        F.when(F.col("form") == ARFF, F.filter("_lines", is_data))
        .when(F.col("form") == CSV, F.filter(F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1))), lambda x: F.trim(x) != ""))
    )
    class_first = (
        F.when(F.col("form") == ARFF, _class_first_arff(F.col("_lines")))
        .when(F.col("form") == CSV, F.trim(F.get(header, F.lit(0))) != "text")
        .otherwise(False)
    )
    body = F.from_json(F.col(payload), f"{REQUEST_SCHEMA}, {_TABLE_JSON}")
    staged = formed.withColumn("_data", data).withColumn("_class_first", F.coalesce(class_first, F.lit(False))).withColumn(
        "_json", F.when(F.col("form") == JSON, body)
    )

    made = lambda text, label, no: F.struct(no.alias("row_no"), text.alias("text"), label.alias("label"))

    def placed(r: Column, no: Column) -> Column:
        text = F.when(F.col("_class_first"), r["label"]).otherwise(r["text"])
        return made(text, F.when(F.col("_class_first"), r["text"]).otherwise(r["label"]), no)

    # Every line is parsed once, then its fields are put in their places.
    fields = lambda options: F.transform(F.transform("_data", lambda x: F.from_csv(x, _ROW, options)), placed)
    arff = fields({"quote": "'", "escape": "\\"})
    csv = fields({"quote": '"', "escape": '"', "multiLine": "true"})
    requests_ = F.transform("_json.dataSet", lambda d, i: made(d["text"], d["textClass"], i))
    tables = F.transform("_json.data", lambda d, i: made(F.get(d["values"], F.lit(0)), F.get(d["values"], F.lit(1)), i))
    every = F.when(F.col("form") == ARFF, arff).when(F.col("form") == CSV, csv).when(F.col("form") == JSON, F.coalesce(requests_, tables))
    return staged.withColumn("_all", every).select(*keep, payload, "form", "_all")


def parse_manifests(df: DataFrame, content: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(keep..., dir, domain, tabbed, format): line 1 to 4 of a job manifest; an empty one is dropped."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.rtrim(x, F.lit("\r")))
    staged = df.filter(F.trim(F.col(content)) != "").withColumn("_l", lines)
    line = lambda i: F.get("_l", F.lit(i))
    blank = F.coalesce(F.trim(line(1)), F.lit("")) == ""
    return staged.select(
        *(keep or []),
        line(0).alias("dir"),
        F.when(blank, DEFAULT_DOMAIN).otherwise(line(1)).alias("domain"),
        F.coalesce(F.lower(line(2)) == "true", F.lit(False)).alias("tabbed"),
        F.nullif(line(3), F.lit("")).alias("format"),
    )
