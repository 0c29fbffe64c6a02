"""Domains, registry keys and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the domain of rows that name none.
DEFAULT_DOMAIN = "$DEF"


def domain_or_default(domain: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(domain), F.lit("")), F.lit(DEFAULT_DOMAIN))


def domain_list(names: Column) -> Column:
    """``a,b`` becomes ``[a, b, $DEF]`` without blanks or repeats."""
    parts = F.transform(F.split(F.coalesce(names, F.lit("")), ","), lambda x: F.trim(x))
    named = F.filter(parts, lambda x: x != "")
    return F.array_distinct(F.concat(named, F.array(F.lit(DEFAULT_DOMAIN))))


def registry_key(algorithm: Column, domain: Column, combiner: Column) -> Column:
    return F.concat_ws("-", algorithm, domain, combiner)


# Sums of the same rows in another order differ by less than this share.
ORDER_NOISE = 1e-14


def _fixed_point(value: Column, summed: bool = False) -> Column:
    """Six decimals as text.  A sum that is a tie but for its noise goes away from zero, as an exact tie does."""
    exact = value * F.lit(1 + ORDER_NOISE) if summed else value
    return F.coalesce(F.round(exact, 6).cast("decimal(28,6)").cast("string"), F.lit("-"))


def row_digest(columns: list[Column]) -> Column:
    """48 bits of the row's md5 as an exact number, so that digests can be added."""
    digest = F.md5(F.concat_ws("|", *columns))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(20,0)")


def model_ids(params: DataFrame, keys: list[str], texts: list[str], numbers: list[str]) -> DataFrame:
    """One id per model: equal parameters give equal ids, whatever the row order.

    The digests of the parameter rows are summed, which combines map-side and
    never gathers a model in one place.
    """
    kinds = dict(params.dtypes)
    cells = [F.col(c) for c in texts] + [_fixed_point(F.col(c), kinds[c] == "double") for c in numbers]
    summed = params.groupBy(*keys).agg(
        F.sum(row_digest(cells)).alias("body"), F.count(F.lit(1)).alias("n_params")
    )
    body = F.concat_ws(
        "|", F.col("algorithm"), F.col("body").cast("string"), F.col("n_params").cast("string")
    )
    return summed.withColumn("model_id", F.md5(body)).drop("body")
