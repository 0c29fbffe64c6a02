"""URL filter [native]: pattern rules indexed by their rarest literal token.

Rules come in two layers.  Host rules (``HostRule``) fit a host, its subdomains and a start of
the path; the longest one that fits decides.  Where none fits, pattern rules decide: every
pattern is filed under the one of its literal tokens that is rarest among all URLs at hand, a
URL fetches the rules filed under its own tokens, and only those run their regular expression.

Defined results: a null URL, or one without ``://``, has an empty host and path, meets no
pattern and is allowed.  Repeated and null ids are kept, one row for one row.  Other columns
of the input are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonemill.operators.joins import lookup_join

ALLOW, BLOCK = "allow", "block"
HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TOKEN_BREAK = "[^a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A pattern over the lower-cased URL.

    ``||`` at its start stands for the start of the host or of one of its labels, ``*`` for
    anything, ``^`` for a separator or the end; all else stands for itself.
    """

    verdict: str
    pattern: str

    @property
    def regex(self) -> str:
        parts = {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}
        body = self.pattern.removeprefix("||")
        head = "(?s)" + ("^[^:/?#]*://([^/?#]*[.])?" if body != self.pattern else "")
        return head + "".join(parts.get(c) or (c if c.isalnum() else f"[{c}]") for c in body)

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL the pattern fits must hold whole.

        A run at an open end of the pattern, or beside ``*``, may be part of a longer token
        of the URL and cannot serve.
        """
        body = self.pattern.removeprefix("||")
        left_open = body == self.pattern
        found = []
        for run in re.finditer("[a-z0-9]+", body):
            before = body[run.start() - 1] if run.start() else ("*" if left_open else "|")
            after = body[run.end()] if run.end() < len(body) else "*"
            if "*" not in (before, after):
                found.append(run.group())
        return sorted(set(found))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of a URL."""
    host = F.translate(F.regexp_extract(url, HOST_PATH, 1), ascii_uppercase, ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, HOST_PATH, 2), F.lit(""))


def host_rule(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """The longest rule that fits as (name, verdict), or null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _tokens(url: Column) -> Column:
    lower = F.translate(url, ascii_uppercase, ascii_lowercase)
    return F.array_distinct(F.array_remove(F.split(lower, TOKEN_BREAK), ""))


def rule_table(spark: SparkSession, rules: list[PatternRule]) -> DataFrame:
    """The pattern rules as a table (verdict, pattern, regex, tokens)."""
    rows = [{"verdict": r.verdict, "pattern": r.pattern, "regex": r.regex, "tokens": r.tokens} for r in rules]
    kind = "array<struct<verdict:string,pattern:string,regex:string,tokens:array<string>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """File every rule under its rarest token (ties: the first by name), counted over all URLs.

    A rule without a whole token is filed under a null token; ``match_patterns`` offers it to
    every URL.
    """
    filed = rules.select("verdict", "pattern", "regex", F.explode_outer("tokens").alias("token"))
    wanted = filed.select("token").where("token is not null").distinct()
    seen = urls.select(F.explode(_tokens(F.col("url"))).alias("token"))
    counts = lookup_join(seen, wanted, ["token"], "inner", spread=None).groupBy("token").agg(F.count("*").alias("n_urls"))
    rarest = W.partitionBy("pattern", "verdict").orderBy(F.coalesce("n_urls", F.lit(0)), "token")
    ranked = filed.join(counts, "token", "left").withColumn("nth", F.row_number().over(rarest))
    return ranked.where("nth = 1").drop("nth")


def match_patterns(urls: DataFrame, index: DataFrame) -> DataFrame:
    """One row per distinct URL that a pattern fits: (url, method, pattern); ``allow`` beats ``block``."""
    tokens = F.concat(_tokens(F.col("url")), F.array(F.lit("")))  # the empty token fetches rules without one
    tokens = urls.select("url", F.explode(tokens).alias("token"))
    filed = index.withColumn("token", F.coalesce("token", F.lit("")))
    candidates = lookup_join(tokens, _per_token(filed), ["token"], "inner", spread=["url"])
    lower = F.translate("url", ascii_uppercase, ascii_lowercase)
    fits = candidates.select("url", lower.alias("lower"), F.explode("rules").alias("r")).where("lower rlike r.regex")
    first = F.min(F.struct((F.col("r.verdict") != ALLOW).alias("later"), "r.pattern", "r.verdict"))
    return fits.groupBy("url").agg(first.alias("m")).select("url", F.col("m.verdict").alias("method"), F.col("m.pattern").alias("pattern"))


def _per_token(index: DataFrame) -> DataFrame:
    """The index with one row per token, as a lookup side must be."""
    return index.groupBy("token").agg(F.collect_list(F.struct("verdict", "pattern", "regex")).alias("rules"))


def filter_urls(pages: DataFrame, host_rules: list[HostRule], pattern_rules: list[PatternRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for every row; ``rule`` is the host rule that decided."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    urls = rows.select("url").where(F.col("url").contains("://"))
    found = match_patterns(urls, rule_index(urls, rule_table(pages.sparkSession, pattern_rules)))
    host, path = url_parts(F.col("url"))
    judged = rows.join(found, "url", "left").select(id_col, "method", "pattern", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("base", host_rule(F.col("host"), F.col("path"), host_rules))
    verdict = F.coalesce("base.verdict", "method", F.lit(ALLOW))
    pattern = F.when(F.col("base").isNull(), F.col("pattern"))
    return judged.select(id_col, "host", "path", F.col("base.name").alias("rule"), verdict.alias("verdict"), pattern.alias("pattern"))
