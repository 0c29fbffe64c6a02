"""The registered queries of the numbered operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import (
    byte_bpe, jaccard_join, language_id, mixing, projection_passes, quality_rules, scalar_clusters, secrets, spelling_variants, suffix_dedup,
    token_files, url_filter, vector_search,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target weights of the mixture: the large source gets four shares, every other source one.
MIX_WEIGHTS = {"src0": 4}
MIX_BLOCK_CHARS = 65_536

MIX_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(length(text), 0) AS n_chars,
         CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS source_key,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn, md5(coalesce(text, '')) AS text_hash
  FROM documents),
blocks AS (
  SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source_key ORDER BY turn, text_hash
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {MIX_BLOCK_CHARS} AS block
  FROM rows_),
w AS (SELECT DISTINCT source_key, CASE WHEN source = 'src0' THEN 4 ELSE 1 END AS weight FROM rows_),
d AS (SELECT CAST(sum(weight) AS BIGINT) AS period FROM w),
sched AS (
  SELECT CAST(0 AS BIGINT) AS slot,
         (SELECT list({{'s': source_key, 'a': CAST(weight AS BIGINT), 'k': CAST(0 AS BIGINT)}} ORDER BY source_key) FROM w) AS st,
         CAST(NULL AS VARCHAR) AS source_key, CAST(NULL AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS release
  UNION ALL
  SELECT slot + 1, list_transform(st, lambda x: {{'s': x.s, 'a': x.a, 'k': CASE WHEN x.s = pick.s THEN x.k + 1 ELSE x.k END}}),
         pick.s, pick.k, pick.r
  FROM (SELECT slot, st, list_sort(list_transform(
                 list_filter(st, lambda x: x.k < x.a AND x.k * period // x.a <= slot),
                 lambda x: {{'d': ((x.k + 1) * period + x.a - 1) // x.a, 's': x.s, 'k': x.k, 'r': x.k * period // x.a}}))[1] AS pick
        FROM sched, d WHERE slot < period))
SELECT b.doc_id, b.source, b.n_chars, b.block,
       (b.block // w.weight) * d.period + s.release AS release, (b.block // w.weight) * d.period + s.slot - 1 AS slot
FROM blocks b JOIN w USING (source_key) CROSS JOIN d
JOIN sched s ON s.source_key = b.source_key AND s.nth = b.block % w.weight
"""


@query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_BLOCK_CHARS)
    return mixed.select("doc_id", "source", "n_chars", "block", "release", "slot")


# The host rules of the contract.
HOST_RULES = [
    url_filter.HostRule("allow", "org", "/"),
    url_filter.HostRule("block", "example.org", "/es/"),
    url_filter.HostRule("block", "example.org", "/en/1"),
    url_filter.HostRule("allow", "com", "/fr/"),
    url_filter.HostRule("block", "com", "/de/"),
]

PATTERN_RULES = [
    url_filter.PatternRule("block", p)
    for p in (
        "||casino-*^",
        "||adult-*^",
        "||*-pills.",
        "||free-bets.",
        "||spam-farm.",
        "||ads-track.",
        "/ads/",
        "/banner/*^",
        "/tracking/pixel^",
        "^utm_campaign=spam^",
        "/wp-login.php^",
        "/sponsored/*.html^",
    )
] + [url_filter.PatternRule("allow", "||casino-*/help/")]


def _url_sql() -> str:
    def case(rules: list, value: str) -> str:
        ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
        fits = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'" for r in ordered)
        return f"CASE {fits} END"

    quoted = lambda r: r.regex.replace("'", "''")
    any_of = lambda v: " OR ".join(f"regexp_matches(low, '{quoted(r)}')" for r in PATTERN_RULES if r.verdict == v)
    return f"""
WITH parts AS (
  SELECT page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         coalesce(translate(regexp_extract(url, '{url_filter.HOST_PATH}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '{url_filter.HOST_PATH}', 2), '') AS path
  FROM pages)
SELECT page_id, host, path, {case(HOST_RULES, 'name')} AS rule,
       coalesce({case(HOST_RULES, 'verdict')},
                CASE WHEN url IS NULL OR NOT contains(url, '://') THEN 'allow'
                     WHEN {any_of('allow')} THEN 'allow' WHEN {any_of('block')} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
"""


@query("op7_url_filter", _url_sql())
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), HOST_RULES, PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    counts = [secrets.count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    digest = F.sha2(secrets.spans_text(base).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.train_and_identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    ids = F.array_join("ids", " ").cast("binary")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    stored = token_files.read_tokens(token_files.write_tokens(table(spark, sf_dir, "documents"), path))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


@query("op2_vector_search")
def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


NEAR_VECTORS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
measured AS (SELECT vec_id, v, len(v) AS dims, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS length FROM usable),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM measured a JOIN measured b ON a.dims = b.dims AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.length * b.length) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN degree USING (vec_id)
"""


@query("op11_near_vectors", NEAR_VECTORS_SQL)
def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.link_near(table(spark, sf_dir, "embeddings"), 0.9)


CENTROIDS, CLUSTER_ROUNDS, CLUSTER_WIDTH, CLUSTER_SCALE, CLUSTER_SEED = 40, 5, 64, 256, "2"


def _clusters_sql() -> str:
    parts = [
        f"""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({CLUSTER_SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {CLUSTER_WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cells AS MATERIALIZED (SELECT vec_id, unnest(range({CLUSTER_WIDTH})) AS d, unnest(v) AS x FROM kept)",
        f"""first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{CLUSTER_SEED}:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM kept
  ORDER BY cluster LIMIT {CENTROIDS})""",
        "c0 AS MATERIALIZED (SELECT cluster, d, x AS c FROM first JOIN cells USING (vec_id))",
    ]
    for i in range(CLUSTER_ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, cluster, distance FROM (
    SELECT vec_id, cluster, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS nth FROM (
      SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM cells JOIN c{i} USING (d) GROUP BY vec_id, cluster)) WHERE nth = 1)""")
        if i < CLUSTER_ROUNDS:
            parts.append(f"""m{i} AS (SELECT cluster, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN cells USING (vec_id) GROUP BY cluster, d)""")
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, d, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{i} LEFT JOIN m{i} USING (cluster, d))""")
    last = f"a{CLUSTER_ROUNDS}"
    parts.append(f"named AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{CLUSTER_ROUNDS} GROUP BY cluster)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM {last} JOIN named USING (cluster)"""


@query("op12_scalar_clusters", _clusters_sql())
def op12_scalar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    assigned, centroids = scalar_clusters.cluster(vectors, CENTROIDS, CLUSTER_ROUNDS, CLUSTER_WIDTH, CLUSTER_SCALE, CLUSTER_SEED)
    return scalar_clusters.with_inertia(assigned, centroids)


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.counted_words(table(spark, sf_dir, "documents")))
