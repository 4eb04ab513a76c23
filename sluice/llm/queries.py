"""One query for each operator, over its whole table, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language, licenses, mixing, pii, sharding, simhash, topk, toxicity, url_filter
from .common import table

#: The rules of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(3))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), lambda c: part(c) != 1)
    found = toxicity.score_documents(docs, model, threshold=0.7)
    return found.select("doc_id", (part(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_licences(docs, licenses.learn(docs))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    found = language.identify(docs, language.learn(docs, part != 2))
    return found.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score", "bits")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_licences": op3_licences,
    "op4_topk": op4_topk,
    "op5_sharding": op5_sharding,
    "op6_language": op6_language,
    "op7_surrogates": op7_surrogates,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_url_filter": op10_url_filter,
}

ORACLES: dict[str, str] = {
    "op4_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op9_mixing": r"""
        WITH d AS (
          SELECT doc_id AS id, source, coalesce('s' || source, 'n') AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                 CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 8) AS BIGINT) AS draw,
                 greatest(1, CAST(ceil((SELECT count(*) FROM documents) / 50000) AS BIGINT)) AS shards FROM documents),
        z AS (SELECT *, draw % shards AS shard FROM d),
        s1 AS (SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY ALL),
        s2 AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s1),
        s3 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
        s4 AS (SELECT *, least(cap, coalesce(max(CASE WHEN cap / weight >= level THEN level END) OVER () * weight, cap)) AS target FROM s3),
        s5 AS (SELECT *, CAST(floor(budget / 64 + 0.5) AS BIGINT) AS seats, CAST(ceil(source_size * 2 / 64.0::DOUBLE) AS BIGINT) AS most FROM s4),
        s6 AS (SELECT *, CAST(least(most, floor(coalesce(target * seats / nullif(sum(target) OVER (), 0), 0) + 0.5)) AS BIGINT) AS first FROM s5),
        s7 AS (SELECT *, CAST(seats - sum(first) OVER () AS BIGINT) AS short FROM s6),
        s8 AS (SELECT *, unnest(range(CASE WHEN short > 0 THEN least(short, most - first) WHEN short < 0 THEN least(-short, first) ELSE 0 END)) AS j FROM s7 WHERE target > 0),
        s9 AS (SELECT key, short, row_number() OVER (ORDER BY CASE WHEN short > 0 THEN target / (2 * (first + j) + 1) ELSE -target / (2 * (first - j) - 1) END DESC, key, j) AS r FROM s8),
        s10 AS (SELECT s7.*, first + coalesce((SELECT sum(sign(s9.short)) FROM s9 WHERE s9.key = s7.key AND r <= abs(s9.short)), 0) AS source_quota FROM s7),
        c1 AS (SELECT key, shard, CAST(sum(size) AS BIGINT) AS cell_size FROM z GROUP BY ALL),
        c2 AS (SELECT c1.*, source_size, target, source_quota AS seats, CAST(ceil(cell_size / 64.0::DOUBLE) AS BIGINT) AS blocks FROM c1 JOIN s10 USING (key)),
        c3 AS (SELECT *, blocks * 2 AS most, CAST(least(blocks * 2, floor(coalesce(cell_size * seats / nullif(sum(cell_size) OVER (PARTITION BY key), 0), 0) + 0.5)) AS BIGINT) AS first FROM c2),
        c4 AS (SELECT *, CAST(seats - sum(first) OVER (PARTITION BY key) AS BIGINT) AS short FROM c3),
        c5 AS (SELECT *, unnest(range(CASE WHEN short > 0 THEN least(short, most - first) WHEN short < 0 THEN least(-short, first) ELSE 0 END)) AS j FROM c4 WHERE cell_size > 0),
        c6 AS (SELECT key, shard, short, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN short > 0 THEN cell_size / (2 * (first + j) + 1) ELSE -cell_size / (2 * (first - j) - 1) END DESC, shard, j) AS r FROM c5),
        c7 AS (SELECT c4.*, CAST(first + coalesce((SELECT sum(sign(c6.short)) FROM c6 WHERE c6.key = c4.key AND c6.shard = c4.shard AND r <= abs(c6.short)), 0) AS BIGINT) AS quota FROM c4),
        c8 AS (SELECT *, least(quota * 64, cell_size * 2) AS wanted, greatest(cell_size, 1) AS length, CAST('0x' || substr(md5('mix|run|' || key || '|' || shard), 1, 8) AS BIGINT) % greatest(blocks, 1) * 64 AS at_ FROM c7),
        c9 AS (SELECT *, wanted // length AS rounds, wanted % length AS rest FROM c8),
        p AS (SELECT z.*, sum(size) OVER (PARTITION BY key, shard ORDER BY draw, id, size ROWS UNBOUNDED PRECEDING) AS end_ FROM z)
        SELECT id AS doc_id, source, size, source_size, target, shard, quota,
          CAST(rounds * size + greatest(0, least(end_, at_ + rest, cell_size) - greatest(end_ - size, at_)) + greatest(0, least(end_, at_ + rest - cell_size) - greatest(end_ - size, 0)) AS BIGINT) AS taken
        FROM p JOIN c9 USING (key, shard)""",
    "op10_url_filter": """
        WITH p AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (
          SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        m AS (
          SELECT page_id, rule_host || rule_path AS rule, verdict,
                 row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS n
          FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.n = 1""",
}
