"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontaminate, jaccard_join, pieces, pii, quality, secret_scan, suffix_dedup, token_counts, url_filter, warc
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op1_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.near_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.lookup(warc.write(pages), pages, nulls=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.verdicts(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.joined(F.col("all_spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_warc, op3_pii, op4_pieces, op5_jaccard_join, op6_suffix_dedup, op7_quality, op8_url_filter, op9_token_counts, op10_secret_scan, op1_proximity)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        w AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS g
              FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS s FROM b WHERE len(ws) > 0)),
        p AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS g
              FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
        m AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.g = w.g),
        h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS x FROM m) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op2_warc": """
        SELECT page_id, url, octet_length(p) AS payload_bytes, d AS payload_digest,
               CASE WHEN octet_length(p) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN octet_length(p) >= 100 AND page_id <> first THEN first END AS refers_to
        FROM (SELECT *, min(page_id) OVER (PARTITION BY d) AS first
              FROM (SELECT page_id, url, encode(coalesce(html, '')) AS p, sha256(encode(coalesce(html, ''))) AS d FROM pages))""",
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS k FROM w WHERE len(ws) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * m >= 4 * (p.n + q.n - m)),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
        SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links
        FROM documents d""",
    "op6_suffix_dedup": """
        WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        w AS MATERIALIZED (SELECT doc_id, s, sha256(array_slice(b, s + 1, s + 400)) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400)),
        r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
        i AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS cut FROM r),
        g AS (SELECT doc_id, s, sum(cut) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM i),
        x AS MATERIALIZED (SELECT doc_id, min(s) AS a, max(s) + 400 AS z FROM g GROUP BY doc_id, k),
        f AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p, a AS q FROM x UNION ALL SELECT d.doc_id, coalesce(max(z), 0), any_value(n) FROM d LEFT JOIN x ON d.doc_id = x.doc_id GROUP BY d.doc_id),
        k AS (SELECT f.doc_id, string_agg(CASE WHEN q > p THEN hex(array_slice(b, p + 1, q)) ELSE '' END, '' ORDER BY p) AS kept FROM f JOIN d ON f.doc_id = d.doc_id GROUP BY f.doc_id)
        SELECT d.doc_id, n AS n_bytes, CAST(coalesce(t.m, 0) AS BIGINT) AS n_removed, coalesce(t.c, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d JOIN k ON d.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, sum(z - a) AS m, count(*) AS c FROM x GROUP BY doc_id) t ON d.doc_id = t.doc_id""",
    "op8_url_filter": """
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                             WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                             WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                             WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
              FROM (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages))""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
