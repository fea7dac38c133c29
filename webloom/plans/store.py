"""Queries of the store, crawl, scan and event operators over events, orders, pages and documents."""

from __future__ import annotations

import gzip
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.storage import shared_dir
from webloom.functions.vectorized import vectorized
from webloom.operators import assets as M
from webloom.operators import crawl as C
from webloom.plans.tables import sql
from webloom.sources import io as S
from webloom.streaming import events as T

UPSERTS = """SELECT event_id AS ord, 'site' || CAST(user_id % 5 AS STRING) AS site, 'https://a.example.com/u' || CAST(user_id AS STRING) || '.js' AS url,
CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'error' THEN 'failed' ELSE 'candidate' END AS status, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE CASE WHEN user_id % 2 = 0 THEN 'high' ELSE 'low' END END AS confidence,
CASE WHEN event_id % 4 = 0 THEN '' ELSE 'f' || CAST(event_id % 7 AS STRING) END AS from_url, '' AS content_type, 'h' || CAST(event_id % 9 AS STRING) AS hash, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END AS size,
CASE WHEN event_id % 2 = 0 THEN 'unknown_js' ELSE 'entry_js' END AS type, CASE WHEN event_id % 3 = 0 THEN 'regex_candidate' ELSE 'preload' END AS source, CAST(event_id % 6 AS INT) AS depth, 'w' || CAST(event_id % 3 AS STRING) AS framework FROM events"""
#: Links of a ring of pages, four from each page.
LINKS = """SELECT a.page_id AS src, (a.page_id * k.n + k.n + 1) % c.total AS dst, k.n AS ord FROM pages a CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 3 UNION ALL SELECT 5 UNION ALL SELECT 7) k CROSS JOIN (SELECT count(*) AS total FROM pages) c"""
FETCHES = """SELECT 'https://o' || CAST(o_custkey % 40 AS STRING) || '.example.com' AS origin, CAST(o_orderkey % 6 AS INT) AS batch, CAST(o_orderkey % 6 + o_custkey % 2 AS INT) AS depth,
CASE o_orderstatus WHEN 'F' THEN 'js' WHEN 'P' THEN 'non_js' ELSE NULL END AS outcome, CAST(o_custkey % 4 AS INT) AS discovered FROM orders"""
CDP = """SELECT event_id AS seq, ts, 'r' || CAST(user_id AS STRING) AS request_id, CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'response' WHEN 'signup' THEN 'redirect' WHEN 'purchase' THEN 'finished' ELSE 'failed' END AS kind,
'https://api.example.com/' || CAST(event_id AS STRING) AS url, 'GET' AS method, CASE user_id % 4 WHEN 0 THEN 'XHR' WHEN 1 THEN 'Fetch' WHEN 2 THEN 'EventSource' ELSE 'Image' END AS resource_type,
CASE WHEN event_type = 'click' THEN 200 + event_id % 5 ELSE 0 END AS status_code, CASE WHEN event_type = 'click' THEN 'application/json' ELSE '' END AS mime_type FROM events"""


IDLE = """SELECT user_id % 10 AS page, event_id AS request_id, ts, 'start' AS kind FROM events WHERE event_type = 'view'
UNION ALL SELECT user_id % 10, event_id - 1, ts, 'end' FROM events WHERE event_type = 'click'"""


def m1_asset_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merged(sql(spark, sf_dir, UPSERTS, "events"))


def m2_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_status(M.merged(sql(spark, sf_dir, UPSERTS, "events")), "confirmed")


def m3_output_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.output_map(sql(spark, sf_dir, "SELECT 'site' || CAST(user_id % 5 AS STRING) AS site, 'u' || CAST(user_id AS STRING) AS url, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'a\\\\b' || CAST(event_id % 4 AS STRING) END AS path FROM events", "events"))


def m4_c5_prioritized(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT user_id AS k, event_id AS ord, '{0}' AS source FROM events WHERE event_type = '{1}'"
    parts = [sql(spark, sf_dir, text.format(s, t), "events") for s, t in (("network", "view"), ("response", "click"), ("dom", "error"))]
    return M.prioritized(parts, "k").select("k", "ord", "source")


def s15_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT doc_id AS ord, 'js/' || source || '.js' AS path, text AS content FROM documents", "documents")
    return M.artifacts(rows).select("hash", "path")


def u11_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.directories(sql(spark, sf_dir, "SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^http:', 'https:') FROM pages", "pages"))


#: The first page of each origin is where its crawl begins.
ENTRIES = "SELECT regexp_extract(url, '^(https?://[^/]*)', 1) AS origin, CAST(min(page_id) AS STRING) AS url, min(page_id) AS ord FROM pages GROUP BY 1"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LINKS, "pages").select(F.col("src").cast("string").alias("from_url"), F.col("dst").cast("string").alias("url"), "ord", F.lit("high").alias("confidence"), F.lit(True).alias("fetchable"))


def c1_c2_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl at its production depth, from every origin of the table."""
    return C.crawled(sql(spark, sf_dir, ENTRIES, "pages"), _edges(spark, sf_dir)).select("origin", "url", "depth")


def c3_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    entry = sql(spark, sf_dir, "SELECT 'o' AS origin, '0' AS url, 0 AS ord", "pages")
    return C.crawled(entry, edges, max_depth=10, budget=100).agg(F.count(F.lit(1)).alias("attempts"))


def c6_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT 'u' || CAST(o_orderkey AS STRING) AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'f' || CAST(o_orderkey AS STRING) ELSE 'u' || CAST(o_orderkey AS STRING) END AS final_url, CASE WHEN o_orderkey % 4 = 0 THEN 404 ELSE 200 END AS status_code, 'text/js' AS content_type, o_orderkey AS size, 'h' AS hash FROM orders", "orders")
    return C.outcomes(rows)


def c7_not_downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = sql(spark, sf_dir, "SELECT 'c' || CAST(c_custkey AS STRING) AS asset_url FROM customer", "customer")
    done = sql(spark, sf_dir, "SELECT 'c' || CAST(o_custkey AS STRING) AS asset_url FROM orders WHERE o_orderstatus = 'P'", "orders")
    return C.not_downloaded(every, done)


def c8_batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batch_statistics(sql(spark, sf_dir, FETCHES, "orders"))


def c9_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rollup(sql(spark, sf_dir, FETCHES, "orders"))


def c11_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT o_custkey AS run, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 'e' ELSE '' END AS error, o_orderkey % 11 = 0 AS fatal FROM orders", "orders")
    return C.isolated(rows).select("ord", "outcome")


def c12_final_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT s_nationkey AS run, s_name AS origin, CASE WHEN s_suppkey % 3 = 0 THEN 'bad ' || s_name ELSE '' END AS error FROM supplier", "supplier")
    return C.final_errors(rows)


def c13_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT p_partkey, CAST(p_size AS DOUBLE) / 8 AS s FROM part", "part")
    return rows.select("p_partkey", C.elapsed(F.col("s")).alias("elapsed"))


def s2_s3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT page_id AS ord, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^https?://(.*)$', 1) WHEN 1 THEN '//' || url WHEN 2 THEN 'mailto:x' ELSE ' ' || url || ' ' END AS raw FROM pages", "pages")
    return S.entries(rows)


def s1_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages as a list file with blanks, empty lines and comments, read back."""
    lines = sql(spark, sf_dir, "SELECT CASE page_id % 4 WHEN 0 THEN '# ' || url WHEN 1 THEN '  ' || url || ' ' WHEN 2 THEN '' ELSE url END AS line FROM pages", "pages")
    path = f"{shared_dir(spark)}/webloom/list-{uuid.uuid4().hex}"
    S.write_lines(lines, path)
    return S.url_list(spark, path).select("raw")


_GZIP = {"gzip": gzip.compress, "br": lambda b: pa.compress(b, codec="brotli", asbytes=True), "": bytes}


@vectorized("binary")
def _packed(text: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([_GZIP[e]((t or "").encode()) for t, e in zip(text, encoding, strict=True)])


def s6_decoded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bodies of three encodings, decoded up to 4000 bytes."""
    rows = sql(spark, sf_dir, "SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'br' ELSE '' END AS encoding FROM documents", "documents")
    decoded = rows.withColumn("d", S.decompress(4000)(_packed(F.col("text"), F.col("encoding")), F.col("encoding")))
    return decoded.select("doc_id", F.sha2("d.body", 256).alias("hash"), F.col("d.error").alias("error"))


def s14_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/webloom/report-{uuid.uuid4().hex}"
    S.write_report(path, pages=sql(spark, sf_dir, "SELECT page_id, url FROM pages", "pages"))
    return spark.read.schema("page_id long, url string").json(f"{path}/pages.jsonl")


def s17_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of all sites, then those of sites 0 and 1 anew: the others stay."""
    path = f"{shared_dir(spark)}/webloom/sites-{uuid.uuid4().hex}"
    rows = sql(spark, sf_dir, "SELECT 's' || CAST(user_id % 5 AS STRING) AS site, event_id, event_type AS state FROM events", "events")
    S.write_sites(rows, path)
    S.write_sites(rows.where("site IN ('s0', 's1') AND state = 'click'").withColumn("state", F.lit("new")), path)
    return spark.read.schema("event_id long, state string, site string").parquet(path)


def c4_c10_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page of the crawl was found first, in queue order."""
    edges = sql(spark, sf_dir, LINKS, "pages").select(F.col("src").cast("string").alias("from_url"), F.col("dst").cast("string").alias("url"), "ord", F.when(F.col("ord") == 5, "low").when(F.col("ord") == 3, "medium").otherwise("high").alias("confidence"), (F.col("dst") % 13 != 0).alias("fetchable"))
    entry = sql(spark, sf_dir, "SELECT 'o' AS origin, '0' AS url, 0 AS ord", "pages")
    return C.crawled(entry, edges, max_depth=5).select("url", "from_url", "depth", "batch", F.array_join(F.col("ord").cast("array<string>"), ".").alias("ord"))


def m5_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT event_id, event_type, CAST(user_id % 3 AS STRING) AS u FROM events", "events")
    return rows.select("event_id", F.array_join(M.unique(F.array("event_type", "u", "event_type", "u", F.lit("z"))), "|").alias("names"))


def s5_single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.single_flight(sql(spark, sf_dir, "SELECT o_custkey % 9 AS entry_url, o_custkey % 50 AS url, o_orderkey AS ord FROM orders", "orders"))


def s7_s8_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 500 ELSE 200 END AS st, CASE event_id % 3 WHEN 0 THEN 'text/javascript' WHEN 1 THEN '' ELSE 'text/html' END AS ct, CASE event_id % 2 WHEN 0 THEN 'function f(){ return 1 }' ELSE props END AS body FROM events", "events")
    return rows.select("event_id", S.outcome(F.col("st"), F.col("ct"), F.col("body")).alias("outcome"))


def s9_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT page_id, url FROM pages", "pages")
    return rows.select("page_id", S.allowed_redirects(F.array(F.col("url"), F.lit("https://cdn.example.org/x")), ["example.org"], F.col("url")).alias("ok"), S.allowed_redirects(F.array("url"), ["example.org"], F.lit("https://q.example.com/")).alias("own"))


def s12_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.map_lines(sql(spark, sf_dir, "SELECT url, 'p' || CAST(page_id % 3 AS STRING) AS path FROM pages", "pages"))


def s13_endpoint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.endpoint_lines(sql(spark, sf_dir, "SELECT 'https://e.example.com/' || p_brand AS url FROM part", "part"))


def t1_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.requests(T.captured(sql(spark, sf_dir, CDP, "events"))).select("request_id", "redirect_index", "seq", "url", "status_code", "completed", "failed", "redirect_to")


def t2_late_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of click events, told after all hops are known."""
    found = T.requests(T.captured(sql(spark, sf_dir, CDP, "events")))
    bodies = sql(spark, sf_dir, "SELECT 'r' || CAST(user_id AS STRING) AS request_id, 'https://api.example.com/' || CAST(event_id AS STRING) AS url, event_id AS seq, 'b' || CAST(event_id AS STRING) AS body FROM events WHERE event_type = 'click'", "events")
    return T.with_late_bodies(found, bodies).select("request_id", "redirect_index", "body")


def t4_idle_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of ten pages that start at views and end at the next click of the user, or expire."""
    rows = sql(spark, sf_dir, IDLE, "events")
    return T.idle_points(rows, "page").select("page", F.unix_micros("idle_from").alias("idle_from"))


def t3_websockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT event_id AS seq, 'w' || CAST(user_id AS STRING) AS request_id, 'wss://x/' || CAST(event_id AS STRING) AS url, CASE WHEN event_type = 'view' THEN 'ws_created' WHEN event_type = 'click' THEN 'ws_handshake' ELSE 'other' END AS kind, CASE WHEN event_id % 3 = 0 THEN 400 ELSE 101 END AS status_code FROM events", "events")
    return T.websockets(rows)


def t4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.sessions(sql(spark, sf_dir, "SELECT user_id, ts FROM events", "events"), "10 minutes", ("user_id",))
    return found.select("user_id", F.unix_micros("started").alias("started"), "n_events")


def t5_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT event_id AS seq, user_id, CASE WHEN event_type = 'signup' THEN 'stage' ELSE 'event' END AS kind, CASE event_id % 3 WHEN 0 THEN 'scroll' WHEN 1 THEN 'click' ELSE 'settle' END AS stage_name FROM events", "events")
    return T.staged(rows, "user_id").select("seq", "stage")


def t6_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT p_partkey, CAST(p_size AS DOUBLE) AS e FROM part", "part")
    return rows.select("p_partkey", T.phase(F.col("e"), F.lit(40.0)).alias("phase"))


def t8_readable_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'XHR' WHEN 1 THEN 'Fetch' ELSE 'Script' END AS resource_type, CASE o_custkey % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'image/png' ELSE 'text/plain' END AS mime_type, CAST(o_totalprice * 40 AS BIGINT) AS encoded_length, o_orderstatus = 'F' AS failed FROM orders", "orders")
    return T.readable_bodies(rows).select("o_orderkey")


def t9_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.requests(T.captured(sql(spark, sf_dir, CDP, "events")))
    return found.orderBy("seq", "request_id", "redirect_index").select("seq", "request_id", "redirect_index")


def t10_initiators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT event_id, event_type, CAST(user_id % 3 AS STRING) AS u FROM events", "events")
    return rows.select("event_id", F.array_join(T.initiator_urls(F.array(F.array("event_type", "u"), F.array("u", F.lit("")), F.array("event_type"))), "|").alias("urls"))


def t11_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.captured(sql(spark, sf_dir, CDP, "events")).groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


_MERGED = f"""WITH s AS ({UPSERTS}), m AS (SELECT site, url, CASE WHEN bool_or(status = 'confirmed') THEN 'confirmed' ELSE arg_max(status, ord) END AS status, CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE arg_max(confidence, ord) END AS confidence,
coalesce(arg_max(from_url, ord) FILTER (WHERE from_url <> ''), '') AS from_url, '' AS content_type, arg_max(hash, ord) AS hash, CAST(coalesce(arg_max(size, ord) FILTER (WHERE size <> 0), 0) AS BIGINT) AS size,
coalesce(arg_min(type, ord) FILTER (WHERE type <> 'unknown_js'), arg_min(type, ord)) AS type, coalesce(arg_min(source, ord) FILTER (WHERE source <> 'regex_candidate'), arg_min(source, ord)) AS source, min(depth) AS depth, arg_min(framework, ord) AS framework FROM s GROUP BY site, url)"""
_HOPS = f"""WITH e AS ({CDP}), h AS (SELECT *, CAST(sum(CASE WHEN kind = 'redirect' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY seq) AS INTEGER) AS hop FROM e WHERE lower(resource_type) IN ('xhr', 'fetch', 'eventsource')),
r AS (SELECT request_id, hop, min(seq) AS seq, coalesce(arg_max(url, seq) FILTER (WHERE kind = 'response'), arg_min(url, seq)) AS url, CAST(coalesce(arg_max(status_code, seq) FILTER (WHERE kind = 'response'), 0) AS BIGINT) AS status_code,
bool_or(kind IN ('finished', 'failed')) AS ended, bool_or(kind = 'failed') AS failed, bool_or(kind IN ('sent', 'redirect')) AS begun FROM h GROUP BY request_id, hop),
q AS (SELECT *, coalesce(lead(url) OVER (PARTITION BY request_id ORDER BY hop), '') AS redirect_to FROM r WHERE begun)"""
_CRAWL = f"""WITH RECURSIVE l AS ({LINKS}), w(url, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN l ON src = url WHERE depth < @depth)"""
ORACLES = {
    "s1_url_list": "SELECT url AS raw FROM pages WHERE page_id % 4 IN (1, 3)",
    "s6_decoded_bodies": "SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 4000 THEN sha256(text) END AS hash, CASE WHEN octet_length(encode(text)) <= 4000 THEN '' ELSE 'too large' END AS error FROM documents",
    "s14_report": "SELECT page_id, url FROM pages",
    "s17_sites": "SELECT 's' || CAST(user_id % 5 AS VARCHAR) AS site, event_id, CASE WHEN user_id % 5 < 2 THEN 'new' ELSE event_type END AS state FROM events WHERE user_id % 5 > 1 OR event_type = 'click'",
    "c4_c10_queue": f"""WITH RECURSIVE l AS ({LINKS}), w(url, from_url, depth, path) AS (SELECT 0::BIGINT, '', 0, [0::BIGINT] UNION ALL
SELECT dst, CAST(src AS VARCHAR), depth + 1, list_append(path, CAST(ord AS BIGINT)) FROM w JOIN l ON src = url WHERE depth < 5 AND ord <> 5 AND dst % 13 <> 0),
m AS (SELECT *, min(depth) OVER (PARTITION BY url) AS least FROM w)
SELECT CAST(url AS VARCHAR) AS url, arg_min(from_url, path) AS from_url, CAST(min(depth) AS INTEGER) AS depth, CAST(min(depth) AS INTEGER) AS batch, array_to_string(min(path), '.') AS ord FROM m WHERE depth = least GROUP BY url""",
    "m5_unique": "SELECT event_id, event_type || '|' || CAST(user_id % 3 AS VARCHAR) || '|z' AS names FROM events",
    "t2_late_bodies": f"""{_HOPS} SELECT q.request_id, q.hop AS redirect_index, CASE WHEN q.hop = max(q.hop) OVER (PARTITION BY q.request_id) THEN 'b' || CAST(b.event_id AS VARCHAR) END AS body
FROM q LEFT JOIN events b ON b.event_type = 'click' AND q.request_id = 'r' || CAST(b.user_id AS VARCHAR) AND q.url = 'https://api.example.com/' || CAST(b.event_id AS VARCHAR)""",
    "t4_idle_points": f"""WITH e AS ({IDLE}), c AS (SELECT page, request_id, min(ts) AS ts FROM (SELECT page, request_id, ts FROM e WHERE kind = 'end' UNION ALL SELECT page, request_id, ts + INTERVAL 5 SECONDS FROM e WHERE kind = 'start') t GROUP BY page, request_id),
s AS (SELECT page, request_id, ts, 1 AS step FROM e WHERE kind = 'start' UNION ALL SELECT page, request_id, ts, -1 FROM c),
o AS (SELECT *, sum(step) OVER w AS held, lead(ts) OVER (PARTITION BY page ORDER BY ts, step, request_id) AS later FROM s WINDOW w AS (PARTITION BY page ORDER BY ts, step, request_id ROWS UNBOUNDED PRECEDING))
SELECT page, epoch_us(ts) AS idle_from FROM o WHERE held = 0 AND (later IS NULL OR epoch_ms(later) - epoch_ms(ts) >= 750)""",
    "m1_asset_upserts": f"{_MERGED} SELECT * FROM m",
    "m2_confirmed": f"{_MERGED} SELECT site, url FROM m WHERE status = 'confirmed'",
    "m3_output_map": "SELECT DISTINCT 'site' || CAST(user_id % 5 AS VARCHAR) AS site, 'u' || CAST(user_id AS VARCHAR) AS url, 'a/b' || CAST(event_id % 4 AS VARCHAR) AS path FROM events WHERE event_id % 3 <> 0",
    "m4_c5_prioritized": """WITH u AS (SELECT user_id AS k, event_id AS ord, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 END AS p FROM events WHERE event_type IN ('view', 'click', 'error'))
SELECT k, ord, ['network', 'response', 'dom'][p + 1] AS source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, ord) AS n FROM u) t WHERE n = 1""",
    "s15_artifacts": """WITH f AS (SELECT sha256(text) AS hash, min(doc_id) AS ord, 'js/' || arg_min(source, doc_id) || '.js' AS path FROM documents GROUP BY 1)
SELECT hash, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY ord) > 1 THEN regexp_replace(path, '[.]js$', '') || '-' || substr(hash, 1, 8) || '.js' ELSE path END AS path FROM f""",
    "u11_directories": """WITH o AS (SELECT DISTINCT regexp_extract(u, '^(https?://[^/]*)', 1) AS origin FROM (SELECT url AS u FROM pages UNION ALL SELECT regexp_replace(url, '^http:', 'https:') FROM pages) t),
b AS (SELECT origin, regexp_replace(regexp_extract(origin, '//(.*)$', 1), '[^a-z0-9_-]', '_', 'g') AS base FROM o)
SELECT origin, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '_' || substr(sha256(origin), 1, 8) ELSE base END AS directory FROM b""",
    "c1_c2_crawl": f"""WITH RECURSIVE l AS MATERIALIZED ({LINKS}), e AS ({ENTRIES}), w(origin, url, depth) AS (SELECT origin, ord, 0 FROM e UNION SELECT origin, dst, depth + 1 FROM w JOIN l ON src = url WHERE depth < 10)
SELECT origin, CAST(url AS VARCHAR) AS url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY origin, url""",
    "c3_budget": f"{_CRAWL.replace("@depth", "10")} SELECT least(100, count(DISTINCT url)) AS attempts FROM w",
    "c6_outcomes": """WITH u AS (SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['u', 'f'] ELSE ['u'] END) AS p FROM orders)
SELECT p || CAST(k AS VARCHAR) AS asset_url, CASE WHEN k % 4 = 0 THEN 'failed' ELSE 'confirmed' END AS status, CASE WHEN k % 4 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN k % 4 = 0 THEN '' ELSE 'text/js' END AS content_type,
CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS size, CASE WHEN k % 4 = 0 THEN '' ELSE 'h' END AS hash FROM u""",
    "c7_not_downloaded": "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS asset_url, 'candidate' AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "c8_batch_statistics": f"""WITH f AS ({FETCHES}), g AS (SELECT origin, batch, min(depth) AS min_depth, max(depth) AS max_depth, count(*) AS attempted, count(*) FILTER (WHERE outcome = 'js') AS js, count(*) FILTER (WHERE outcome = 'non_js') AS non_js,
count(*) FILTER (WHERE outcome IS NULL) AS failed, CAST(sum(discovered) AS BIGINT) AS discovered FROM f GROUP BY origin, batch)
SELECT *, coalesce(lead(attempted) OVER w, 0) AS next, CAST(sum(js) OVER (PARTITION BY origin ORDER BY batch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM g WINDOW w AS (PARTITION BY origin ORDER BY batch)""",
    "c9_rollup": f"WITH f AS ({FETCHES}) SELECT origin, count(*) AS attempted, count(*) FILTER (WHERE outcome = 'js') AS js, count(*) FILTER (WHERE outcome = 'non_js') AS non_js, count(*) FILTER (WHERE outcome IS NULL) AS failed FROM f GROUP BY ROLLUP (origin)",
    "c11_isolated": """SELECT o_orderkey AS ord, CASE WHEN coalesce(max(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'failure' ELSE 'success' END AS outcome FROM orders""",
    "c12_final_errors": "SELECT s_nationkey AS run, string_agg('bad ' || s_name, chr(10) ORDER BY s_name) AS errors FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY s_nationkey",
    "c13_elapsed": "SELECT p_partkey, CASE WHEN p_size < 8 THEN CAST(CAST(round(p_size / 8 * 1000) AS BIGINT) AS VARCHAR) || 'ms' ELSE printf('%.1fs', round(p_size / 8, 1)) END AS elapsed FROM part",
    "s2_s3_entries": """SELECT u AS url, min(page_id) AS ord FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://' || regexp_extract(url, '^https?://(.*)$', 1) WHEN 3 THEN url END AS u FROM pages) t WHERE u IS NOT NULL GROUP BY u""",
    "s5_single_flight": "SELECT o_custkey % 9 AS entry_url, o_custkey % 50 AS url, min(o_orderkey) AS ord, count(*) AS waiting FROM orders GROUP BY 1, 2",
    "s7_s8_outcome": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 = 0 OR event_id % 3 = 1 AND event_id % 2 = 0 THEN 'js' ELSE 'non_js' END AS outcome FROM events",
    "s9_redirects": "SELECT page_id, TRUE AS ok, regexp_matches(url, '^https://q[.]example[.]com(/|$)') OR regexp_matches(url, '^https?://([^/]*[.])?example[.]org(/|$)') AS own FROM pages",
    "s12_map_lines": "SELECT DISTINCT url || chr(9) || 'p' || CAST(page_id % 3 AS VARCHAR) AS line FROM pages",
    "s13_endpoint_lines": "SELECT DISTINCT 'https://e.example.com/' || p_brand AS url FROM part",
    "t1_requests": f"{_HOPS} SELECT request_id, hop AS redirect_index, seq, url, status_code, ended OR redirect_to <> '' AS completed, failed, redirect_to FROM q",
    "t3_websockets": """SELECT 'w' || CAST(user_id AS VARCHAR) AS request_id, 'wss://x/' || CAST(min(event_id) AS VARCHAR) AS url, bool_or(event_type = 'click' AND event_id % 3 = 0) AS failed FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id""",
    "t4_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTES THEN 1 ELSE 0 END AS cut FROM events), b AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n_events FROM b GROUP BY user_id, s""",
    "t5_stages": """SELECT event_id AS seq, coalesce(last_value(CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'scroll' WHEN 1 THEN 'click' ELSE 'settle' END END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'navigate') AS stage FROM events""",
    "t6_phases": "SELECT p_partkey, CASE WHEN p_size < 20 THEN 'navigate' WHEN p_size < 28 THEN 'scroll' WHEN p_size < 38 THEN 'click' WHEN p_size < 40 THEN 'settle' ELSE 'over' END AS phase FROM part",
    "t8_readable_bodies": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 < 2 AND o_custkey % 3 <> 1 AND CAST(trunc(o_totalprice * 40) AS BIGINT) <= 8388608 AND o_orderstatus <> 'F'",
    "t9_snapshot": f"{_HOPS} SELECT seq, request_id, hop AS redirect_index FROM q",
    "t10_initiators": "SELECT event_id, event_type || '|' || CAST(user_id % 3 AS VARCHAR) AS urls FROM events",
    "t11_captured": f"WITH e AS ({CDP}) SELECT resource_type, count(*) AS n FROM e WHERE resource_type <> 'Image' GROUP BY resource_type",
}

QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "mcstu" and k[1:2].isdigit() and callable(f)}
