"""Queries of the URL and request functions over page URLs, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import requests as R
from webloom.functions import urls as U
from webloom.plans.tables import sql

PAGES = "SELECT page_id, url FROM pages"
#: Hosts in upper case, with ports, user names, and some that are no origin.
VARIED = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '://([^/]*)', '://u@\\1:0443') WHEN 2 THEN ' ' || upper(regexp_extract(url, '^([a-z]+://[^/]*)', 1)) || ':8080/x'
WHEN 3 THEN replace(url, 'http', 'ftp') WHEN 4 THEN regexp_replace(url, '://([^/]*)', '://\\1:99999') ELSE url || '&z=1' END AS url FROM pages"""
SPARK_VARIED = VARIED.replace("\\\\1", "$1").replace("\\1", "$1")


def pages(spark: SparkSession, sf_dir: str, text: str = PAGES) -> DataFrame:
    return sql(spark, sf_dir, text, "pages")


def u1_canonical_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir, SPARK_VARIED).select("page_id", U.origin(F.col("url")).alias("origin"))


def u1_origin_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir, SPARK_VARIED).select("page_id", U.origin_any(F.col("url")).alias("origin"))


def u2_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = pages(spark, sf_dir).select("page_id", "url", F.explode(F.array(*map(F.lit, ("a.js", "./b/../c.js", "/d/e.js?x=1#f", "//cdn.example.org/g.js", "../h.js", "https://z.example.com/i.js#j")))).alias("ref"))
    return refs.select("page_id", "ref", U.joined(F.col("url"), F.col("ref")).alias("resolved"))


def u3_same_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.same_origin(F.col("url"), F.lit("https://m.example.com")).alias("same"), U.host_port(F.col("url")).alias("host"))


def u4_allowed_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.allowed_domain(F.col("url"), ["https://example.com:8443/", ".example.org."], F.lit("http://x.example.net/")).alias("allowed"))


def u5_u6_u7_url_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.without_fragment(url).alias("plain"), U.is_js_path(url).alias("is_js"), U.worth_fetching(url, F.lit(True)).alias("dynamic"), U.worth_fetching(url, F.lit(False)).alias("static"))


def u8_js_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = sql(spark, sf_dir, "SELECT event_id, CASE event_type WHEN 'view' THEN ' Text/JavaScript ; charset=utf-8' WHEN 'click' THEN 'application/json' WHEN 'error' THEN '' WHEN 'signup' THEN 'text/js' ELSE 'text/html' END AS ct FROM events", "events")
    return kinds.groupBy(U.is_js_type(F.col("ct")).alias("is_js")).agg(F.count(F.lit(1)).alias("n"))


def u9_clean_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(' "'), F.replace(F.regexp_replace(F.col("url"), "#.*", ""), F.lit("/"), F.lit("\\/")), F.lit('" '))
    return pages(spark, sf_dir).select("page_id", U.unescaped(raw).alias("clean"))


def u10_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.host_name_of_directory(F.col("url")).alias("directory"), U.artifact_name(F.col("url")).alias("artifact"), U.file_name(F.col("url")).alias("file"))


def u12_query_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = pages(spark, sf_dir).select("page_id", F.explode(R.query_parameters(F.col("url"))).alias("p"))
    return each.select("page_id", "p.name", "p.value")


def u13_u14_json_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = sql(spark, sf_dir, "SELECT event_id, props FROM events", "events")
    each = body.select("event_id", F.explode(R.parsed_body(F.lit("application/json"), F.col("props"))["params"]).alias("p"))
    return each.select("event_id", "p.name", "p.value")


def u15_graphql(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT event_id, '{\"query\":\"query Q' || CAST(event_id % 5 AS STRING) || ' { a { b } }\",\"operationName\":\"Q' || CAST(event_id % 5 AS STRING) || '\",\"variables\":' || props || '}' AS body FROM events", "events")
    parsed = rows.select("event_id", R.parsed_body(F.lit("application/graphql+json"), F.col("body")).alias("p"))
    return parsed.select("event_id", "p.graphql", F.array_join(F.transform("p.params", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "&").alias("params"))


def u17_multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "'--b\r\nContent-Disposition: form-data; name=\"f' || CAST(event_id % 3 AS STRING) || '\"; filename=\"x\"\r\n\r\nq\r\n--b\r\nContent-Disposition: form-data; name=\"t\"\r\n\r\nv\r\n--b--\r\n'"
    rows = sql(spark, sf_dir, f"SELECT event_id, {body} AS body FROM events", "events")
    each = rows.select("event_id", F.explode(R.parsed_body(F.lit("multipart/form-data; boundary=b"), F.col("body"))["params"]).alias("p"))
    return each.select("event_id", "p.name", "p.value")


def u16_form_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = sql(spark, sf_dir, "SELECT o_orderkey, 'status=' || o_orderstatus || '&cust=' || CAST(o_custkey AS STRING) AS body FROM orders", "orders")
    each = body.select("o_orderkey", F.explode(R.pairs(F.col("body"))).alias("p"))
    return each.select("o_orderkey", "p.name", "p.value")


def u18_cut_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT doc_id, text FROM documents", "documents")
    return rows.select("doc_id", R.cut_value(F.col("text")).alias("value"))


def u20_http_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = sql(spark, sf_dir, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'axios.get' WHEN 1 THEN 'http.postJson' WHEN 2 THEN 'getter' WHEN 3 THEN 'api.delete_request' WHEN 4 THEN 'fetch' ELSE '$.PUT' END AS call, CASE WHEN event_id % 7 = 0 THEN ' patch ' ELSE '' END AS method FROM events", "events")
    return calls.select("event_id", R.http_method(F.col("method"), F.col("call")).alias("method"))


def u21_endpoint_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", R.is_endpoint_candidate(F.regexp_extract("url", r"^https?://[^/]*(/.*)$", 1), F.lit("string")).alias("is_candidate"))


def u22_dangerous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Purchase now' WHEN 'error' THEN 'Log Out' ELSE 'More' END AS label, '/x' AS href FROM events", "events")
    return rows.groupBy(R.is_dangerous(F.col("label"), F.col("href")).alias("dangerous")).agg(F.count(F.lit(1)).alias("n"))


def u23_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.array_join(U.static_segments(F.concat(F.lit("../."), F.regexp_extract("url", r"^https?://[^/]*(/.*)$", 1))), "|").alias("segments"))


def u24_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT o_orderkey, 'X-Status=' || o_orderstatus || ';X-Cust=' || CAST(o_custkey AS STRING) AS line FROM orders", "orders")
    return rows.select("o_orderkey", F.element_at(R.header_map(F.col("line")), "X-Cust").alias("x_cust"))


_PATH = "regexp_extract(url, '^https?://[^/]*([^?#]*)', 1)"
ORACLES = {
    "u1_canonical_origin": f"""WITH v AS ({VARIED}), w AS (SELECT page_id, lower(trim(url)) AS u FROM v), x AS (SELECT page_id, regexp_extract(u, '^([a-z]+)://', 1) AS s, regexp_extract(u, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1) AS h,
TRY_CAST(regexp_extract(u, '^[a-z]+://[^/?#]*:([0-9]+)', 1) AS INTEGER) AS p FROM w)
SELECT page_id, CASE WHEN s NOT IN ('http', 'https') OR p > 65535 THEN NULL WHEN p IS NULL OR (s = 'http' AND p = 80) OR (s = 'https' AND p = 443) THEN s || '://' || h ELSE s || '://' || h || ':' || CAST(p AS VARCHAR) END AS origin FROM x""",
    "u2_resolve": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) AS root, regexp_extract(url, '^(https?):', 1) AS s, regexp_replace({_PATH}, '[^/]*$', '') AS d FROM pages)
SELECT page_id, ref, CASE ref WHEN 'a.js' THEN root || d || ref WHEN './b/../c.js' THEN root || d || 'c.js' WHEN '/d/e.js?x=1#f' THEN root || '/d/e.js?x=1' WHEN '//cdn.example.org/g.js' THEN s || ':' || ref
WHEN '../h.js' THEN root || regexp_replace(d, '[^/]*/$', '') || 'h.js' ELSE 'https://z.example.com/i.js' END AS resolved FROM p, (SELECT unnest(['a.js', './b/../c.js', '/d/e.js?x=1#f', '//cdn.example.org/g.js', '../h.js', 'https://z.example.com/i.js#j']) AS ref) r""",
    "u3_same_origin": "SELECT page_id, regexp_matches(url, '^https://m[.]example[.]com(/|$)') AS same, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages",
    "u4_allowed_domain": "SELECT page_id, regexp_matches(url, '^https?://([^/]*[.])?example[.](com|org)(/|$)') OR regexp_matches(url, '^http://x[.]example[.]net(/|$)') AS allowed FROM pages",
    "u5_u6_u7_url_tests": f"""SELECT page_id, regexp_replace(url, '#.*$', '') AS plain, regexp_matches(lower({_PATH}), '[.]m?js$') OR regexp_matches(lower(regexp_extract(url, '[?]([^#]*)', 1)), 'chunk|module') AS is_js,
NOT (regexp_matches(lower(url), '[.](css|html|htm|xml|svg|png|jpg|gif|woff|woff2)$') OR contains(lower(url), '.css?') OR ends_with(lower(url), '.json')) AS dynamic,
regexp_matches(lower({_PATH}), '[.]m?js$') OR regexp_matches(lower(regexp_extract(url, '[?]([^#]*)', 1)), 'chunk|module') AS static FROM pages""",
    "u8_js_content_type": "SELECT event_type IN ('view', 'signup') AS is_js, count(*) AS n FROM events GROUP BY 1",
    "u9_clean_url": "SELECT page_id, regexp_replace(url, '#.*', '') AS clean FROM pages",
    "u10_names": f"""WITH p AS (SELECT page_id, url, regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1) AS last, {_PATH} AS path, regexp_extract(url, '([?][^#]*)', 1) AS q FROM pages)
SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '[^a-z0-9_-]', '_', 'g') AS directory,
regexp_replace(last, '[.][^.]*$', '') || '-' || substr(sha256(url), 1, 8) || CASE WHEN regexp_extract(last, '([.][^.]*)$', 1) = '' THEN '.js' ELSE regexp_extract(last, '([.][^.]*)$', 1) END AS artifact,
regexp_replace(substr(regexp_replace(path || CASE WHEN q IN ('', '?') THEN '' ELSE q END, '[/:?&= ]', '_', 'g'), 1, 200), '^_', '') AS file FROM p""",
    "u12_query_parameters": "SELECT page_id, regexp_extract(p, '^([^=]*)', 1) AS name, regexp_extract(p, '=(.*)$', 1) AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS p FROM pages) t WHERE p <> ''",
    "u13_u14_json_parameters": "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events",
    "u15_graphql": "SELECT event_id, 'Q' || CAST(event_id % 5 AS VARCHAR) AS graphql, 'operationName=Q' || CAST(event_id % 5 AS VARCHAR) || '&variables.k=' || json_extract_string(props, '$.k') AS params FROM events",
    "u17_multipart": "SELECT event_id, 'f' || CAST(event_id % 3 AS VARCHAR) AS name, '[FILE]' AS value FROM events UNION ALL SELECT event_id, 't', '' FROM events",
    "u16_form_parameters": "SELECT o_orderkey, 'status' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'cust', CAST(o_custkey AS VARCHAR) FROM orders",
    "u20_http_method": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'PATCH' ELSE CASE event_id % 6 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 3 THEN 'DELETE' WHEN 5 THEN 'PUT' ELSE '' END END AS method FROM events",
    "u21_endpoint_candidate": "SELECT page_id, regexp_matches(regexp_extract(url, '^https?://[^/]*(/.*)$', 1), '^/[^ \"'']*$') AS is_candidate FROM pages",
    "u22_dangerous": "SELECT event_type IN ('purchase', 'error') AS dangerous, count(*) AS n FROM events GROUP BY 1",
    "u23_segments": f"SELECT page_id, array_to_string(list_filter(string_split({_PATH}, '/'), lambda s: s NOT IN ('', '.', '..')), '|') AS segments FROM pages",
    "u24_headers": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS x_cust FROM orders",
}
_CUTS = ", ".join(f"TRY(decode(array_slice(encode(text), 1, {128 - k})))" for k in range(4))
ORACLES["u18_cut_values"] = f"SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 128 THEN text ELSE coalesce({_CUTS}) END AS value FROM documents"
ORACLES["u1_origin_any"] = ORACLES["u1_canonical_origin"]

QUERIES = {k: f for k, f in list(globals().items()) if k[:1] == "u" and k[1:2].isdigit() and callable(f)}
