"""Queries of the HTML and source-map operators over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import html as H
from webloom.operators import sourcemap as P
from webloom.plans.tables import sql
from webloom.sources import io as S

HTML = """SELECT page_id, 'https://h' || CAST(page_id % 40 AS STRING) || '.example.com/d/p' || CAST(page_id AS STRING) || '.html' AS url,
'<html><head>' || CASE WHEN page_id % 3 = 0 THEN '<base href="/base/"><base href="/other/">' ELSE '' END ||
'<script src="app.js?a=1&amp;b=2"></script><script SRC="app.js?a=1&amp;b=2"></script><script type="module" src="./m.js"></script><script type="module">import x from "./in.js"; var s="</p>", t="/assets/q.js";</script>' ||
'<link rel="Preload stylesheet" as="script" href="/pre.js"><link rel="preload" as="style" href="/no.css"><link rel="modulepreload" href="mp.js"><link rel="prefetch" href="/pf' || CAST(page_id AS STRING) || '.js"></head>' ||
'<body data-src="x.js">' || CASE WHEN page_id % 2 = 0 THEN '<script>load("/static/z.js")</script>' ELSE '' END || '</body></html>' AS html FROM pages"""
_BASE = "CASE WHEN page_id % 3 = 0 THEN root || '/base/' ELSE root || '/d/' END"
_ROWS = f"WITH h AS ({HTML}), b AS (SELECT page_id, url, regexp_extract(url, '^(https://[^/]*)', 1) AS root FROM h), c AS (SELECT *, {_BASE} AS base FROM b)"


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, HTML, "pages")


def h1_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the real pages, counted by page and name."""
    found = H.tags(sql(spark, sf_dir, "SELECT url, html FROM pages", "pages"))
    return found.groupBy("url", "name").agg(F.count(F.lit(1)).alias("n"))


def h1_script_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.tags(sql(spark, sf_dir, "SELECT url, html FROM pages", "pages"))
    return found.where("name = 'script' and body <> ''").select("url", "body")


def h2_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.bases(H.tags(made(spark, sf_dir)))


def h3_h4_h5_entry_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.entry_assets(H.tags(made(spark, sf_dir))).select("url", "asset_url", "source", "confidence")


def h6_module_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.tags(made(spark, sf_dir))
    return H.module_scripts(found).join(H.inline_modules(found), "url").select("url", "asset_url", "has_inline_module")


def h7_h8_rendered_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rendered_assets(made(spark, sf_dir), []).select("url", "asset_url", "source", "confidence")


MAP = """SELECT doc_id, 'https://m.example.com/b' || CAST(doc_id AS STRING) || '.js' AS url, n_chars AS size, CASE WHEN doc_id % 2 = 0 THEN 'webpack://app/./src/../src/f' || CAST(doc_id AS STRING) || '.ts?x' ELSE '/node_modules/x.js' END AS name, text FROM documents"""


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, MAP, "documents")
    made_ = F.to_json(F.struct(F.lit(3).alias("version"), F.array("name", F.lit("src/empty.js")).alias("sources"), F.array("text", F.lit("")).alias("sourcesContent")))
    return rows.select("url", made_.alias("map_text"))


def p3_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flattened(_maps(spark, sf_dir)).select("url", "pos", "name", F.sha2("content", 256).alias("content_hash"), "complete")


def p4_application_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, MAP, "documents").select("doc_id", P.application_path(F.col("name")).alias("path"))


def p5_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps with empty sources, with none of the application, whole ones, and ones beyond the cap of files."""
    rows = sql(spark, sf_dir, MAP, "documents")
    many = F.sequence(F.lit(0), F.lit(599))
    names = F.when(F.col("doc_id") % 100 == 4, F.transform(many, lambda k: F.concat(F.lit("src/f"), k.cast("string"), F.lit(".js")))).when(F.col("doc_id") % 4 < 2, F.array("name", F.lit("src/empty.js"))).otherwise(F.array(F.lit("src/a.ts"), F.lit("src/b.js")))
    texts = F.when(F.col("doc_id") % 100 == 4, F.transform(many, lambda k: F.when(k < 10, "").otherwise("xy"))).when(F.col("doc_id") % 4 < 2, F.array("text", F.lit(""))).otherwise(F.array("text", F.lit("b")))
    made_ = F.to_json(F.struct(F.lit(3).alias("version"), names.alias("sources"), texts.alias("sourcesContent")))
    return P.recoveries(P.flattened(rows.select("url", made_.alias("map_text"))))


def p6_analysis_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.to_json(F.struct(F.lit(3).alias("version"), F.array("name").alias("sources"), F.array("text").alias("sourcesContent")))
    rows = sql(spark, sf_dir, MAP, "documents")
    units = P.analysis_units(rows.select("url", F.lit("bundle").alias("body")), P.flattened(rows.select("url", whole.alias("map_text"))))
    return units.select("bundle", "source_name", F.sha2("body", 256).alias("body_hash"))


def j25_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.summaries(_maps(spark, sf_dir))


def s11_with_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, MAP, "documents")
    bundles = rows.select("url", F.when(F.col("doc_id") % 3 == 0, F.concat("url", F.lit(".own.map"))).otherwise("").alias("map_url"))
    served = rows.select(F.concat("url", F.when(F.col("doc_id") % 3 == 0, ".own.map").otherwise(".map")).alias("map_url"), F.when(F.col("doc_id") % 5 == 0, 404).otherwise(200).alias("status_code"), F.lit("m").alias("map_text"))
    return S.with_maps(bundles, served).select("url", "map_url", "map_text")


def p1_s11_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('var s="//# sourceMappingURL=no.map";\n//# sourceMappingURL=b'), F.col("doc_id").cast("string"), F.lit(".js.map\n"))
    return sql(spark, sf_dir, MAP, "documents").select("doc_id", P.map_reference(body).alias("reference"), P.adjacent_map(F.concat("url", F.lit("?v=1"))).alias("adjacent"))


def p2_data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("data:application/json;base64,"), F.base64(F.encode("text", "utf-8")))
    return sql(spark, sf_dir, MAP, "documents").select("doc_id", F.sha2(P.decode_data_url(value), 256).alias("hash"))


def p7_p8_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('var a = "x" + "y'), F.col("doc_id").cast("string"), F.lit('" + "z"; if (false) { b(1); } else { c(2); } d = true ? e(1, 2) : [3]; f(false ? g : "h" + "i");'))
    return sql(spark, sf_dir, MAP, "documents").select("doc_id", P.fold(body).alias("code"))


_MAPS = f"WITH m AS ({MAP})"
ORACLES = {
    "h1_tags": r"""SELECT url, name, count(*) AS n FROM (SELECT url, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)([^>]*)>.*?</(script|style)>', '<\1\2>', 'g'), '<([a-z][a-z0-9]*)', 1)) AS name FROM pages) t GROUP BY url, name""",
    "h1_script_bodies": "SELECT url, b AS body FROM (SELECT url, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS b FROM pages) t WHERE b <> ''",
    "h2_bases": f"{_ROWS} SELECT url, CASE WHEN page_id % 3 = 0 THEN base ELSE url END AS base FROM c",
    "h3_h4_h5_entry_assets": f"""{_ROWS} SELECT url, base || 'app.js?a=1&b=2' AS asset_url, 'html_script' AS source, 'high' AS confidence FROM c UNION ALL SELECT url, base || 'm.js', 'html_script', 'high' FROM c
UNION ALL SELECT url, base || 'in.js', 'inline_script', 'medium' FROM c UNION ALL SELECT url, root || '/assets/q.js', 'inline_script', 'medium' FROM c UNION ALL SELECT url, root || '/pre.js', 'preload', 'medium' FROM c
UNION ALL SELECT url, base || 'mp.js', 'modulepreload', 'medium' FROM c UNION ALL SELECT url, root || '/pf' || CAST(page_id AS VARCHAR) || '.js', 'prefetch', 'low' FROM c UNION ALL SELECT url, root || '/static/z.js', 'inline_script', 'medium' FROM c WHERE page_id % 2 = 0""",
    "h6_module_scripts": f"{_ROWS} SELECT url, base || 'm.js' AS asset_url, TRUE AS has_inline_module FROM c",
    "h7_h8_rendered_assets": f"""{_ROWS} SELECT url, root || '/d/' || f AS asset_url, 'headless_dom' AS source, c AS confidence FROM c, (VALUES ('app.js?a=1&amp;b=2', 'high'), ('m.js', 'high'), ('mp.js', 'medium')) v(f, c)""",
    "p3_flattened": f"{_MAPS} SELECT url, CAST(0 AS BIGINT) AS pos, name, sha256(text) AS content_hash, TRUE AS complete FROM m UNION ALL SELECT url, 1, 'src/empty.js', sha256(''), TRUE FROM m",
    "p4_application_paths": f"{_MAPS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'src/f' || CAST(doc_id AS VARCHAR) || '.ts' ELSE '' END AS path FROM m",
    "p5_recoveries": f"""{_MAPS}, k AS (SELECT url, CASE WHEN doc_id % 100 = 4 THEN 'many' WHEN doc_id % 4 = 0 THEN 'empty' WHEN doc_id % 4 = 1 THEN 'none' ELSE 'whole' END AS k, octet_length(encode(text)) AS n FROM m)
SELECT url, CAST(CASE k WHEN 'many' THEN 600 WHEN 'none' THEN 1 ELSE 2 END AS BIGINT) AS source_count, CAST(CASE k WHEN 'many' THEN 1180 WHEN 'none' THEN 0 WHEN 'empty' THEN n ELSE n + 1 END AS BIGINT) AS content_size, k = 'whole' AS complete,
CASE WHEN k = 'none' THEN 'no_application_sources' ELSE 'used' END AS status FROM k""",
    "p6_analysis_units": f"{_MAPS} SELECT url AS bundle, CASE WHEN doc_id % 2 = 0 THEN 'src/f' || CAST(doc_id AS VARCHAR) || '.ts' ELSE url END AS source_name, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256('bundle') END AS body_hash FROM m",
    "p1_s11_references": f"{_MAPS} SELECT doc_id, 'b' || CAST(doc_id AS VARCHAR) || '.js.map' AS reference, url || '.map?v=1' AS adjacent FROM m",
    "j25_summaries": f"{_MAPS} SELECT url, 'parsed' AS status, CAST(2 AS BIGINT) AS source_count, text <> '' AS has_sources_content FROM m",
    "s11_with_maps": f"{_MAPS} SELECT url, url || CASE WHEN doc_id % 3 = 0 THEN '.own.map' ELSE '.map' END AS map_url, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'm' END AS map_text FROM m",
    "p2_data_urls": f"{_MAPS} SELECT doc_id, sha256(text) AS hash FROM m",
    "p7_p8_folded": f"""{_MAPS} SELECT doc_id, 'var a = "xy' || CAST(doc_id AS VARCHAR) || 'z" ; c ( 2 ) ; d = e ( 1 , 2 ) ; f ( "hi" ) ;' || chr(10) AS code FROM m""",
}

QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "hpjs" and k[1:2].isdigit() and callable(f)}
