"""Queries of the script operators over synthetic bundles built from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import javascript as J
from webloom.plans.tables import sql

JS = r"""
SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'https://s' || CAST(page_id % 50 AS STRING) || '.example.com/assets/app' || CAST(page_id AS STRING) || '.js' ELSE 'https://s' || CAST(page_id % 50 AS STRING) || '.example.com/js/app' || CAST(page_id AS STRING) || '.js' END AS url,
CASE page_id % 6
WHEN 0 THEN 'import("./chunk-' || CAST(page_id AS STRING) || '.js"); __vitePreload(()=>1); const u=import.meta.url; const __vite__mapDeps=(i,m=__vite__mapDeps,d=(m.f||(m.f=["assets/a' || CAST(page_id AS STRING) || '.js","assets/b.css","assets/c.js"])))=>i; __vite__mapDeps([0,1,2]); ({"../views/user' || CAST(page_id AS STRING) || '/index.vue": () => import("./user-' || CAST(page_id AS STRING) || '.js")});'
WHEN 1 THEN '__webpack_require__.p="/static/"; __webpack_require__.u=function(e){return "js/"+e+"."+{"1":"aa1","2":"bb2"}[e]+".js"}; var h={"1":"aa1","2":"bb2"}; __webpack_require__.e(1); /* __webpack_require__.e(9) */ (self.webpackChunk=self.webpackChunk||[]).push([[7],{}]); import("./lazy-' || CAST(page_id AS STRING) || '.js");'
WHEN 2 THEN 'self.__BUILD_MANIFEST = {"/p' || CAST(page_id AS STRING) || '":["pages/p.js","/x/y.js"]}; var c="/_next/static/chunks/main-' || CAST(page_id AS STRING) || '.js", b={"_buildId":"b1"};'
WHEN 3 THEN 'window.__NUXT__=1; var a="/_nuxt/entry' || CAST(page_id AS STRING) || '.js";'
WHEN 4 THEN 'var ng="@angular/core"; ({loadChildren: ()=>import("./lazy' || CAST(page_id AS STRING) || '.js")});'
ELSE 'import x from "./mod' || CAST(page_id AS STRING) || '.js"; fetch("/api/v' || CAST(page_id % 9 AS STRING) || '/list", {method:"POST"}); axios.get("/api/items/" + id + "/open"); const r={path:"/home' || CAST(page_id AS STRING) || '", component: () => import("./home.js")}; load("/js/extra' || CAST(page_id AS STRING) || '.js"); //# sourceMappingURL=app' || CAST(page_id AS STRING) || '.js.map'
END AS body FROM pages"""


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, JS, "pages").select("url", "body")


def j1_dynamic_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.dynamic_imports(scripts(spark, sf_dir)).select("url", "ord", "raw", "resolved_url", "confidence", "component")


def j2_static_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.static_imports(scripts(spark, sf_dir)).select("url", "raw", "resolved_url", "confidence")


def j3_token_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.token_imports(J.scanned(scripts(spark, sf_dir))).select("url", "raw", "resolved_url", "confidence")


def j4_fallback_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scripts, cut off within a bracket: no text lexes, the patterns take over."""
    torn = scripts(spark, sf_dir).withColumn("body", F.concat("body", F.lit("\n({")))
    return J.token_imports(J.scanned(torn)).select("url", "raw", "resolved_url", "confidence")


def j5_import_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/a/' || CAST(page_id AS STRING) || '.js' WHEN 2 THEN './b/../c.js' WHEN 3 THEN '../d.js?x=1' ELSE 'bare/x.js' END AS raw, 'https://s' || CAST(page_id % 9 AS STRING) || '.example.com/js/lib/app.js' AS base FROM pages", "pages")
    return rows.select("page_id", J.import_url(F.col("raw"), F.col("base")).alias("resolved_url"))


def j7_all_source_map_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT url, 'a();//# sourceMappingURL=a' || CAST(page_id AS STRING) || '.map' || chr(10) || '/*# sourceMappingURL=b.map */ c();//@ sourceMappingURL=data:x' AS body FROM pages", "pages")
    return J.all_source_map_urls(rows).select("url", "ord", "raw")


def j12_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.analysis(J.scanned(scripts(spark, sf_dir)), "generic")[2].select("url", "asset_url", "source", "confidence")


def j6_source_map_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.source_map_urls(scripts(spark, sf_dir))


def j8_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.routes(scripts(spark, sf_dir)).select("url", "route", "component", "confidence")


def j9_quoted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.quoted_paths(scripts(spark, sf_dir)).select("url", "asset_url")


def j10_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.framework_scores(scripts(spark, sf_dir)).select("url", "framework", "score")


def j11_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.dispatched(scripts(spark, sf_dir)).groupBy("framework", "route_key").agg(F.count(F.lit(1)).alias("n"))


def j13_j14_j15_vite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.analysis(J.dispatched(J.scanned(scripts(spark, sf_dir))), "vite")[2].select("url", "asset_url", "source", "confidence")


def j15_asset_map_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.asset_map(scripts(spark, sf_dir))[1].select("url", "route", "component", "lazy_js")


def j16_j17_webpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.analysis(J.dispatched(J.scanned(scripts(spark, sf_dir))), "webpack")[0].select("url", "raw", "resolved_url", "source", "confidence")


def j19_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.analysis(J.dispatched(J.scanned(scripts(spark, sf_dir))), "next")[2].select("url", "asset_url")


def j19_next_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.analysis(J.dispatched(J.scanned(scripts(spark, sf_dir))), "next")[1]
    return found.select("url", "route", "lazy_js", F.array_join("deps", " ").alias("deps"), "confidence")


def j20_nuxt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.analysis(J.dispatched(J.scanned(scripts(spark, sf_dir))), "nuxt")[2].select("url", "asset_url", "confidence")


def j21_angular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.analysis(J.dispatched(J.scanned(scripts(spark, sf_dir))), "angular")[1].select("url", "lazy_js", "confidence")


def j22_j23_j24_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.discovered(J.dispatched(J.scanned(scripts(spark, sf_dir)))).select("url", "asset_url", "confidence", "source")


def j26_paths_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = scripts(spark, sf_dir).withColumn("entry_url", F.regexp_extract("url", r"^(https://[^/]*/)", 1))
    return J.paths_in_text(texts).select("url", "asset_url")


def j27_urls_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sql(spark, sf_dir, "SELECT page_id AS line_id, '[net] url:' || url || ') from \"' || url || '\", see https://log.example.com/' || CAST(page_id AS STRING) AS line FROM pages", "pages")
    return J.urls_in_log(lines).select("line_id", "url")


def a1_static_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.static_endpoints(J.scanned(scripts(spark, sf_dir)))
    return found.select("source_js_url", "raw_url", "method", "type")


_DIR = "regexp_replace(url, '[^/]*$', '')"
_ID = "CAST(page_id AS STRING)"
_ROOT = "regexp_extract(url, '^(https://[^/]*)', 1)"
W = f"WITH js AS ({JS})"

ORACLES = {
    "j1_dynamic_imports": f"""{W} SELECT url, CAST(k AS BIGINT) AS ord, './' || f AS raw, {_DIR} || f AS resolved_url, 'high' AS confidence, '' AS component FROM (
SELECT url, 0 AS k, 'chunk-' || {_ID} || '.js' AS f, page_id FROM js WHERE page_id % 6 = 0 UNION ALL SELECT url, 1, 'user-' || {_ID} || '.js', page_id FROM js WHERE page_id % 6 = 0
UNION ALL SELECT url, 0, 'lazy-' || {_ID} || '.js', page_id FROM js WHERE page_id % 6 = 1 UNION ALL SELECT url, 0, 'lazy' || {_ID} || '.js', page_id FROM js WHERE page_id % 6 = 4
UNION ALL SELECT url, 0, 'home.js', page_id FROM js WHERE page_id % 6 = 5) t""",
    "j2_static_imports": f"{W} SELECT url, './mod' || {_ID} || '.js' AS raw, {_DIR} || 'mod' || {_ID} || '.js' AS resolved_url, 'high' AS confidence FROM js WHERE page_id % 6 = 5",
    "j3_token_imports": f"""{W} SELECT url, './' || f AS raw, {_DIR} || f AS resolved_url, 'high' AS confidence FROM (
SELECT url, unnest(['chunk-' || {_ID} || '.js', 'user-' || {_ID} || '.js']) AS f FROM js WHERE page_id % 6 = 0 UNION ALL SELECT url, 'lazy-' || {_ID} || '.js' FROM js WHERE page_id % 6 = 1
UNION ALL SELECT url, 'lazy' || {_ID} || '.js' FROM js WHERE page_id % 6 = 4 UNION ALL SELECT url, unnest(['home.js', 'mod' || {_ID} || '.js']) FROM js WHERE page_id % 6 = 5) t""",
    "j4_fallback_imports": f"""{W} SELECT url, './' || f AS raw, {_DIR} || f AS resolved_url, 'high' AS confidence FROM (
SELECT url, unnest(['chunk-' || {_ID} || '.js', 'user-' || {_ID} || '.js']) AS f FROM js WHERE page_id % 6 = 0 UNION ALL SELECT url, 'lazy-' || {_ID} || '.js' FROM js WHERE page_id % 6 = 1
UNION ALL SELECT url, 'lazy' || {_ID} || '.js' FROM js WHERE page_id % 6 = 4 UNION ALL SELECT url, unnest(['home.js', 'mod' || {_ID} || '.js']) FROM js WHERE page_id % 6 = 5) t""",
    "j5_import_urls": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 4 THEN '' ELSE 'https://s' || CAST(page_id % 9 AS VARCHAR) || '.example.com' || CASE page_id % 5 WHEN 1 THEN '/a/' || CAST(page_id AS VARCHAR) || '.js' WHEN 2 THEN '/js/lib/c.js' ELSE '/js/d.js?x=1' END END AS resolved_url FROM pages""",
    "j7_all_source_map_urls": "SELECT url, unnest([0, 1]) AS ord, unnest(['a' || CAST(page_id AS VARCHAR) || '.map', 'b.map']) AS raw FROM pages",
    "j12_generic": f"""{W} SELECT url, {_ROOT} || p AS asset_url, 'regex_candidate' AS source, 'low' AS confidence FROM (SELECT url, unnest(list_distinct(regexp_extract_all(body, '[\"'']((?:/|[.]|[.][.]/)(?:assets|static|_next/static|_nuxt|chunks|js)[^\"'']*[.]js)[\"'']', 1))) AS p FROM js) t
UNION ALL SELECT url, {_DIR} || f, 'import_expression', 'high' FROM (SELECT url, unnest(['chunk-' || {_ID} || '.js', 'user-' || {_ID} || '.js']) AS f FROM js WHERE page_id % 6 = 0 UNION ALL SELECT url, 'lazy-' || {_ID} || '.js' FROM js WHERE page_id % 6 = 1
UNION ALL SELECT url, 'lazy' || {_ID} || '.js' FROM js WHERE page_id % 6 = 4 UNION ALL SELECT url, 'home.js' FROM js WHERE page_id % 6 = 5) v""",
    "j6_source_map_urls": f"{W} SELECT url, {_DIR} || 'app' || {_ID} || '.js.map' AS map_url FROM js WHERE page_id % 6 = 5",
    "j8_routes": f"{W} SELECT url, '/home' || {_ID} AS route, './home.js' AS component, 'medium' AS confidence FROM js WHERE page_id % 6 = 5",
    "j9_quoted_paths": f"{W} SELECT url, {_ROOT} || p AS asset_url FROM (SELECT url, unnest(regexp_extract_all(body, '[\"'']((?:/|[.]|[.][.]/)(?:assets|static|_next/static|_nuxt|chunks|js)[^\"'']*[.]js)[\"'']', 1)) AS p FROM js) t",
    "j10_frameworks": f"""{W} SELECT url, CASE page_id % 6 WHEN 0 THEN 'vite' WHEN 1 THEN 'webpack' WHEN 2 THEN 'next' WHEN 3 THEN 'nuxt' WHEN 4 THEN 'angular' ELSE CASE WHEN 1 = 1 THEN 'vue-cli' END END AS framework,
CAST(CASE page_id % 6 WHEN 0 THEN 3 + 5 + 5 + 1 WHEN 1 THEN 5 + 4 + 4 + 3 + 4 WHEN 2 THEN 4 + 5 + 2 WHEN 3 THEN 4 + 5 WHEN 4 THEN 5 + 4 ELSE 0 END AS BIGINT) AS score FROM js WHERE page_id % 6 <> 5
UNION ALL SELECT url, 'unknown', 0 FROM js WHERE page_id % 6 = 5""",
    "j11_dispatch": f"""{W} SELECT k AS framework, CASE k WHEN 'unknown' THEN 'generic' ELSE k END AS route_key, count(*) AS n FROM (SELECT CASE page_id % 6 WHEN 0 THEN 'vite' WHEN 1 THEN 'webpack' WHEN 2 THEN 'next' WHEN 3 THEN 'nuxt' WHEN 4 THEN 'angular' ELSE 'unknown' END AS k FROM js) t GROUP BY k""",
    "j13_j14_j15_vite": f"""{W}, v AS (SELECT *, {_DIR} AS d FROM js WHERE page_id % 6 = 0)
SELECT url, d || 'chunk-' || {_ID} || '.js' AS asset_url, 'vite_import' AS source, 'high' AS confidence FROM v UNION ALL SELECT url, d || 'user-' || {_ID} || '.js', 'vite_import', 'high' FROM v
UNION ALL SELECT url, d || 'assets/a' || {_ID} || '.js', 'vite_map_deps', 'medium' FROM v UNION ALL SELECT url, d || 'assets/c.js', 'vite_map_deps', 'medium' FROM v""",
    "j15_asset_map_routes": f"{W} SELECT url, '/user' || {_ID} AS route, '../views/user' || {_ID} || '/index.vue' AS component, {_DIR} || 'user-' || {_ID} || '.js' AS lazy_js FROM js WHERE page_id % 6 = 0",
    "j16_j17_webpack": f"""{W}, w AS (SELECT * FROM js WHERE page_id % 6 = 1) SELECT url, 'webpackChunk:7' AS raw, {_ROOT} || '/static/js/7.' AS resolved_url, 'webpack_runtime' AS source, 'medium' AS confidence FROM w
UNION ALL SELECT url, '__webpack_require__.e(1)', {_ROOT} || '/static/js/1.aa1.js', 'webpack_runtime', 'high' FROM w UNION ALL SELECT url, './lazy-' || {_ID} || '.js', {_DIR} || 'lazy-' || {_ID} || '.js', 'import_expression', 'high' FROM w""",
    "j19_next": f"""{W} SELECT url, {_ROOT} || p AS asset_url FROM (SELECT url, unnest(['/_next/static/b1/_buildManifest.js', '/_next/static/b1/_ssgManifest.js', '/_next/static/b1/app-build-manifest.js', '/_next/static/chunks/main-' || {_ID} || '.js']) AS p FROM js WHERE page_id % 6 = 2) t""",
    "j19_next_routes": f"{W} SELECT url, '/p' || {_ID} AS route, {_ROOT} || '/_next/static/chunks/pages/p.js' AS lazy_js, {_ROOT} || '/_next/static/chunks/pages/p.js ' || {_ROOT} || '/x/y.js' AS deps, 'high' AS confidence FROM js WHERE page_id % 6 = 2",
    "j20_nuxt": f"{W} SELECT url, {_ROOT} || '/_nuxt/entry' || {_ID} || '.js' AS asset_url, 'medium' AS confidence FROM js WHERE page_id % 6 = 3",
    "j21_angular": f"{W} SELECT url, {_DIR} || 'lazy' || {_ID} || '.js' AS lazy_js, 'medium' AS confidence FROM js WHERE page_id % 6 = 4",
    "j22_j23_j24_discovered": f"""{W}, t AS (SELECT *, page_id % 6 AS k, {_DIR} AS d, {_ROOT} AS r, {_ID} AS i FROM js)
SELECT url, d || unnest(['chunk-' || i || '.js', 'user-' || i || '.js']) AS asset_url, 'high' AS confidence, 'import_expression' AS source FROM t WHERE k = 0 UNION ALL SELECT url, d || unnest(['assets/a' || i || '.js', 'assets/c.js']), 'medium', 'vite_map_deps' FROM t WHERE k = 0
UNION ALL SELECT url, d || 'lazy-' || i || '.js', 'high', 'import_expression' FROM t WHERE k = 1 UNION ALL SELECT url, r || '/static/js/1.aa1.js', 'high', 'webpack_runtime' FROM t WHERE k = 1
UNION ALL SELECT url, r || unnest(['/_next/static/b1/_buildManifest.js', '/_next/static/b1/_ssgManifest.js', '/_next/static/b1/app-build-manifest.js', '/_next/static/chunks/main-' || i || '.js']), 'high', 'next_manifest' FROM t WHERE k = 2
UNION ALL SELECT url, r || '/_nuxt/entry' || i || '.js', 'medium', 'nuxt_static' FROM t WHERE k = 3 UNION ALL SELECT url, d || 'lazy' || i || '.js', 'high', 'import_expression' FROM t WHERE k = 4
UNION ALL SELECT url, d || unnest(['mod' || i || '.js', 'home.js']), 'high', 'import_expression' FROM t WHERE k = 5 UNION ALL SELECT url, r || '/js/extra' || i || '.js', 'low', 'regex_candidate' FROM t WHERE k = 5""",
    "j26_paths_in_text": f"""{W}, t AS (SELECT *, page_id % 6 AS k, {_DIR} AS d, {_ROOT} AS r, {_ID} AS i FROM js)
SELECT url, d || unnest(['chunk-' || i || '.js', 'user-' || i || '.js']) AS asset_url FROM t WHERE k = 0 UNION ALL SELECT url, d || 'lazy-' || i || '.js' FROM t WHERE k = 1 UNION ALL SELECT url, r || unnest(['/_next/static/chunks/main-' || i || '.js', '/x/y.js']) FROM t WHERE k = 2
UNION ALL SELECT url, r || '/_nuxt/entry' || i || '.js' FROM t WHERE k = 3 UNION ALL SELECT url, d || 'lazy' || i || '.js' FROM t WHERE k = 4 UNION ALL SELECT url, d || unnest(['mod' || i || '.js', 'home.js']) FROM t WHERE k = 5 UNION ALL SELECT url, r || '/js/extra' || i || '.js' FROM t WHERE k = 5""",
    "j27_urls_in_log": "SELECT page_id AS line_id, unnest([url, 'https://log.example.com/' || CAST(page_id AS STRING)]) AS url FROM pages",
    "a1_static_endpoints": f"""{W} SELECT url AS source_js_url, '/api/v' || CAST(page_id % 9 AS STRING) || '/list' AS raw_url, 'POST' AS method, 'fetch' AS type FROM js WHERE page_id % 6 = 5
UNION ALL SELECT url, '/api/items/EXPR/open', 'GET', 'axios.get' FROM js WHERE page_id % 6 = 5 UNION ALL SELECT url, '/home' || {_ID}, '', 'string' FROM js WHERE page_id % 6 = 5
UNION ALL SELECT url, '../views/user' || {_ID} || '/index.vue', '', 'string' FROM js WHERE page_id % 6 = 0 UNION ALL SELECT url, '/static/', '', 'string' FROM js WHERE page_id % 6 = 1
UNION ALL SELECT url, 'js/EXPR.', '', 'string' FROM js WHERE page_id % 6 = 1 UNION ALL SELECT url, '/p' || {_ID}, '', 'string' FROM js WHERE page_id % 6 = 2 UNION ALL SELECT url, '@angular/core', '', 'string' FROM js WHERE page_id % 6 = 4""",
}

QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "ja" and k[1:2].isdigit() and callable(f)}
