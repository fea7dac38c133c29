"""Findings from script text: imports, routes, frameworks, bundler chunks, source maps.

Input rows are scripts (url, body). Pattern extractors are regular expressions of the
engine, exploded with their position; only what needs tokens runs in one Arrow pass
(``scanned``) that adds a struct read by every operator. Findings carry ``ord``, so that
"the first wins" has one meaning whatever the partitions are.

imports: url, ord, raw, resolved_url, framework, source, confidence, component, deps
routes: url, ord, route, component, lazy_js, framework, source, confidence, deps
assets: url, ord, asset_url, type, framework, source, confidence
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import js_lexer, urls

# Patterns that must find what scripts and bundlers write.
DYNAMIC_IMPORT = r"import\s*\(\s*(?:\"([^\"]+)\"|'([^']+)'|`([^`]+)`)\s*\)"
STATIC_IMPORT = r"\bimport\s+(?:[^;\"']*?\s+from\s*)?[\"']([^\"']+)[\"']"
STATIC_EXPORT = r"\bexport\s+(?:\*(?:\s+as\s+[$\w]+)?|\{[^}]*\})\s+from\s*[\"']([^\"']+)[\"']"
MAP_DIRECTIVE = r"(?md)(?://|/\*)[#@][\t\n\f\r ]*sourceMappingURL[\t\n\f\r ]*=[\t\n\f\r ]*([^\t\n\f\r ]+?)(?:[\t\n\f\r ]*\*/)?$"
ROUTE = r"(?:path|route)\s*:\s*[\"']([/][^\"']*?)[\"']"
COMPONENT = r"(?:component|Component)\s*:\s*(?:\(\)\s*=>\s*)?(?:import\s*\(\s*[\"']([^\"']+)[\"']\s*\))"
JS_PATH = r"(?:\"|')((?:/|\.|\.\./)(?:assets|static|_next/static|_nuxt|chunks|js)[^\"']*\.js)(?:\"|')"
MAP_DEPS = r"__vite__mapDeps\s*\(\s*\[([0-9,\s]+)\]"
MAP_DEPS_TABLE = r"__vite__mapDeps\s*=\s*(?:function\s*)?\(i\s*,\s*m\s*=\s*__vite__mapDeps\s*,\s*d\s*=\s*\(\s*m\.f\s*\|\|\s*\(\s*m\.f\s*=\s*(\[[^\[\]]*\])\s*\)\s*\)\s*\)\s*=>"
ASSET_MAP = r"\"([^\"]+?)\"\s*:\s*\(\)\s*=>\s*(?:__vitePreload\s*\(\s*)?import\s*\(\s*[\"']\./([^\"']+)[\"']"
PUBLIC_PATH = r"__webpack_require__\.p\s*=\s*[\"']([^\"']+)[\"']"
CHUNK_FILENAME = r"chunkFilename\s*[:=]\s*[\"']([^\"']+)[\"']"
HASH_MAP = r"\{(\"[0-9]+\"\s*:\s*\"[a-zA-Z0-9]+\"(?:\s*,\s*\"[0-9]+\"\s*:\s*\"[a-zA-Z0-9]+\")*)\}"
HASH_ENTRY = r"\"([0-9]+)\"\s*:\s*\"([a-zA-Z0-9]+)\""
NAME_RULE = r"\"([^\"]*?)\"\s*\+\s*\w+\s*\+\s*\"([^\"]*?)\""
NAME_RULE_HASHED = r"\"([^\"]*)\"\s*\+\s*\w+\s*\+\s*\"([^\"]*)\"\s*\+\s*\{[^}]+\}\[\w+\]\s*\+\s*\"([^\"]*)\""
CHUNK_PUSH = r"(?:self\.webpackChunk\w*\s*\|\|\s*\[\]\)\.push\s*\(\s*\[\s*\[(\d+)\])|(?:\bwebpackJsonp\s*\w*\s*\.\s*push\s*\(\s*\[\s*\[(\d+)\])"
NEXT_BUILD = r"\"_buildId\"\s*:\s*\"([^\"]+)\""
NEXT_MANIFEST = r"/_next/static/([^/]+)/(_buildManifest|_ssgManifest|app-build-manifest)\.js"
NEXT_CHUNK = r"/_next/static/chunks/[^\"'\s]+\.js"
NEXT_TABLE = r"self\.__BUILD_MANIFEST\s*=\s*(?:function\s*\(\s*\w*\s*\)\s*\{[\s\S]*?return\s*|)(\{[\s\S]*?\})\s*;"
NEXT_ROUTE = r"\"(/[^\"]*?)\"\s*:\s*\[(.*?)\]"
NUXT_PATH = r"/_nuxt/[^\"'\s]+\.js"
NUXT_ROUTE = r"\"([^\"]+?)\"\s*:\s*(?:function\s*\(\s*\)\s*\{)?\s*return\s+import\s*\(\s*[\"']([^\"']+)[\"']"
LOAD_CHILDREN = r"loadChildren\s*:\s*(?:\(\)\s*=>|function\s*\(\s*\)\s*\{?\s*return\s*)import\s*\(\s*[\"']([^\"']+)[\"']"
PATH_IN_TEXT = r"(?:^|[\"'\s])(/[a-zA-Z0-9_./-]*\.js(?:\?[^\s\"')]*)?)(?:[\"'\s)]|$)"
RELATIVE_IN_TEXT = r"(?:^|[\"'\s])(\.{1,2}/[a-zA-Z0-9_./-]*\.js(?:\?[^\s\"')]*)?)(?:[\"'\s)]|$)"
#: Substrings and weights, in order of priority among equals; (framework, in the body, in the URL).
WEIGHTS = (
    ("angular", (("ng-version", 4), ("runtime.", 1), ("polyfills.", 2), ("main.", 1), ("@angular/core", 5), ("@angular/router", 5), ("loadChildren", 4), ("ɵɵdefineInjectable", 3)), ()),
    ("next", (("/_next/static/chunks/", 4), ("self.__BUILD_MANIFEST", 5), ("_buildManifest.js", 4), ("_ssgManifest.js", 4), ("app-build-manifest", 3), ("__NEXT_DATA__", 5), ("/_next/", 2)), (("/_next/", 3),)),
    ("nuxt", (("/_nuxt/", 4), ("window.__NUXT__", 5), ("__NUXT_DATA__", 5), ("payload.js", 2), ("nuxt_plugin", 3), ("nuxtLink", 2)), (("/_nuxt/", 3),)),
    ("vite", (("import.meta.url", 3), ("__vite__mapDeps", 5), ("__vitePreload", 5), ("/assets/index-", 2), ('type="module"', 1), ("import.meta.hot", 3), ("__vite_ssr_import__", 4)), (("/assets/", 1),)),
    ("webpack", (("__webpack_require__", 5), ("__webpack_require__.e", 4), ("__webpack_require__.u", 4), ("__webpack_require__.p", 3), ("self.webpackChunk", 4), ("webpackJsonp", 4), ("chunkFilename", 2)), ()),
    ("vue-cli", (("/js/app.", 3), ("/js/chunk-vendors.", 4), ("__webpack_require__", 2), ("webpackChunk", 2), ("vue-router", 3), ("vue.runtime", 3)), ()),
)
THRESHOLD = 2
LEXED = "struct<parse_ok:boolean,imports:array<string>,routes:array<string>,chunks:array<string>,map_reference:string,rule:string,calls:array<struct<raw:string,call:string,method:string,names:array<string>>>>"
_CALL = pa.struct([("raw", pa.string()), ("call", pa.string()), ("method", pa.string()), ("names", pa.list_(pa.string()))])
_LEXED = pa.struct([("parse_ok", pa.bool_()), ("imports", pa.list_(pa.string())), ("routes", pa.list_(pa.string())), ("chunks", pa.list_(pa.string())), ("map_reference", pa.string()), ("rule", pa.string()), ("calls", pa.list_(_CALL))])
NO_STRINGS = "array<string>"
IMPORTS = "array<struct<raw:string,resolved_url:string,framework:string,source:string,confidence:string,component:string,deps:array<string>>>"
ROUTES = "array<struct<route:string,component:string,lazy_js:string,framework:string,source:string,confidence:string,deps:array<string>>>"
ASSETS = "array<struct<asset_url:string,type:string,framework:string,source:string,confidence:string>>"


def scanned(js: DataFrame, limit: int = 5 << 20) -> DataFrame:
    """(url, body) with ``lex``: what tokens tell (J3, P1, the chunk file rule and A1). Larger bodies have lex null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for body in part.column(1).to_pylist():
                    if body is None or len(body.encode("utf-8", "replace")) > limit:
                        rows.append(None)
                        continue
                    rule = js_lexer.function_body(body, "__webpack_require__.u")
                    rows.append(js_lexer.read(body) | {"rule": rule if ".js" in rule or ".chunk" in rule else ""})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _LEXED)], names=["url", "body", "lex"])

    return js.select("url", "body").mapInArrow(run, f"url string, body string, lex {LEXED}")


def _matches(pattern: str, groups: int, text: Column | None = None) -> Column:
    """Every match of the body as a struct: match, g1, g2, ..."""
    found = F.regexp_extract_all(F.col("body") if text is None else text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.struct(m.alias("match"), *[F.regexp_extract(m, pattern, k + 1).alias(f"g{k + 1}") for k in range(groups)]))


def _rows(js: DataFrame, found: Column) -> DataFrame:
    """One row for each finding of an array of structs: url, ord and its fields."""
    # The outer form: for the inner one the optimizer adds a filter on the array's size and pushes it below what the
    # array is made of, so that all of it would be planned and computed twice.
    each = js.select("url", F.posexplode_outer(found).alias("ord", "f")).where("ord is not null")
    return each.select("url", F.col("ord").cast("long").alias("ord"), "f.*")


def import_url(raw: Column, base: Column) -> Column:
    """Absolute and path-like specifiers resolved; bare ones are empty."""
    return F.when(raw.rlike("^https?://"), raw).when(raw.rlike(r"^(/|\./|\.\./)"), urls.joined(base, raw)).otherwise(F.lit(""))


def _strings() -> Column:
    return F.array().cast(NO_STRINGS)


def _import(raw: Column, resolved: Column, framework: str, source: str, confidence: Column, component: Column | None = None, deps: Column | None = None) -> Column:
    return F.struct(
        raw.alias("raw"), resolved.alias("resolved_url"), F.lit(framework).alias("framework"), F.lit(source).alias("source"), confidence.alias("confidence"),
        (F.lit("") if component is None else component).alias("component"), (_strings() if deps is None else deps).alias("deps"),
    )


def _route(route: Column, component: Column, lazy_js: Column, framework: str, source: str, confidence: Column, deps: Column | None = None) -> Column:
    return F.struct(
        route.alias("route"), component.alias("component"), lazy_js.alias("lazy_js"), F.lit(framework).alias("framework"), F.lit(source).alias("source"), confidence.alias("confidence"),
        (_strings() if deps is None else deps).alias("deps"),
    )


def _asset(asset_url: Column, framework: str, source: Column, confidence: Column, kind: Column | None = None) -> Column:
    return F.struct(asset_url.alias("asset_url"), (F.lit("lazy_chunk_js") if kind is None else kind).alias("type"), F.lit(framework).alias("framework"), source.alias("source"), confidence.alias("confidence"))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def dynamic_imports_in(framework: str = "", source: str = "import_expression", sure: str = "") -> Column:
    raws = F.transform(_matches(DYNAMIC_IMPORT, 3), lambda m: F.concat(m["g1"], m["g2"], m["g3"]))
    named = F.transform(raws, lambda r: F.struct(r.alias("raw"), r.contains("${").alias("open"), F.when(r.contains("${"), "").otherwise(import_url(r, F.col("url"))).alias("to")))
    confidence = lambda x: F.lit(sure) if sure else F.when(x["open"], "low").when(x["to"] == "", "medium").otherwise("high")
    component = lambda x: F.when(~x["open"] & x["raw"].rlike("component|Component|view|page"), x["raw"]).otherwise(F.lit(""))
    return F.transform(named, lambda x: _import(x["raw"], x["to"], framework, source, confidence(x), component(x)))


def _known(raws: Column, framework: str) -> Column:
    named = F.transform(raws, lambda r: F.struct(r.alias("raw"), import_url(r, F.col("url")).alias("to")))
    return F.transform(named, lambda x: _import(x["raw"], x["to"], framework, "import_expression", F.when(x["to"] == "", "medium").otherwise("high")))


def static_imports_in(framework: str = "") -> Column:
    return _known(F.concat(*[F.transform(_matches(p, 1), lambda m: m["g1"]) for p in (STATIC_IMPORT, STATIC_EXPORT)]), framework)


def token_imports_in(framework: str = "") -> Column:
    by_tokens = _known(F.col("lex.imports"), framework)
    by_pattern = F.concat(dynamic_imports_in(framework), static_imports_in(framework))
    return F.when(F.col("lex.parse_ok"), by_tokens).when(F.col("lex").isNotNull(), by_pattern).otherwise(_none(IMPORTS))


def routes_in(framework: str = "") -> Column:
    # A character is a byte or more; one that the 500th byte cuts in two belongs to no import.
    ahead = lambda m: F.substring(F.col("body"), F.instr(F.col("body"), m["match"]), F.lit(500))
    near = lambda t: F.when(F.octet_length(t) <= 500, t).otherwise(F.make_valid_utf8(F.substring(F.encode(t, "utf-8"), 1, 500).cast("string")))
    found = F.transform(_matches(ROUTE, 1), lambda m: F.struct(m["g1"].alias("route"), ahead(m).alias("t")))
    found = F.transform(found, lambda x: F.struct(x["route"].alias("route"), F.regexp_extract(near(x["t"]), COMPONENT, 1).alias("component")))
    return F.transform(found, lambda x: _route(x["route"], x["component"], F.lit(""), framework, "regex_candidate", F.when(x["component"] != "", "medium").otherwise("low")))


def token_routes_in(framework: str = "") -> Column:
    by_tokens = F.transform(F.col("lex.routes"), lambda r: _route(r, F.lit(""), F.lit(""), framework, "ast", F.lit("high")))
    return F.when(F.col("lex.parse_ok"), by_tokens).when(F.col("lex").isNotNull(), routes_in(framework)).otherwise(_none(ROUTES))


def paths_in() -> Column:
    found = F.regexp_extract_all("body", F.lit(JS_PATH), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: urls.joined(F.col("url"), p)))


def dynamic_imports(js: DataFrame, framework: str = "") -> DataFrame:
    """import() with a literal; templates with expressions stay unresolved."""
    return _rows(js, dynamic_imports_in(framework))


def static_imports(js: DataFrame, framework: str = "") -> DataFrame:
    """import and re-export statements, imports first."""
    return _rows(js, static_imports_in(framework))


def token_imports(lexed: DataFrame, framework: str = "") -> DataFrame:
    """Specifiers that the lexer finds; where it fails, J1 and J2 instead."""
    return _rows(lexed, token_imports_in(framework))


def token_routes(lexed: DataFrame, framework: str = "") -> DataFrame:
    """Route properties that the lexer finds, else J8."""
    return _rows(lexed, token_routes_in(framework))


def routes(js: DataFrame, framework: str = "") -> DataFrame:
    """Route literals; a component import within 500 bytes of the first such text lifts confidence."""
    return _rows(js, routes_in(framework))


def source_map_urls(js: DataFrame) -> DataFrame:
    """Last directive at a line's end, resolved; data URLs give none."""
    said = F.try_element_at(F.regexp_extract_all("body", F.lit(MAP_DIRECTIVE), F.lit(1)), F.lit(-1))
    rows = js.select("url", said.alias("raw")).where(F.col("raw").isNotNull() & ~F.col("raw").startswith("data:"))
    return rows.select("url", urls.joined(F.col("url"), F.col("raw")).alias("map_url"))


def all_source_map_urls(js: DataFrame) -> DataFrame:
    """Every directive up to a blank, star or slash-free end, data URLs left out."""
    rows = js.select("url", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?://|/\*)[#@] ?sourceMappingURL=([^\s*]+)"), F.lit(1))).alias("ord", "raw"))
    return rows.where(~F.col("raw").startswith("data:"))


def quoted_paths(js: DataFrame) -> DataFrame:
    """Quoted script paths, resolved, distinct in order."""
    return _rows(js, F.transform(paths_in(), lambda p: F.struct(p.alias("asset_url"))))


def detected(body: Column, url: Column) -> Column:
    """Best framework as struct<score, place, name, reasons>, one expression over all weights."""

    def judged(name: str, inside: tuple, outside: tuple, place: int) -> Column:
        hits = [(body.contains(w), n, w) for w, n in inside] + [(url.contains(w), n, f"url:{w}") for w, n in outside]
        score = sum((F.when(ok, F.lit(n)).otherwise(0) for ok, n, _ in hits), F.lit(0))
        return F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name"), F.array_compact(F.array(*[F.when(ok, F.lit(w)) for ok, _, w in hits])).alias("reasons"))

    return F.array_max(F.array(*[judged(*w, k) for k, w in enumerate(WEIGHTS)]))


def framework_scores(js: DataFrame) -> DataFrame:
    """url, framework (unknown below the threshold), score and reasons."""
    best = js.select("url", detected(F.col("body"), F.col("url")).alias("b"))
    known = F.col("b.score") >= THRESHOLD
    return best.select("url", F.when(known, F.col("b.name")).otherwise("unknown").alias("framework"), F.when(known, F.col("b.score")).otherwise(0).cast("long").alias("score"), F.when(known, F.col("b.reasons")).otherwise(F.array().cast(NO_STRINGS)).alias("reasons"))


def route_key(framework: Column, body: Column, url: Column) -> Column:
    """Which analysis a script gets: by framework, else by second probes in order."""
    count = lambda text, words: sum((text.contains(w).cast("int") for w in words), F.lit(0))
    either = lambda words: count(body, words) + count(url, words)
    vite = count(body, ("__vite__mapDeps", "__vitePreload", "import.meta.url", "import.meta.hot")) + (url.contains("/assets/") & url.contains(".js")).cast("int")
    probed = (
        F.when(vite >= 2, "vite")
        .when(count(body, ("__webpack_require__", "self.webpackChunk", "webpackJsonp")) >= 1, "webpack")
        .when(either(("/_next/static/chunks/", "self.__BUILD_MANIFEST", "_buildManifest.js", "__NEXT_DATA__", "/_next/")) >= 1, "next")
        .when(either(("/_nuxt/", "window.__NUXT__", "__NUXT_DATA__", "nuxt_plugin", "nuxtLink")) >= 1, "nuxt")
        .when((count(body, ("ng-version", "@angular/core", "@angular/router", "loadChildren", "ɵɵdefineInjectable")) >= 1) | (count(url, ("runtime.", "polyfills.", "main.")) >= 2), "angular")
        .otherwise("generic")
    )
    return F.when(framework == "vue-cli", "webpack").when(framework != "unknown", framework).otherwise(probed)


def dispatched(js: DataFrame) -> DataFrame:
    """Scripts with framework and route_key; bodies stay where they are."""
    best = js.withColumn("_b", detected(F.col("body"), F.col("url")))
    named = best.withColumn("framework", F.when(F.col("_b.score") >= THRESHOLD, F.col("_b.name")).otherwise("unknown")).drop("_b")
    return named.withColumn("route_key", route_key(F.col("framework"), F.col("body"), F.col("url")))


# ---------------------------------------------------------------- bundlers


def prepared(js: DataFrame) -> DataFrame:
    """Adds what several findings of a bundler read: Vite's dependency table, webpack's public path, file name
    template, hashes (last entry of an id wins) and name rule (J16), and Next's build manifest."""
    entries = F.flatten(F.transform(F.regexp_extract_all("body", F.lit(HASH_MAP), F.lit(1)), lambda b: _matches(HASH_ENTRY, 2, b)))
    of = lambda keys, c: F.when(F.col("route_key").isin(*keys), c) if "route_key" in js.columns else c
    rule = F.coalesce("lex.rule", F.lit("")) if "lex" in js.columns else F.lit("")
    first = js.withColumns(
        {
            "table": of(["vite"], F.regexp_extract_all(F.regexp_extract("body", MAP_DEPS_TABLE, 1), F.lit(r"\"([^\"]+)\""), F.lit(1))),
            "entries": of(["webpack", "angular"], entries),
            "public": of(["webpack", "angular"], F.regexp_extract("body", PUBLIC_PATH, 1)),
            "template": of(["webpack", "angular"], F.regexp_extract("body", CHUNK_FILENAME, 1)),
            "rule": rule,
            "manifest": of(["next"], F.regexp_extract("body", NEXT_TABLE, 1)),
        }
    )
    last = F.filter("entries", lambda e, i: ~F.exists(F.slice("entries", i + 2, F.size("entries")), lambda later: later["g1"] == e["g1"]))
    hashes = F.map_from_entries(F.transform(last, lambda e: F.struct(e["g1"], e["g2"])))
    return first.withColumns({"hashes": hashes, "listed": F.from_json("manifest", "map<string,array<string>>")}).drop("entries")


def map_deps_in() -> Column:
    """Vite dependency lists by index into the table of the definition; style sheets are skipped."""
    indices = lambda m: F.filter(F.transform(F.split(m["g1"], ","), lambda x: F.trim(F.regexp_replace(x, r"\s", "")).try_cast("int")), lambda x: x.isNotNull())
    plain = lambda d: d.isNotNull() & ~F.lower(d).endswith(".css") & ~F.lower(d).contains(".css?")
    named = lambda m: F.filter(F.transform(indices(m), lambda i: F.get("table", i)), plain)
    found = F.transform(_matches(MAP_DEPS, 1), lambda m: F.struct(m["match"].alias("raw"), F.transform(named(m), lambda d: urls.joined(F.col("url"), d)).alias("deps")))
    return F.transform(F.filter(found, lambda x: F.size(x["deps"]) > 0), lambda x: _import(x["raw"], F.lit(""), "vite", "vite_map_deps", F.lit("medium"), deps=x["deps"]))


def component_route(component: Column) -> Column:
    """Route of a component below views, pages or router; its file name counts only without a folder."""
    rest = F.regexp_extract(component, r"(?i)/(?:views|pages|router)/(.*)$", 1)
    bare = F.regexp_replace(rest, r"\.(vue|jsx|tsx|js|ts)$", "")
    folder = F.when(bare.contains("/"), F.regexp_replace(bare, r"/[^/]*$", "")).otherwise(bare)
    clean = F.regexp_replace(F.regexp_replace(folder, "/index$", ""), "/$", "")
    return F.when(clean != "", F.concat(F.lit("/"), clean)).otherwise("")


def _lazy() -> Column:
    return F.transform(_matches(ASSET_MAP, 2), lambda m: F.struct(m["match"].alias("raw"), m["g1"].alias("component"), urls.joined(F.col("url"), F.concat(F.lit("./"), m["g2"])).alias("to"), component_route(m["g1"]).alias("route")))


def asset_map_in() -> tuple[Column, Column]:
    found = _lazy()
    implied = F.filter(found, lambda x: x["route"] != "")
    return (
        F.transform(found, lambda x: _import(x["raw"], x["to"], "vite", "vite_import", F.lit("high"), x["component"])),
        F.transform(implied, lambda x: _route(x["route"], x["component"], x["to"], "vite", "vite_import", F.lit("medium"))),
    )


def asset_map(js: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lazy imports of the asset map and the routes their components imply."""
    found, implied = asset_map_in()
    return _rows(js, found), _rows(js, implied)


def first_of(df: DataFrame, *keys: str) -> DataFrame:
    """First row by ord of each key."""
    rest = [c for c in df.columns if c not in (*keys, "ord")]
    best = df.groupBy(*keys).agg(F.min_by(F.struct("ord", *rest), "ord").alias("f"))
    return best.select(*[F.col(c) if c in keys else F.col(f"f.{c}").alias(c) for c in df.columns])


def _of_imports(found: Column, framework: str) -> Column:
    return F.transform(F.filter(found, lambda x: x["resolved_url"] != ""), lambda x: _asset(x["resolved_url"], framework, x["source"], x["confidence"]))


def _of_paths(framework: str, ok=None) -> Column:
    found = F.col("paths") if ok is None else F.filter("paths", ok)
    return F.transform(found, lambda p: _asset(p, framework, F.lit("regex_candidate"), F.lit("low")))


def vite_imports() -> Column:
    return F.concat(dynamic_imports_in("vite", "vite_import", "high"), map_deps_in(), asset_map_in()[0])


def vite_assets(found: Column) -> Column:
    """An import's own URL, then its dependencies; the table of the definition; quoted paths."""
    listed = lambda x: F.transform(F.filter(x["deps"], urls.is_js_path), lambda d: _asset(d, "vite", F.lit("vite_map_deps"), F.lit("medium")))
    own = lambda x: F.when(x["resolved_url"] != "", F.array(_asset(x["resolved_url"], "vite", x["source"], x["confidence"]))).otherwise(_none(ASSETS))
    table = F.transform(F.filter(F.coalesce("table", _strings()), urls.is_js_path), lambda d: _asset(urls.joined(F.col("url"), d), "vite", F.lit("vite_map_deps"), F.lit("medium")))
    return F.concat(F.flatten(F.transform(found, lambda x: F.concat(own(x), listed(x)))), table, _of_paths("vite", urls.is_js_path))


def chunk_url(chunk: Column) -> Column:
    """URL of a webpack chunk from file name template, name rule or hash table (J17). Uses public, template, hashes and rule columns."""
    folder = F.regexp_extract(F.col("url"), r"^(.*/)[^/]*$", 1)
    public = F.when(F.col("public") == "", folder).otherwise(F.col("public"))
    public = F.when(public.rlike("^https?://"), public).otherwise(urls.joined(F.col("url"), public))
    known = F.try_element_at(F.col("hashes"), chunk)
    digest = F.coalesce(known, F.lit(""))
    swap = lambda t, marks, v: F.replace(swap(t, marks[1:], v), F.lit(marks[0]), v) if marks else t
    filled = swap(swap(F.col("template"), ("[id]", "[name]"), chunk), ("[chunkhash]", "[contenthash]"), digest)
    filled = F.when(known.isNotNull(), F.replace(filled, F.lit("[hash]"), digest)).otherwise(filled)
    g = lambda pattern, k: F.regexp_extract(F.col("rule"), pattern, k)
    tail = g(NAME_RULE, 2)
    tail = F.when(known.isNotNull(), swap(tail, ("[hash]", "[chunkhash]", "[contenthash]"), digest)).otherwise(tail)
    name = (
        F.when(F.col("template") != "", filled)
        .when((F.col("rule") != "") & known.isNotNull() & F.col("rule").rlike(NAME_RULE_HASHED), F.concat(g(NAME_RULE_HASHED, 1), chunk, g(NAME_RULE_HASHED, 2), digest, g(NAME_RULE_HASHED, 3)))
        .when((F.col("rule") != "") & F.col("rule").rlike(NAME_RULE), F.concat(g(NAME_RULE, 1), chunk, tail))
        .when(known.isNotNull(), F.concat(chunk, F.lit("."), digest, F.lit(".js")))
        .otherwise(F.concat(chunk, F.lit(".js")))
    )
    return F.when(public == "", "").otherwise(F.concat(public, name))


def webpack_imports(framework: str = "webpack") -> Column:
    """Chunks that are pushed, chunks that are required, then import()."""

    def chunks(ids: Column, said, sure: str) -> Column:
        named = F.transform(ids, lambda i: F.struct(said(i).alias("raw"), chunk_url(i).alias("to")))
        return F.transform(named, lambda x: _import(x["raw"], x["to"], framework, "webpack_runtime", F.when(x["to"] == "", "low").otherwise(sure)))

    pushed = chunks(F.transform(_matches(CHUNK_PUSH, 2), lambda m: F.concat(m["g1"], m["g2"])), lambda i: F.concat(F.lit("webpackChunk:"), i), "medium")
    required = chunks(F.when(F.col("lex.parse_ok"), F.col("lex.chunks")).otherwise(_strings()), lambda i: F.concat(F.lit("__webpack_require__.e("), i, F.lit(")")), "high")
    return F.concat(pushed, required, dynamic_imports_in(framework))


def webpack_assets(found: Column, framework: str = "webpack") -> Column:
    own = F.filter(found, lambda x: (x["framework"] == framework) & (x["confidence"] == "high") & urls.is_js_path(x["resolved_url"]))
    return _of_imports(own, framework)


def next_routes() -> Column:
    """Routes of the build manifest."""
    place = lambda c: urls.joined(F.col("url"), F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/_next/static/chunks/"), c)))
    row = lambda route, chunks, sure: F.struct(route.alias("route"), chunks.alias("chunks"), F.lit(sure).alias("sure"))
    strict = F.transform(F.map_entries("listed"), lambda e: row(e["key"], e["value"], "high"))
    loose = F.transform(_matches(NEXT_ROUTE, 2, F.coalesce("manifest", F.lit(""))), lambda m: row(m["g1"], F.regexp_extract_all(m["g2"], F.lit(r"\"([^\"]+\.js)\""), F.lit(1)), "medium"))
    both = F.when(F.coalesce(F.size("listed"), F.lit(0)) > 0, strict).otherwise(F.filter(loose, lambda x: F.size(x["chunks"]) > 0))
    placed = F.transform(both, lambda x: F.struct(x["route"].alias("route"), x["sure"].alias("sure"), F.transform(x["chunks"], place).alias("deps")))
    return F.transform(placed, lambda x: _route(x["route"], F.lit(""), F.coalesce(F.get(x["deps"], F.lit(0)), F.lit("")), "next", "next_manifest", x["sure"], x["deps"]))


def next_assets(found: Column) -> Column:
    """Manifest and chunk URLs."""
    given = F.regexp_extract("body", NEXT_BUILD, 1)
    build = F.when(given != "", given).otherwise(F.regexp_extract("url", NEXT_MANIFEST, 1))
    names = F.when(build != "", F.transform(F.array(*map(F.lit, ("_buildManifest", "_ssgManifest", "app-build-manifest"))), lambda n: F.concat(F.lit("/_next/static/"), build, F.lit("/"), n, F.lit(".js")))).otherwise(_strings())
    paths = F.concat(names, F.regexp_extract_all("body", F.lit(NEXT_MANIFEST), F.lit(0)), F.regexp_extract_all("body", F.lit(NEXT_CHUNK), F.lit(0)))
    return F.transform(F.array_distinct(F.transform(paths, lambda p: urls.joined(F.col("url"), p))), lambda u: _asset(u, "next", F.lit("next_manifest"), F.lit("high")))


def nuxt_routes() -> Column:
    route = lambda r: F.when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r))
    return F.transform(_matches(NUXT_ROUTE, 2), lambda m: _route(route(m["g1"]), F.lit(""), urls.joined(F.col("url"), m["g2"]), "nuxt", "nuxt_static", F.lit("medium")))


def nuxt_assets(found: Column) -> Column:
    paths = F.array_distinct(F.regexp_extract_all("body", F.lit(NUXT_PATH), F.lit(0)))
    return F.transform(paths, lambda p: _asset(urls.joined(F.col("url"), p), "nuxt", F.lit("nuxt_static"), F.lit("medium")))


def _packed(own: Column, kind: str) -> Column:
    return F.when(F.col("body").rlike(r"__webpack_require__|self\.webpackChunk|webpackJsonp"), own).otherwise(_none(kind))


def angular_imports() -> Column:
    """Webpack's findings where its runtime shows."""
    return F.concat(_packed(webpack_imports(), IMPORTS), dynamic_imports_in("angular"))


def angular_routes() -> Column:
    lazy = F.transform(_matches(LOAD_CHILDREN, 1), lambda m: _route(F.lit(""), F.lit(""), urls.joined(F.col("url"), m["g1"]), "angular", "regex_candidate", F.lit("medium")))
    return F.concat(_packed(routes_in("webpack"), ROUTES), lazy)


def angular_assets(found: Column) -> Column:
    """Webpack's assets, classed by name."""
    low = lambda x: F.lower(x["asset_url"])
    kind = lambda x: F.when(low(x).contains("runtime"), "runtime_js").when(low(x).contains("polyfills"), "vendor_js").when(low(x).contains("main"), "entry_js").otherwise(x["type"])
    return F.transform(webpack_assets(found), lambda x: _asset(x["asset_url"], "webpack", x["source"], x["confidence"], kind(x)))


def generic_assets(found: Column) -> Column:
    """Quoted paths first and resolved imports after."""
    return F.concat(_of_paths("unknown"), _of_imports(found, "unknown"))


#: By route_key: imports, routes, and assets given the imports.
ANALYSES = {
    "vite": (vite_imports, lambda: asset_map_in()[1], vite_assets),
    "webpack": (webpack_imports, lambda: routes_in("webpack"), webpack_assets),
    "next": (lambda: dynamic_imports_in("next"), next_routes, next_assets),
    "nuxt": (lambda: dynamic_imports_in("nuxt"), nuxt_routes, nuxt_assets),
    "angular": (angular_imports, angular_routes, angular_assets),
    "generic": (dynamic_imports_in, routes_in, generic_assets),
}


def analysis(lexed: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imports, routes and distinct assets by one framework's analysis, of scripts that are dispatched to it or, in a
    table without route_key, of all."""
    own = lexed.where(F.col("route_key") == key) if "route_key" in lexed.columns else lexed
    rows = prepared(own if "lex" in own.columns else own.withColumn("lex", F.lit(None).cast(LEXED)))
    imports, seen, assets = ANALYSES[key]
    rows = rows.withColumns({"found": imports(), "paths": paths_in()})
    return _rows(rows, F.col("found")), _rows(rows, seen()), first_of(_rows(rows, assets(F.col("found"))), "url", "asset_url")


def _by_key(parts: dict[str, Column], kind: str) -> Column:
    out = None
    for key, c in parts.items():
        out = F.when(F.col("route_key") == key, c) if out is None else out.when(F.col("route_key") == key, c)
    return F.coalesce(out, _none(kind))


def analysed(lexed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imports, routes and assets of all scripts: token findings first, then the analysis of their
    framework, then quoted paths not known yet (J11, J22, J23).

    ``lexed`` is ``dispatched(scanned(js))``. A script's findings of a kind are one array, whose
    framework part is a CASE on route_key: each of the three results reads the scripts once.
    """
    rows = prepared(lexed).withColumns({"tokens": token_imports_in(), "found": _by_key({k: f[0]() for k, f in ANALYSES.items()}, IMPORTS), "paths": paths_in()})
    extra = F.when(F.col("framework") != "unknown", _of_paths("")).otherwise(_none(ASSETS))
    assets = F.concat(_of_imports(F.col("tokens"), ""), _by_key({k: f[2](F.col("found")) for k, f in ANALYSES.items()}, ASSETS), extra)
    return (
        first_of(_rows(rows, F.concat("tokens", "found")), "url", "raw"),
        first_of(_rows(rows, F.concat(token_routes_in(), _by_key({k: f[1]() for k, f in ANALYSES.items()}, ROUTES))), "url", "route", "lazy_js"),
        first_of(_rows(rows, assets), "url", "asset_url"),
    )


def discovered(lexed: DataFrame) -> DataFrame:
    """New asset URLs of every script, first wins."""
    return analysed(lexed)[2].where("asset_url <> ''")


def paths_in_text(texts: DataFrame) -> DataFrame:
    """Script paths in any text, by line: absolute ones against ``entry_url``, relative ones against ``url``."""
    lines = texts.select("url", "entry_url", F.posexplode(F.split(F.replace("body", F.lit("\\/"), F.lit("/")), "\n")).alias("line", "l"))
    rows = lines.select("url", "line", F.posexplode(F.concat(
        F.transform(F.regexp_extract_all("l", F.lit(PATH_IN_TEXT), F.lit(1)), lambda p: urls.joined(F.col("entry_url"), p)),
        F.transform(F.regexp_extract_all("l", F.lit(RELATIVE_IN_TEXT), F.lit(1)), lambda p: urls.joined(F.col("url"), p)),
    )).alias("k", "asset_url"))
    return first_of(rows.withColumn("ord", F.col("line").cast("long") * (1 << 20) + F.col("k")).select("url", "ord", "asset_url"), "url", "asset_url")


def urls_in_log(lines: DataFrame) -> DataFrame:
    """http(s) URLs of log lines, those after url: first, distinct (J27). Columns line_id, line."""
    after = F.filter(F.regexp_extract_all("line", F.lit(r"url:([^ \t),]+)"), F.lit(1)), lambda u: u.rlike("^https?://"))
    plain = F.regexp_extract_all("line", F.lit(r"(https?://[^ \t\"'),>]*)"), F.lit(1))
    return lines.select("line_id", F.posexplode(F.array_distinct(F.concat(after, plain))).alias("ord", "url"))


def static_endpoints(lexed: DataFrame) -> DataFrame:
    """Endpoint candidates of the tokens: raw_url, method and parameter names (A1)."""
    from webloom.functions import requests

    rows = lexed.where("lex.parse_ok").select("url", F.posexplode("lex.calls").alias("ord", "c")).select(F.col("url").alias("source_js_url"), "ord", F.col("c.raw").alias("raw_url"), F.col("c.call").alias("call"), F.col("c.method").alias("given"), F.col("c.names").alias("names"))
    method = requests.http_method(F.col("given"), F.col("call"))
    kind = F.when(F.col("call") == "import", "import").when(F.col("call") == "", "string").otherwise(F.col("call"))
    return rows.where(requests.is_endpoint_candidate(F.col("raw_url"), kind)).select("source_js_url", "ord", "raw_url", method.alias("method"), kind.alias("type"), "names")
