"""Order rules and edge cases that the table queries don't reach."""

import pytest
from pyspark.sql import functions as F

from webloom.operators import assets, association, crawl, html, javascript
from webloom.sources import io


def test_crawl_depth_budget_and_confidence(spark):
    links = [("a", "b", 0, "high", True), ("a", "c", 1, "low", True), ("a", "d", 2, "medium", True), ("b", "a", 0, "high", True), ("b", "e", 1, "high", True), ("d", "f", 0, "high", False), ("e", "g", 0, "high", True)]
    table = spark.createDataFrame(links, "from_url string, url string, ord int, confidence string, fetchable boolean")
    entry = spark.createDataFrame([("o", "a", 0), ("o", "a", 1)], "origin string, url string, ord int")
    rows = {r["url"]: (r["depth"], r["from_url"]) for r in crawl.crawled(entry, table, max_depth=2).collect()}
    assert rows == {"a": (0, ""), "b": (1, "a"), "d": (1, "a"), "e": (2, "b")}
    assert {r["url"] for r in crawl.crawled(entry, table, 10, budget=2).collect()} == {"a", "b"}


def test_upsert_rules(spark):
    rows = [(1, "candidate", "low", "", 0, "unknown_js", "regex_candidate", 3), (2, "confirmed", "medium", "f", 9, "entry_js", "preload", 2), (3, "failed", "low", "", 0, "vendor_js", "html_script", 5)]
    df = spark.createDataFrame([("s", "u", o, st, c, f, "", "", z, t, so, d, f"w{o}") for o, st, c, f, z, t, so, d in rows], "site string, url string, ord int, status string, confidence string, from_url string, content_type string, hash string, size long, type string, source string, depth int, framework string")
    r = assets.merged(df).first()
    assert (r["status"], r["confidence"], r["from_url"], r["size"], r["type"], r["source"], r["depth"], r["framework"]) == ("confirmed", "low", "f", 9, "entry_js", "preload", 2, "w1")


def test_first_base_wins_even_if_empty(spark):
    page = spark.createDataFrame([("https://h/d/p", '<base><base href=""><base href="/x/"><script src=a.js></script>')], "url string, html string")
    assert [r["asset_url"] for r in html.entry_assets(html.tags(page)).collect()] == ["https://h/d/a.js"]
    assert html.inline_paths("""x = "it's"; y = '/assets/a.js', z = `./static/b\\`c.mjs`""") == ["/assets/a.js", "./static/b\\`c.mjs"]


def test_lexer_fallback_and_wildcards(spark):
    js = spark.createDataFrame([("https://h/a.js", 'import("./x.js"); ({'), ("https://h/b.js", "fetch(`/api/${id}/open`, {method: 'put', size: 1})")], "url string, body string")
    lexed = javascript.scanned(js)
    assert [r["resolved_url"] for r in javascript.token_imports(lexed).collect()] == ["https://h/x.js"]
    assert [(r["raw_url"], r["method"]) for r in javascript.static_endpoints(lexed).collect()] == [("/api/EXPR/open", "PUT")]


def test_association_edges(spark):
    none = F.array().cast("array<struct<name:string,value:string>>")
    static = spark.createDataFrame([(1, "", "/user/list", "", "https://a/m.js"), (2, "", "/list", "", "https://a/m.js"), (3, "", "//b/user/list", "GET", ""), (4, "https://a/", "/EXPR/list", "GET", "")], "static_id long, entry_url string, raw_url string, method string, source_js_url string")
    requests = spark.createDataFrame([(9, "https://b:443/gw/user/list", "GET", "XHR", "https://a/", "https://a/m.js"), (8, "https://b/superuser/list", "GET", "fetch", "https://a/", "")], "request_id long, url string, method string, resource_type string, entry_url string, initiator_url string")
    static = static.withColumns({"query_params": none, "body_params": none, "type": F.lit(""), "source": F.lit("")})
    requests = requests.withColumns({"query_params": none, "body_params": none, "stack_urls": F.array().cast("array<string>"), "preflight": F.lit(False), "websocket": F.lit(False)})
    rows = {(r["static_id"], r["request_id"]): r for r in association.associated(static, requests).collect()}
    assert set(rows) == {(1, 9), (2, 9), (2, 8)} - {(2, 8)}
    assert rows[(1, 9)]["score"] == 75 and rows[(1, 9)]["runtime_base"] == "https://b/gw" and rows[(1, 9)]["evidence"] == ["path_suffix", "initiator_exact"]


def test_lists_sinks_and_artifacts(spark, tmp_path):
    (tmp_path / "list").write_text(" https://a/ \n# no\n\nb.example:8080\nmailto:x\nhttps://a/\n")
    got = {r["url"] for r in io.entries(io.url_list(spark, str(tmp_path / "list"))).collect()}
    assert got == {"https://a/", "https://b.example:8080"}
    pairs = spark.createDataFrame([("u2", "p"), ("u1", "q"), ("u1", "q")], "url string, path string")
    io.write_lines(io.map_lines(pairs), str(tmp_path / "map"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "map")).collect()] == ["u1\tq", "u2\tp"]
    io.write_report(str(tmp_path / "report"), endpoints=pairs)
    io.write_sites(pairs.withColumn("site", F.lit("s")), str(tmp_path / "sites"))
    assert spark.read.parquet(str(tmp_path / "sites")).count() == 3 and spark.read.json(str(tmp_path / "report" / "endpoints.jsonl")).count() == 3
    rows = spark.createDataFrame([(1, "d/a.js", "x"), (2, "d/a.js", "y"), (3, "e/b.js", "x")], "ord long, path string, content string")
    paths = {r["hash"]: r["path"] for r in assets.artifacts(rows).collect()}
    assert sorted(paths.values())[1] == "d/a.js" and all(p.startswith("d/a") for p in paths.values())
    bodies = spark.createDataFrame([("var a = 1; window.x = a",), ("<!DOCTYPE html><p>var </p>",), ('{"var ": 1, "window.": 2}',), ("short",), ("import x from 'y'",)], "b string")
    assert [r[0] for r in bodies.select(io.looks_like_js(F.col("b"))).collect()] == [True, False, False, False, True]


@pytest.mark.parametrize("listed", [20_000, 1])
def test_candidates_without_an_entry_take_every_confirmed_base(spark, monkeypatch, listed):
    monkeypatch.setattr(association, "LISTED", listed)
    none = F.array().cast("array<struct<name:string,value:string>>")
    static = spark.createDataFrame([(1, "", "/user/list?x=1", "", ""), (2, "https://a/", "/gw/one", "", ""), (3, "https://c/", "../up?q=2", "", ""), (4, "https://a/", "//cdn/api", "GET", "")], "static_id long, entry_url string, raw_url string, method string, source_js_url string")
    static = static.withColumns({"query_params": none, "body_params": none, "type": F.lit(""), "source": F.lit("")})
    bases = spark.createDataFrame([("https://b/gw", "https://a/", "https://b", "/gw", 3, 200, "confirmed"), ("https://d", "https://e/", "https://d", "", 2, 150, "confirmed"), ("https://f", "https://a/", "https://f", "", 9, 90, "candidate")], "runtime_base string, entry_url string, origin string, prefix string, evidence_count long, total_score long, confidence string")
    entries = spark.createDataFrame([("https://a/",)], "entry_url string")
    got = {r["static_id"]: r["resolved_candidates"] for r in association.candidates(association.reportable(static, entries), bases).collect()}
    assert got == {1: ["https://b/gw/user/list", "https://d/user/list"], 2: ["https://b/gw/one"], 3: ["https://c/up?q=2"], 4: ["https://cdn/api"]}
