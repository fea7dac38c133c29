"""Column functions against the Python forms, and edge cases that the tables don't hold."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import js_lexer, requests, urls
from webloom.operators import sourcemap
from webloom.sources.io import Options, decompressed


def test_joined_equals_resolved(spark):
    bases = ["https://a.example.com/x/y.js?q=1", "http://h/", "https://h.example/a/b/c/"]
    refs = ["a.js", "./a/../b.js", "../../z.js", "/abs/../k.js?x#y", "//cdn/x.js", "https://z/i.js#f", "..", "a/./b/..", "?only=query", "../../../../up.js"]
    rows = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.joined(F.col("b"), F.col("r")).alias("u")).collect()
    for x in got:
        if not x["r"].startswith("?"):
            assert x["u"] == urls.resolved(x["b"], x["r"]), (x["b"], x["r"])


def test_origins(spark):
    given_ = ["HTTPS://User@ExAmple.com:0443/x", "http://h:80", "http://h:8080/?q", "ftp://h/", "http://", "https://h:70000/", "http://[::1]:81/", "https://bücher.example/", None, "http://10.0.0.1"]
    want_any = ["https://example.com", "http://h", "http://h:8080", None, None, None, "http://[::1]:81", "https://xn--bcher-kva.example", None, "http://10.0.0.1"]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(given_)], "k int, u string").select("k", urls.origin(F.col("u")).alias("o"), urls.origin_any(F.col("u")).alias("a")).orderBy("k").collect()
    assert [r["a"] for r in rows] == want_any
    assert [r["o"] for r in rows] == [w if w and "[" not in w and "xn--" not in w else None for w in want_any]


def test_lexer_reads_what_patterns_would_miss():
    found = js_lexer.read("/* import('no') */ const s = 'import(\"no2\")'; import('./yes.js'); export * from './also.js'; ({path: '/r'}); var r = /import\\('x'\\)/;")
    assert found["parse_ok"] and found["imports"] == ["./yes.js", "./also.js"] and found["routes"] == ["/r"]
    assert not js_lexer.read("({")["parse_ok"] and not js_lexer.read("'open")["parse_ok"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_lexer_never_fails(text):
    js_lexer.read(text)


def test_json_parameters():
    assert requests.json_parameters('{"b":[{"c":1.50},2],"a":{"x":null,"y":true}}')[0] == [("a.x", ""), ("a.y", "true"), ("b", "2"), ("b.c", "1.50")]
    assert requests.json_parameters('{"a":1} x') is None and requests.json_parameters('["s"]')[0] == []
    params, _, names = requests.json_parameters('{"query":"query Q { a }","operationName":"Q","variables":{"id":7}}')
    assert params == [("operationName", "Q"), ("variables.id", "7")] and names == "Q"
    assert requests.cut_bytes("é" * 100, 5) == "éé"


def test_values_are_cut_between_characters(spark):
    texts = ["é" * 100, "a" * 127 + "é", "a" * 126 + "漢x", "🙂" * 40, "x" + "🙂" * 40, "xy" + "🙂" * 40, "", None, "b" * 128]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(requests.cut_value(F.col("t"))).collect()] == [t if t is None else requests.cut_bytes(t, 128) for t in texts]


def test_multipart():
    body = b'--b\r\nContent-Disposition: form-data; name="f"; filename="x"\r\n\r\nq\r\n--b\r\nContent-Disposition: form-data; name="t"\r\n\r\nv\r\n--b--\r\n'
    assert requests.multipart_parameters("multipart/form-data; boundary=b", body) == [("f", "[FILE]"), ("t", "")]


def test_sections_and_data_urls():
    inner = '{"version":3,"sources":["a.js"],"sourcesContent":["x"]}'
    both = '{"version":3,"sections":[{"offset":{"line":0,"column":0},"map":%s},{"offset":{"line":0,"column":0},"map":%s}]}' % (inner, inner)
    assert sourcemap.collected(both) == ([("a.js", "x")], False)
    assert sourcemap.collected(inner.replace("3", "2")) == ([], False)
    assert sourcemap.decoded("data:application/json;base64,eyJh\nfQ==") == b'{"a}' and sourcemap.decoded("data:,a%20b") == b"a b" and sourcemap.decoded("x") is None
    assert sourcemap.folded("if (true) { var a; }") == "if ( true ) { var a ; }\n"


def test_decompression_and_options():
    import gzip

    import pytest

    packed = gzip.compress(b"x" * 100)
    assert decompressed(packed, "gzip", 0) == (b"x" * 100, "") and decompressed(packed, "gzip", 10) == (None, "too large") and decompressed(b"plain", "gzip", 0) == (b"plain", "")
    assert Options(output="o", urls=("u",), api_discovery=True).headless
    with pytest.raises(ValueError):
        Options(output="", workers=0)
