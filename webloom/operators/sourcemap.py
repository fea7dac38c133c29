"""Source maps: directives, data URLs, sections, application sources, and folding of generated code.

Maps are flattened by one Arrow pass, since sections nest; what is decided about the files
(caps, completeness, paths) is windows and aggregates on its rows.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.vectorized import vectorized
from webloom.functions import js_lexer, urls

INPUT_BYTES, FILES, CONTENT_BYTES, SECTION_DEPTH = 128 << 20, 512, 64 << 20, 4
#: Marks of sources that are no application code, and extensions of those that are.
EXCLUDED = ("node_modules/", "webpack/runtime", "webpack/bootstrap", "(webpack)/", "/@vite/", "\x00", "virtual:", "<stdin>", "<anonymous>")
EXTENSIONS = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".vue")


@vectorized("string")
def map_reference(body: pd.Series) -> pd.Series:
    """Last sourceMappingURL inside a comment; strings that look like one don't count."""
    return body.map(lambda b: js_lexer.read(b)["map_reference"] if b else "")


def adjacent_map(url: Column) -> Column:
    """Map beside a bundle; its query stays."""
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit(".map"), F.regexp_extract(url, r"(\?[^#]*)", 1))


def decoded(value: str | None) -> bytes | None:
    """Bytes of a data URL, null if it is none, malformed or too long."""
    if not value or not value[:5].lower() == "data:" or "," not in value:
        return None
    meta, _, text = value.partition(",")
    if ";base64" not in meta.lower():
        out = unquote_to_bytes(text)
        return out if len(out) <= INPUT_BYTES else None
    text = text.replace("\r", "").replace("\n", "")
    if len(text) * 3 // 4 > INPUT_BYTES + 2:
        return None
    try:
        return base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None


@vectorized("binary")
def decode_data_url(value: pd.Series) -> pd.Series:
    return value.map(decoded)


def collected(text: str | bytes | None, resolve: dict[str, str] | None = None, depth: int = 0, active: frozenset[str] = frozenset()) -> tuple[list[tuple[str, str | None]], bool]:
    """((name, content) of every source, whether nothing was wrong) of a map and its sections."""
    try:
        data = json.loads(text or "")
    except (ValueError, RecursionError):
        return [], False
    if not isinstance(data, dict) or type(data.get("version")) is not int or data["version"] != 3 or depth > SECTION_DEPTH:
        return [], False
    found: list[tuple[str, str | None]] = []
    ok = True
    names, contents, root = data.get("sources"), data.get("sourcesContent"), data.get("sourceRoot") or ""
    if "sections" not in data:
        if not isinstance(names, list):
            return [], False
        contents = contents if isinstance(contents, list) else []
        for k, name in enumerate(names):
            if not isinstance(name, str):
                ok = False
                continue
            has = k < len(contents) and isinstance(contents[k], str)
            found.append((f"{root.rstrip('/')}/{name.lstrip('/')}" if root else name, contents[k] if has else None))
        return found, ok
    last = (-1, -1)
    for section in data["sections"] if isinstance(data["sections"], list) else [None]:
        offset = section.get("offset") if isinstance(section, dict) else None
        place = (offset.get("line"), offset.get("column")) if isinstance(offset, dict) else (None, None)
        if not all(type(x) is int and x >= 0 for x in place) or place <= last or ("map" in section) == ("url" in section):
            ok = False
            continue
        last = place
        if "map" in section:
            inner, fine = collected(json.dumps(section["map"]), resolve, depth + 1, active)
        else:
            there = section["url"]
            known = (resolve or {}).get(there)
            inner, fine = ([], False) if known is None or there in active else collected(known, resolve, depth + 1, active | {there})
        found += inner
        ok &= fine
    return found, ok


_FILE = pa.schema([("url", pa.string()), ("pos", pa.int64()), ("name", pa.string()), ("content", pa.string()), ("complete", pa.bool_()), ("n_sources", pa.int64())])


def flattened(maps: DataFrame) -> DataFrame:
    """(url, map_text) to a row for each source: url, pos, name, content, complete, n_sources (P3). Maps without sources give a row with pos -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for url, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    files, ok = collected(text)
                    rows += [(url, k, n, c, ok, len(files)) for k, (n, c) in enumerate(files)] or [(url, -1, None, None, ok, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FILE, strict=True)], schema=_FILE)

    return maps.select("url", "map_text").mapInArrow(run, "url string, pos long, name string, content string, complete boolean, n_sources long")


def application_path(name: Column) -> Column:
    """Safe relative path of an application source, empty for any other."""
    text = F.replace(F.trim(name), F.lit("\\"), F.lit("/"))
    low = F.lower(text)
    out = F.lit(False)
    for mark in EXCLUDED:
        out = out | low.contains(mark)
    bare = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?", "")
    clean = urls.without_dots(F.concat(F.lit("/"), F.regexp_replace(bare, r"[?#].*$", "")))
    ending = F.lower(F.regexp_extract(clean, r"(\.[^./]*)$", 1))
    parts = F.filter(F.transform(F.split(clean, "/"), lambda p: F.regexp_replace(F.regexp_replace(p, r"[^A-Za-z0-9._-]", "_"), r"^[._]+|[._]+$", "")), lambda p: p != "")
    return F.when(out | ~ending.isin(*EXTENSIONS), "").otherwise(F.array_join(parts, "/"))


def application_sources(files: DataFrame) -> DataFrame:
    """Application sources with content, as many as the caps of files and bytes allow."""
    app = files.withColumn("path", application_path(F.col("name"))).where("path <> '' and content <> ''").withColumn("size", F.octet_length("content"))
    order = Window.partitionBy("url").orderBy("pos")
    return app.withColumns({"nth": F.row_number().over(order), "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))}).where((F.col("nth") <= FILES) & (F.col("upto") <= CONTENT_BYTES))


def recoveries(files: DataFrame) -> DataFrame:
    """Per map: source_count and content_size of all its application sources, those beyond the caps and
    those without content included, complete and status (P5)."""
    app = files.withColumn("path", application_path(F.col("name")))
    own = app.groupBy("url").agg(
        F.bool_and("complete").alias("whole"), F.count_if(F.col("path") != "").alias("source_count"),
        F.coalesce(F.sum(F.when(F.col("path") != "", F.octet_length("content"))), F.lit(0)).cast("long").alias("content_size"),
    )
    kept = application_sources(files).groupBy("url").agg(F.count(F.lit(1)).alias("n_kept"))
    rows = own.join(kept, "url", "left").na.fill(0, ["n_kept"])
    return rows.select("url", "source_count", "content_size", (F.col("whole") & (F.col("n_kept") > 0) & (F.col("n_kept") == F.col("source_count"))).alias("complete"), F.when(F.col("n_kept") > 0, "used").otherwise("no_application_sources").alias("status"))


def analysis_units(bundles: DataFrame, files: DataFrame) -> DataFrame:
    """Scripts to analyse: recovered sources where a map is complete, else the bundle itself (P6). ``bundles``: url, body."""
    whole = recoveries(files).where("complete").select("url")
    named = application_sources(files).join(whole, "url", "left_semi")
    base = F.when(F.col("name").rlike("^https?://"), F.col("name")).otherwise(F.col("url"))
    recovered = named.select(F.col("url").alias("bundle"), F.col("path").alias("source_name"), base.alias("url"), F.col("content").alias("body"))
    plain = bundles.join(whole, "url", "left_anti").select(F.col("url").alias("bundle"), F.col("url").alias("source_name"), "url", "body")
    return recovered.unionByName(plain)


def folded(body: str | None) -> str | None:
    """Joins adjacent string literals, re-quotes escaped ones and drops branches of constant conditions on
    tokens (P7, P8); a text that doesn't lex stays as it is. Brings no new statement of a lone string."""
    code, ok = js_lexer.tokens(body or "")
    if not ok:
        return body
    code = [t for t in code if t[0] != "comment"]
    out: list[tuple[str, str]] = []
    for t in code:
        if t[0] == "string":
            t = ("string", json.dumps(js_lexer.literal(t), ensure_ascii=False))
            before = out[-3][1] if len(out) > 2 else ";"
            if len(out) > 1 and out[-1][1] == "+" and out[-2][0] == "string" and before in ("(", "=", "[", ",", ":", "return", "?", "+", "=>"):
                t = ("string", json.dumps(json.loads(out[-2][1]) + json.loads(t[1]), ensure_ascii=False))
                del out[-2:]
        out.append(t)
    return " ".join(x[1] for x in _alive(out)) + "\n"


def _alive(code: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Without the branch of ``if (true|false) {...} else {...}`` that never runs, unless either declares a name,
    and with the operand of ``true|false ? a : b`` that is taken."""
    at = 0
    while at < len(code):
        if code[at][1] in ("true", "false") and code[at][0] != "string" and at + 1 < len(code) and code[at + 1][1] == "?" and (at == 0 or code[at - 1][1] in BEFORE_TERNARY):
            middle, last = _operand(code, at + 2), -1
            if 0 < middle < len(code) and code[middle][1] == ":":
                last = _operand(code, middle + 1)
            if last > middle + 1 and middle > at + 2 and (last == len(code) or code[last][1] in AFTER_TERNARY):
                code = code[:at] + (code[at + 2 : middle] if code[at][1] == "true" else code[middle + 1 : last]) + code[last:]
                continue
        words = [t[1] for t in code[at : at + 5]]
        if words[:2] == ["if", "("] and len(words) == 5 and words[2] in ("true", "false") and words[3:] == [")", "{"]:
            end = _closing(code, at + 4)
            other = end + 2 if [t[1] for t in code[end + 1 : end + 3]] == ["else", "{"] else -1
            last = _closing(code, other) if other > 0 else end
            branches = [code[at + 5 : end], code[other + 1 : last] if other > 0 else []]
            if not any(t[1] in ("var", "let", "const", "function", "class") for b in branches for t in b):
                code = code[:at] + branches[words[2] == "false"] + code[last + 1 :]
                continue
        at += 1
    return code


#: A constant condition counts only where an expression begins, and its last operand only up to where one ends.
BEFORE_TERNARY = ("(", "[", "{", ",", ";", "=", ":", "return", "=>", "}")
AFTER_TERNARY = (")", "]", "}", ",", ";", ":")


def _operand(code: list[tuple[str, str]], at: int) -> int:
    """Where the operand at ``at`` ends: the first mark outside brackets that ends an expression or parts a ternary; -1 if it holds one itself."""
    depth = 0
    for k in range(at, len(code)):
        word = code[k][1] if code[k][0] != "string" else ""
        if word in ("(", "[", "{"):
            depth += 1
        elif word in (")", "]", "}"):
            if not depth:
                return k
            depth -= 1
        elif not depth and word == "?":
            return -1
        elif not depth and word in (":", ",", ";"):
            return k
    return len(code)


def _closing(code: list[tuple[str, str]], at: int) -> int:
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k][1] == "{") - (code[k][1] == "}")
        if not depth:
            return k
    return len(code) - 1


@vectorized("string")
def fold(body: pd.Series) -> pd.Series:
    return body.map(folded)


def summaries(maps: DataFrame) -> DataFrame:
    """Per map: status, number of sources, and whether contents are there, by JSON functions alone."""
    parsed = maps.withColumn("m", F.from_json("map_text", "version int, sources array<string>, sourcesContent array<string>"))
    good = (F.col("m.version") == 3) & F.col("m.sources").isNotNull()
    return parsed.select(
        "url", F.when(good, "parsed").otherwise("failed").alias("status"), F.when(good, F.size("m.sources")).otherwise(0).cast("long").alias("source_count"),
        F.coalesce(F.exists("m.sourcesContent", lambda c: F.coalesce(c, F.lit("")) != ""), F.lit(False)).alias("has_sources_content"),
    )


def content_findings(maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dynamic imports and routes of the sources that maps carry."""
    from webloom.operators import javascript

    parsed = maps.withColumn("m", F.from_json("map_text", "sources array<string>, sourcesContent array<string>"))
    each = parsed.select("url", F.posexplode("m.sourcesContent").alias("source", "body")).where("body is not null")
    return javascript.dynamic_imports(each), javascript.routes(each)
