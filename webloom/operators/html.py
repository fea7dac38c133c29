"""Tags of HTML pages and the entry scripts they name (H1-H8).

``tags`` is the one Arrow pass (a tokenizer, with raw-text rules for scripts); everything
else is DataFrame work on its rows: url, pos, name, attrs, body.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators.javascript import DYNAMIC_IMPORT, STATIC_IMPORT, first_of, import_url

#: Folders that make a quoted path in an inline script worth keeping.
FOLDERS = ("/assets/", "/static/", "/_next/static/", "/_nuxt/", "/chunks/", "./assets/", "./static/", "../assets/")
ASSETS = ("url", "ord", "asset_url", "type", "source", "confidence")


class Tags(HTMLParser):
    """Start and self-closing tags with lower-case names, decoded attributes (the last of a name wins) and script text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, dict[str, str], str]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found.append((tag, {k: v or "" for k, v in attrs}, ""))
        self.inside = tag == "script"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found.append((tag, {k: v or "" for k, v in attrs}, ""))

    def handle_endtag(self, tag: str) -> None:
        self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            name, attrs, body = self.found[-1]
            self.found[-1] = (name, attrs, body + data)


def inline_paths(body: str) -> list[str]:
    """Quoted script paths below a known folder (H4); a quote closes unless a backslash is before it."""
    out, at = [], 0
    while at < len(body):
        if body[at] in "\"'`":
            end = at + 1
            while end < len(body) and not (body[end] == body[at] and body[end - 1] != "\\"):
                end += 1
            text = body[at + 1 : end]
            if end < len(body) and text.endswith((".js", ".mjs")) and any(f in text for f in FOLDERS):
                out.append(text)
            at = end
        at += 1
    return out


_TAG = pa.schema([("url", pa.string()), ("pos", pa.int64()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("paths", pa.list_(pa.string()))])


def tags(pages: DataFrame) -> DataFrame:
    """Rows of (url, html) as tags in document order (H1), with the quoted paths of script bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    reader = Tags()
                    reader.feed(html or "")
                    reader.close()
                    rows += [(url, k, n, list(a.items()), b, inline_paths(b) if b else []) for k, (n, a, b) in enumerate(reader.found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TAG, strict=True)], schema=_TAG)

    return pages.select("url", "html").mapInArrow(run, "url string, pos long, name string, attrs map<string,string>, body string, paths array<string>")


def attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def bases(found: DataFrame) -> DataFrame:
    """(url, base): the first base tag that has an href decides, even an empty one (H2)."""
    first = found.where((F.col("name") == "base") & F.array_contains(F.map_keys("attrs"), "href")).groupBy("url").agg(F.min_by(attr("href"), "pos").alias("href"))
    rows = found.select("url").distinct().join(first, "url", "left")
    base = urls.joined(F.col("url"), F.col("href"))
    return rows.select("url", F.when(F.coalesce("href", F.lit("")) == "", F.col("url")).otherwise(F.coalesce(base, F.col("url"))).alias("base"))


def entry_assets(found: DataFrame) -> DataFrame:
    """Entry scripts of each page, first wins in document order (H3, H5)."""
    t = found.join(bases(found), "url")
    kind = lambda c: F.lower(F.trim(c))
    inline = (F.col("name") == "script") & (attr("src") == "") & (F.col("body") != "")
    module = kind(attr("type")) == "module"
    imports = F.concat(
        F.transform(F.regexp_extract_all("body", F.lit(STATIC_IMPORT), F.lit(1)), lambda p: import_url(p, F.col("base"))),
        F.transform(F.regexp_extract_all("body", F.lit(DYNAMIC_IMPORT), F.lit(0)), lambda m: import_url(F.concat(*[F.regexp_extract(m, DYNAMIC_IMPORT, k) for k in (1, 2, 3)]), F.col("base"))),
    )
    inside = F.concat(F.transform("paths", lambda p: urls.joined(F.col("base"), p)), F.when(module, F.filter(imports, lambda u: u != "")).otherwise(F.array().cast("array<string>")))
    rel = F.split(F.lower(F.trim(attr("rel"))), r"\s+")
    has = lambda token: F.array_contains(rel, token)
    linked = (
        F.when(has("modulepreload"), F.struct(F.lit("modulepreload").alias("source"), F.lit("medium").alias("confidence")))
        .when(has("preload"), F.when(kind(attr("as")) == "script", F.struct(F.lit("preload").alias("source"), F.lit("medium").alias("confidence"))))
        .when(has("prefetch"), F.struct(F.lit("prefetch").alias("source"), F.lit("low").alias("confidence")))
    )
    row = lambda u, s, c: F.struct(u.alias("asset_url"), s.alias("source"), c.alias("confidence"))
    one = lambda u, s, c: F.array(row(urls.joined(F.col("base"), u), s, c))
    rows = (
        F.when((F.col("name") == "script") & (attr("src") != ""), one(attr("src"), F.lit("html_script"), F.lit("high")))
        .when(inline, F.transform(inside, lambda u: row(u, F.lit("inline_script"), F.lit("medium"))))
        .when((F.col("name") == "link") & (attr("href") != "") & linked.isNotNull(), one(attr("href"), linked["source"], linked["confidence"]))
    )
    each = t.select("url", "pos", F.posexplode(rows).alias("k", "a")).select("url", (F.col("pos") * (1 << 20) + F.col("k")).alias("ord"), "a.*").withColumn("type", F.lit("entry_js"))
    return first_of(each.where("asset_url is not null"), "url", "asset_url").select(*ASSETS)


def module_scripts(found: DataFrame) -> DataFrame:
    """External scripts whose type is exactly module (H6)."""
    t = found.join(bases(found), "url").where((F.col("name") == "script") & (attr("type") == "module") & (attr("src") != ""))
    return t.select("url", "pos", urls.joined(F.col("base"), attr("src")).alias("asset_url"))


def inline_modules(found: DataFrame) -> DataFrame:
    """Whether a page has an inline module script (H6)."""
    return found.groupBy("url").agg(F.bool_or((F.col("name") == "script") & (attr("type") == "module") & (attr("src") == "") & (F.trim("body") != "")).alias("has_inline_module"))


def tag_attr(tag: Column, name: str) -> Column:
    """Value of an attribute with exactly this name in a tag's text, quoted or bare, first of it (H8)."""
    pattern = rf"(?i)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def rendered_assets(pages: DataFrame, domains: list[str]) -> DataFrame:
    """Scripts of a rendered DOM by line; prefetch needs as=script here (H7). ``pages``: url, html."""
    lines = pages.select("url", F.posexplode(F.split("html", "\n")).alias("line", "text"))
    each = lines.select("url", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?i)<(?:script|link)\b[^>]*>"), F.lit(0))).alias("k", "tag"))
    script = F.lower("tag").startswith("<script")
    rel, kind = F.lower(F.trim(tag_attr(F.col("tag"), "rel"))), F.lower(F.trim(tag_attr(F.col("tag"), "as")))
    link = ~script & ((rel == "modulepreload") | (rel.isin("preload", "prefetch") & (kind == "script")))
    raw = F.when(script, tag_attr(F.col("tag"), "src")).when(link, tag_attr(F.col("tag"), "href"))
    text = urls.unescaped(raw)
    rows = each.where("tag is not null").select("url", (F.col("line").cast("long") * (1 << 20) + F.col("k")).alias("ord"), F.when(text != "", urls.joined(F.col("url"), text)).alias("asset_url"), F.when(script, "high").otherwise("medium").alias("confidence"))
    kept = rows.where(F.col("asset_url").rlike("^https?://") & urls.allowed_domain(F.col("asset_url"), domains, F.col("url")))
    return first_of(kept, "url", "asset_url").select("url", "ord", "asset_url", F.lit("entry_js").alias("type"), F.lit("headless_dom").alias("source"), "confidence")
