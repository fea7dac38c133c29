"""Scans and sinks: URL lists, response tables, maps, endpoint lists and reports."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.vectorized import vectorized
from webloom.functions import urls

MEGABYTE = 1 << 20


@dataclass(frozen=True)
class Options:
    """Validated settings of a run."""

    output: str
    urls: tuple[str, ...] = ()
    list_file: str = ""
    workers: int = 5
    depth: int = 10
    budget: int = 0
    max_size_mb: int = 0
    timeout_s: float = 30.0
    body_cap_mb: int = 8
    headless: bool = False
    api_discovery: bool = False
    allowed_domains: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        wrong = [
            ("an entry URL or list is needed", not (self.urls or self.list_file)), ("an output folder is needed", not self.output), ("workers must be positive", self.workers < 1), ("depth must not be negative", self.depth < 0),
            ("budget must not be negative", self.budget < 0), ("size must not be negative", self.max_size_mb < 0), ("timeout must be positive", self.timeout_s <= 0), ("body cap must be positive", self.body_cap_mb < 1),
            ("size is too large", self.max_size_mb > (2**63 - 1) // MEGABYTE),
        ]
        said = [text for text, bad in wrong if bad]
        if said:
            raise ValueError("; ".join(said))
        if self.api_discovery and not self.headless:
            object.__setattr__(self, "headless", True)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of a list without blanks and comments, in order."""
    lines = spark.read.text(path).select(F.trim("value").alias("raw"), F.monotonically_increasing_id().alias("ord"))
    return lines.where((F.col("raw") != "") & ~F.col("raw").startswith("#"))


def entries(rows: DataFrame) -> DataFrame:
    """Normalized entry URLs, each once, first place kept (S2, S3). Columns raw, ord."""
    named = rows.select(urls.entry_url(F.col("raw")).alias("url"), "ord").where("url is not null")
    return named.groupBy("url").agg(F.min("ord").alias("ord"))


def single_flight(requests: DataFrame) -> DataFrame:
    """One fetch for each (entry, url)."""
    return requests.groupBy("entry_url", "url").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("waiting"))


def decompressed(data: bytes | None, encoding: str | None, limit: int) -> tuple[bytes | None, str]:
    """Decoded body and an error, empty if there is none; corrupt data stays as it is (S6). 0 is no limit."""
    data = data or b""
    name = (encoding or "").strip().lower()
    kind = {"gzip": 31, "x-gzip": 31, "deflate": 15}.get(name)
    if name == "br":
        try:
            with pa.CompressedInputStream(pa.BufferReader(data), "brotli") as stream:
                data = stream.read(limit + 1 if limit else None)
        except (OSError, pa.ArrowInvalid):
            pass
    if kind:
        reader = zlib.decompressobj(kind)
        try:
            out = reader.decompress(data, limit + 1 if limit else 0)
            data = out
        except zlib.error:
            pass
    return (None, "too large") if limit and len(data) > limit else (data, "")


def decompress(limit: int):
    @vectorized("body binary, error string")
    def run(data: pd.Series, encoding: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decompressed(d, e, limit) for d, e in zip(data, encoding, strict=True)], columns=["body", "error"])

    return run


# How markup begins, and what scripts say early on (compared in lower case).
MARKUP = ("<!doctype", "<html", "<script", "<?xml", "<svg")
SIGNS = ("__webpack_require__", "__vite__", "import(", "export ", "function(", "function ", "var ", "let ", "const ", "self.", "window.", "document.", "(()=>{", "(function(")


def looks_like_js(body: Column, parses: Column | None = None) -> Column:
    """No markup, JSON or image, it parses (by the lexer's flag, where given), and it has module statements or a sign early on."""
    text = F.trim(body)
    head = F.lower(F.substring(text, 1, 500))
    markup, shown = F.lit(False), text.rlike(r"(?m)^\s*(import|export)\b")
    for m in MARKUP:
        markup = markup | head.startswith(m)
    for s in SIGNS:
        shown = shown | head.contains(s)
    image = text.rlike(r"^(GIF87a|GIF89a|.PNG\r\n|RIFF....WEBP)")
    return (F.length(text) >= 10) & ~markup & ~image & F.try_parse_json(text).isNull() & shown & (F.lit(True) if parses is None else parses)


def outcome(status: Column, content_type: Column, body: Column) -> Column:
    """js, non_js or failed: the status, then an explicit content type, then sniffing."""
    typed = F.coalesce(F.trim(content_type), F.lit("")) != ""
    script = F.when(typed, urls.is_js_type(content_type)).otherwise(F.coalesce(looks_like_js(body), F.lit(False)))
    return F.when(~status.between(200, 299), "failed").when(script, "js").otherwise("non_js")


def allowed_redirects(hops: Column, domains: list[str], entry: Column, most: int = 10) -> Column:
    """At most ten hops, each to an allowed domain."""
    listed = [d for d in (urls.domain_name(d) for d in domains) if d]

    def fine(u: Column) -> Column:
        host = F.regexp_extract(F.lower(u), r"^https?://([^:/?#]+)", 1)
        out = urls.same_origin(u, entry)
        for d in listed:
            out = out | (host == d) | F.endswith(host, F.lit(f".{d}"))
        return out

    return (F.size(hops) <= most) & F.forall(hops, fine)


def send_cookies(url: Column, entry: Column) -> Column:
    return urls.same_origin(url, entry)  # S9


def with_maps(bundles: DataFrame, maps: DataFrame) -> DataFrame:
    """Bundles with the text of the map they name, else of the one beside them, if it was served.

    ``bundles``: url, map_url (may be empty). ``maps``: map_url, status_code, map_text.
    """
    from webloom.operators.sourcemap import adjacent_map

    wanted = bundles.withColumn("map_url", F.when(F.coalesce("map_url", F.lit("")) != "", F.col("map_url")).otherwise(adjacent_map(F.col("url"))))
    return wanted.join(maps.where(F.col("status_code").between(200, 299)).select("map_url", "map_text"), "map_url", "left")


def map_lines(outputs: DataFrame) -> DataFrame:
    """url, tab, path lines in order."""
    return outputs.select("url", "path").distinct().orderBy("url", "path").select(F.concat_ws("\t", "url", "path").alias("line"))


def endpoint_lines(found: DataFrame) -> DataFrame:
    """Distinct endpoint URLs in order."""
    return found.select("url").distinct().orderBy("url")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files in order; the commit protocol makes the replacement atomic."""
    lines.write.mode("overwrite").text(path)


def write_report(path: str, **parts: DataFrame) -> None:
    """JSON lines of each part below ``path``."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}.jsonl")


def write_sites(df: DataFrame, path: str) -> None:
    """Only the sites that ``df`` holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)


def fetch_hash(body: Column) -> Column:
    """First 16 hex digits of the body's SHA-256."""
    return F.substring(F.sha2(body, 256), 1, 16)


def first_seen(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("_n = 1").drop("_n")
