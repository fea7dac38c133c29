"""Asset store and path map as sets and ordered merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls


def merged(rows: DataFrame) -> DataFrame:
    """One row for each (site, url) from upserts in the order of ``ord`` (M1; rules in SURVEY 2.7.1).

    Every rule has an order-free form (running minimum or maximum by ord), so a hot url is
    combined map-side.
    """
    last = lambda c, ok: F.max_by(F.when(ok, F.col(c)), F.when(ok, F.col("ord")))
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("ord")))
    any_ = F.lit(True)
    return rows.groupBy("site", "url").agg(
        F.when(F.bool_or(F.col("status") == "confirmed"), "confirmed").otherwise(F.max_by("status", "ord")).alias("status"),
        F.when(F.bool_or(F.col("confidence") == "high"), "high").otherwise(F.max_by("confidence", "ord")).alias("confidence"),
        *[F.coalesce(last(c, F.coalesce(F.col(c), F.lit("")) != ""), F.lit("")).alias(c) for c in ("from_url", "content_type", "hash")],
        F.coalesce(last("size", F.col("size") != 0), F.lit(0)).cast("long").alias("size"),
        F.coalesce(first("type", ~F.col("type").isin("unknown_js", "")), first("type", any_)).alias("type"),
        F.coalesce(first("source", ~F.col("source").isin("regex_candidate", "")), first("source", any_)).alias("source"),
        F.min("depth").alias("depth"),
        first("framework", any_).alias("framework"),
    )


def by_status(store: DataFrame, status: str) -> DataFrame:
    """Sorted URLs of a status (M2)."""
    return store.where(F.col("status") == status).select("site", "url").orderBy("site", "url")


def output_map(rows: DataFrame) -> DataFrame:
    """Distinct (site, url, path) without empty parts, slashes forward (M3)."""
    return rows.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))).where("site <> '' and url <> '' and path <> ''").select("site", "url", "path").distinct()


def prioritized(parts: list[DataFrame], *keys: str) -> DataFrame:
    """Union in which an earlier part wins a key."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_prio", F.lit(k))
        out = p if out is None else out.unionByName(p)
    best = Window.partitionBy(*keys).orderBy("_prio", "ord")
    return out.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_prio")


def unique(values: Column) -> Column:
    return F.array_distinct(values)  # M5


def artifacts(rows: DataFrame) -> DataFrame:
    """(hash, path) of contents (ord, path, content): equal bytes share the first path; another content
    under a taken path gets 8 digits of its hash before the extension (S15)."""
    each = rows.select("ord", "path", F.sha2("content", 256).alias("hash"))
    first = each.groupBy("hash").agg(F.min("ord").alias("ord"), F.min_by("path", "ord").alias("path"))
    taken = F.row_number().over(Window.partitionBy("path").orderBy("ord")) > 1
    renamed = F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("-"), F.substring("hash", 1, 8), F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return first.select("hash", "ord", F.when(taken, renamed).otherwise(F.col("path")).alias("path"))


def directories(origins: DataFrame) -> DataFrame:
    """Directory of each distinct origin; origins that share a name all get 8 digits of their hash."""
    named = origins.select(urls.origin(F.col("url")).alias("origin")).where("origin is not null").distinct().withColumn("base", urls.host_name_of_directory(F.col("origin")))
    many = F.count(F.lit(1)).over(Window.partitionBy("base")) > 1
    return named.select("origin", F.when(many, F.concat(F.col("base"), F.lit("_"), F.substring(F.sha2("origin", 256), 1, 8))).otherwise(F.col("base")).alias("directory"))
