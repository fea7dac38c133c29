"""Breadth-first discovery over a link table, with depth, budget and batch statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.storage import saved


def crawled(entries: DataFrame, links: DataFrame, max_depth: int = 10, budget: int = 0) -> DataFrame:
    """Visited pages: origin, url, from_url, depth, batch, ord.

    ``entries``: origin, url, ord. ``links``: from_url, url, ord, confidence, fetchable. A
    batch is the whole frontier; the next one has what it links to, is worth fetching,
    of high or medium confidence, not deeper than ``max_depth`` and not queued before.
    With a ``budget`` an origin's attempts stop there, in queue order, and the tail is dropped.

    ``ord`` is the path of ordinals to a page (at most ``max_depth`` + 1 numbers): comparing
    paths is queue order, so no origin's rows have to meet in one task to be numbered.
    """
    frontier = entries.groupBy("origin", "url").agg(F.array(F.min(F.col("ord").cast("long"))).alias("ord"))
    frontier = frontier.select("origin", "url", F.lit("").alias("from_url"), F.lit(0).alias("depth"), F.lit(0).alias("batch"), "ord")
    good = links.where(F.col("fetchable") & F.col("confidence").isin("high", "medium")).select(F.col("from_url").alias("parent"), F.col("url").alias("target"), F.col("ord").cast("long").alias("link"))
    visited, depth = None, 0
    while True:
        frontier = saved(within_budget(frontier, visited, budget), "frontier")
        visited = frontier if visited is None else visited.unionByName(frontier)
        if depth == max_depth or frontier.isEmpty():
            return visited
        depth += 1
        found = frontier.join(good, frontier["url"] == good["parent"]).select("origin", F.col("target").alias("url"), F.struct(F.array_append("ord", F.col("link")).alias("ord"), F.col("url").alias("from_url")).alias("m"))
        fresh = found.groupBy("origin", "url").agg(F.min("m").alias("m")).join(visited.select("origin", "url"), ["origin", "url"], "left_anti")
        frontier = fresh.select("origin", "url", F.col("m.from_url").alias("from_url"), F.lit(depth).alias("depth"), F.lit(depth).alias("batch"), F.col("m.ord").alias("ord"))


def within_budget(frontier: DataFrame, visited: DataFrame | None, budget: int) -> DataFrame:
    """The head of the batch that an origin's remaining attempts allow (C3); at most ``budget`` rows of an origin reach its window."""
    if not budget:
        return frontier
    ranked = frontier.withColumn("_r", F.row_number().over(Window.partitionBy("origin").orderBy("ord", "url"))).where(F.col("_r") <= budget)
    if visited is None:
        return ranked.drop("_r")
    used = visited.groupBy("origin").agg(F.count(F.lit(1)).alias("_used"))
    return ranked.join(used, "origin", "left").where(F.col("_r") + F.coalesce("_used", F.lit(0)) <= budget).drop("_r", "_used")


def outcomes(fetched: DataFrame) -> DataFrame:
    """Asset rows of fetch results, for requested and final URL alike (C6). Columns url, final_url, status_code, content_type, size, hash, depth."""
    ok = F.col("status_code").between(200, 299)
    each = fetched.select("*", F.explode(F.array_distinct(F.array("url", F.coalesce("final_url", F.col("url"))))).alias("asset_url"))
    return each.select(
        "asset_url", F.when(ok, "confirmed").otherwise("failed").alias("status"), F.when(ok, "high").otherwise("low").alias("confidence"),
        F.when(ok, F.col("content_type")).otherwise("").alias("content_type"), F.when(ok, F.col("size")).otherwise(0).alias("size"), F.when(ok, F.col("hash")).otherwise("").alias("hash"),
    )


def not_downloaded(entry_assets: DataFrame, processed: DataFrame) -> DataFrame:
    """Entry assets nobody fetched stay candidates."""
    return entry_assets.join(processed.select("asset_url").distinct(), "asset_url", "left_anti").withColumn("status", F.lit("candidate"))


def batch_statistics(fetches: DataFrame) -> DataFrame:
    """By origin and batch: depths, attempts, outcomes, size of the next batch, running total (C8). Columns origin, batch, depth, outcome, discovered."""
    own = fetches.groupBy("origin", "batch").agg(
        F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.count(F.lit(1)).alias("attempted"),
        *[F.count_if(F.coalesce("outcome", F.lit("failed")) == k).alias(k) for k in ("js", "non_js", "failed")], F.sum("discovered").cast("long").alias("discovered"),
    )
    order = Window.partitionBy("origin").orderBy("batch")
    return own.withColumns({"next": F.coalesce(F.lead("attempted").over(order), F.lit(0)).cast("long"), "total": F.sum("js").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")})


def rollup(fetches: DataFrame) -> DataFrame:
    """Per origin and in all: attempts and outcomes (C9); origin is null in the grand total."""
    return fetches.rollup("origin").agg(F.count(F.lit(1)).alias("attempted"), *[F.count_if(F.coalesce("outcome", F.lit("failed")) == k).alias(k) for k in ("js", "non_js", "failed")]).orderBy(F.col("origin").asc_nulls_last())


def isolated(entries: DataFrame) -> DataFrame:
    """Outcome of each entry: after the first fatal error of a run the rest are skipped (C11). Columns run, ord, error, fatal."""
    before = F.max(F.col("fatal").cast("int")).over(Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return entries.withColumn("outcome", F.when(F.coalesce(before, F.lit(0)) == 1, "skipped").when(F.col("error") != "", "failure").otherwise("success"))


def final_errors(sites: DataFrame) -> DataFrame:
    """Errors of the sites, joined in the order of their origins."""
    return sites.where("error <> ''").groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("origin", "error"))), lambda x: x["error"]), "\n").alias("errors"))


def elapsed(seconds):
    """Whole milliseconds below a second, tenths of a second from there."""
    return F.when(seconds < 1, F.format_string("%dms", F.round(seconds * 1000).cast("long"))).otherwise(F.format_string("%.1fs", F.round(seconds, 1)))
