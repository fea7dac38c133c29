"""Connected components by random-order contraction, on distributed edge tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); equal labels are one component.

    Each round every node takes, of itself and its neighbours, the one that comes first
    in an order drawn anew; edges between the taken nodes remain. A constant share of
    the nodes disappears each round in expectation, chains and stars alike. Per node
    only a running minimum is kept, so hubs are pre-aggregated before any shuffle; the
    joins read saved tables on both sides, so a skewed one can be split at run time.
    Nulls and self-loops are dropped; no edges give no rows.
    """
    edges = saved(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        takes = saved(_takes(both, turn), "takes")
        if labels is None:
            labels = takes.select("node", F.col("to").alias("label"))
        else:
            moved = takes.withColumnsRenamed({"node": "label"})
            before = labels
            labels = saved(before.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            discard(before)
        first = saved(edges.join(takes.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b"), "half")
        second = first.join(takes.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = saved(second.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        discard(edges, first, *([takes] if turn else []))  # the first labels read the first takes
        edges, turn = left, turn + 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _takes(both: DataFrame, turn: int) -> DataFrame:
    def ranked(name: str):
        return F.struct(F.xxhash64(name, F.lit(turn)).alias("h"), F.col(name).alias("v"))

    least = both.groupBy("a").agg(F.min(ranked("b")).alias("least"))
    return least.select(F.col("a").alias("node"), F.least("least", ranked("a"))["v"].alias("to"))
