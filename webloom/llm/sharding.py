"""K-d tree sharding by bytes, with DataFrame operations only.

Every document is a point: scaled logarithm of its size, language, source and document
id. A node that stands for m shards is cut along the widest dimension of its box at the
weighted quantile ceil(m/2)/m, until every leaf stands for one shard of total/shards bytes.

* Equal texts are one point (smallest language, source and id of the group), so they
  share a shard. Only a group that weighs more than a shard is split: its rows are dealt
  by document id like different points.
* Points of a 1/``HEAVY`` of a shard or more are few (at most ``HEAVY`` x shards): they are
  dealt to the sides of a cut first, in their order along its dimension, and the threshold
  of all others is set so that both sides together are as large as they should be.
* The weighted quantile is found by histograms: each round sums bytes into at most 4096
  bins a node and only these sums reach the driver; two or three rounds a level do, as
  boxes and weights of a level follow from the cuts above it. Ties in the dimension are
  broken by a hash that is part of the key.

Null texts count as empty ones; null language and source are values of their own;
repeated rows are kept, each with its own slot; an empty table gives no rows; columns
other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import discard, numbered, saved, utf8_bytes

HALF = 1 << 31
STEP = 12
DIMENSIONS = ("d_size", "d_lang", "d_source", "d_id")
#: Points of this part of a shard or more are dealt one by one.
HEAVY = 64


@dataclass
class Heavy:
    unit: int
    size: int
    at: dict[str, int]
    tie: int


@dataclass
class Node:
    """An inner node once ``left`` is set: keys of ``dimension`` below ``at`` go left. ``size``: bytes of its light points."""

    name: int
    first: int
    shards: int
    size: int
    box: dict[str, tuple[int, int]]
    heavy: list[Heavy] = field(default_factory=list)
    dimension: str = ""
    at: int = 0
    left: Node | None = None
    right: Node | None = None


def key(dimension: str) -> Column:
    return F.col(dimension) * F.lit(HALF) + F.col("tie")


def place(node: Node) -> Column:
    """Name of the leaf that a row falls into, as one nested CASE, linear in the tree."""
    if node.left is None:
        return F.lit(node.name)
    return F.when(key(node.dimension) < F.lit(node.at), place(node.left)).otherwise(place(node.right))


def leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else leaves(node.left) + leaves(node.right)


def points(docs: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """Saved narrow table (doc_id, size, text_crc32, dimensions, tie, unit, heavy) of every row, and the sum of sizes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = saved(
        docs.select(
            F.col("doc_id").cast("long"), (utf8_bytes(F.col("text")) + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
            F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("\0"))).alias("lang"), F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("\0"))).alias("source"),
        ),
        "slim",
    )
    by = ["h", "text_crc32", "size"]
    groups = saved(slim.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("doc_id").alias("first")), "texts")
    seen = groups.agg(F.sum("bytes").alias("bytes"), *[f(c).alias(f"{c}_{n}") for c in ("size", "lang", "source", "first") for n, f in (("min", F.min), ("max", F.max))]).first()
    total = seen["bytes"] or 0

    def scaled(value: Column, low: float | None, high: float | None) -> Column:
        low, high = float(low or 0), float(high or 0)
        return F.least(F.lit(HALF - 1), F.greatest(F.lit(0), F.floor((F.coalesce(value, F.lit(0)) - F.lit(low)) / F.lit(max(high - low, 1e-9)) * F.lit(HALF - 1)))).cast("long")

    split = (F.col("bytes") > F.lit(total / shards)) & (F.col("n") > 1)
    unit = F.when(split, F.xxhash64("doc_id", "h", "text_crc32")).otherwise(F.xxhash64("h", "text_crc32", "size"))
    grouped = groups.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    rows = saved(
        slim.drop("lang", "source").join(grouped, by).select(
            "doc_id", "size", "text_crc32",
            scaled(F.log2(F.col("size").cast("double")), math.log2(seen["size_min"] or 1), math.log2(seen["size_max"] or 1)).alias("d_size"),
            scaled(F.col("g_lang"), seen["lang_min"], seen["lang_max"]).alias("d_lang"),
            scaled(F.col("g_source"), seen["source_min"], seen["source_max"]).alias("d_source"),
            scaled(F.when(split, F.col("doc_id")).otherwise(F.col("first")), seen["first_min"], seen["first_max"]).alias("d_id"),
            F.pmod(unit, F.lit(HALF)).alias("tie"), unit.alias("unit"), (F.when(split, F.col("size")).otherwise(F.col("bytes")) >= F.lit(max(total / shards / HEAVY, 1))).alias("heavy"),
        ),
        "points",
    )
    discard(slim, groups)
    return rows, total


def aside(node: Node, wanted: float, room: float) -> list[Heavy]:
    """Heavy points for the left side of the cut: those first along its dimension, if neither side gets more
    than it can hold; else the heaviest first, each to the side with more room."""
    own = sorted(node.heavy, key=lambda h: (h.at[node.dimension] * HALF + h.tie, h.unit))
    total, upto, best = sum(h.size for h in own), 0, None
    share = wanted / (wanted + room) if wanted + room else 0.5
    for k in range(len(own) + 1):
        if upto <= wanted and total - upto <= room and (best is None or abs(upto - total * share) < abs(best[1] - total * share)):
            best = (k, upto)
        upto += own[k].size if k < len(own) else 0
    if best:
        return own[: best[0]]
    left: list[Heavy] = []
    for h in sorted(own, key=lambda h: (-h.size, h.unit)):
        if wanted >= room:
            left.append(h)
            wanted -= h.size
        else:
            room -= h.size
    return left


def cut(light: DataFrame, root: Node, open_: list[Node], tolerance: float, names: int) -> None:
    """Dimension, threshold and sides of every open node, all nodes of a level together."""
    sides, low, shift, below, wanted = {}, {}, {}, {}, {}
    for n in open_:
        n.dimension = max(DIMENSIONS, key=lambda d: n.box[d][1] - n.box[d][0])
        many = n.shards - n.shards // 2
        total = n.size + sum(h.size for h in n.heavy)
        left = aside(n, total * many / n.shards, total * (n.shards - many) / n.shards)
        kept = {h.unit for h in left}
        sides[n.name] = left, [h for h in n.heavy if h.unit not in kept]
        wanted[n.name] = min(max(total * many / n.shards - sum(h.size for h in left), 0), n.size)
        low[n.name], span = n.box[n.dimension][0] * HALF, (n.box[n.dimension][1] - n.box[n.dimension][0] + 1) * HALF
        shift[n.name], below[n.name] = max((span - 1).bit_length() - STEP, 0), 0
        n.at = low[n.name]
    # What depends on the node is looked up by its name: a CASE for each would be multiplied by the one that places a row.
    of_node = lambda values: F.get(F.array(*[F.lit(values.get(k)).cast("long") for k in range(names)]), F.col("node"))
    dimension = of_node({n.name: DIMENSIONS.index(n.dimension) for n in open_})
    keyed = light.withColumn("node", place(root)).select("size", "node", (F.get(F.array(*DIMENSIONS), dimension.cast("int")) * F.lit(HALF) + F.col("tie")).alias("k"))
    live = {n.name: n for n in open_ if n.size}
    while live:  # the interval that is left of a node, in 2**STEP bins; other rows have bin null
        inside = keyed.select("size", "node", "k", of_node({n: low[n] for n in live}).alias("lo"), of_node({n: shift[n] for n in live}).cast("int").alias("by"))
        binned = inside.select("size", "node", F.expr(f"CASE WHEN k >= lo AND shiftright(k - lo, by) < {1 << STEP} THEN shiftright(k - lo, by) END").alias("bin"))
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in binned.groupBy("node", "bin").agg(F.sum("size").alias("bytes")).collect():
            if r["bin"] is not None:
                sums.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for name, node in list(live.items()):
            for b, weight in sorted(sums.get(name, [])):
                start, before = low[name] + (b << shift[name]), below[name]
                if before + weight >= wanted[name]:
                    after = wanted[name] - before > before + weight - wanted[name]
                    node.at = start + (after << shift[name])
                    if weight <= tolerance or not shift[name]:
                        below[name] = before + weight * after
                        del live[name]
                    else:
                        low[name], shift[name] = start, max(shift[name] - STEP, 0)
                    break
                below[name] += weight
            else:
                node.at = start + (1 << shift[name])
                del live[name]
    for n in open_:
        many, edge = n.shards - n.shards // 2, n.at // HALF
        (left, right), (a, b) = sides[n.name], n.box[n.dimension]
        n.left = Node(names, n.first, many, below[n.name], n.box | {n.dimension: (a, min(max(edge, a), b))}, left)
        n.right = Node(names + 1, n.first + many, n.shards - many, n.size - below[n.name], n.box | {n.dimension: (max(min(edge, b), a), b)}, right)
        names += 2


def tree(rows: DataFrame, shards: int, tolerance: float) -> Node:
    light = rows.where(~F.col("heavy")).select("size", "tie", *DIMENSIONS)
    seen = rows.agg(F.sum(F.when(~F.col("heavy"), F.col("size"))).alias("size"), *[f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]).first()
    heavy = rows.where("heavy").groupBy("unit").agg(F.sum("size").alias("size"), *[F.min(c).alias(c) for c in (*DIMENSIONS, "tie")]).collect()  # at most HEAVY x shards
    root = Node(0, 0, shards, seen["size"] or 0, {d: (seen[f"{d}_min"] or 0, seen[f"{d}_max"] or 0) for d in DIMENSIONS}, [Heavy(h["unit"], h["size"], {d: h[d] for d in DIMENSIONS}, h["tie"]) for h in heavy])
    names = 1
    while open_ := [n for n in leaves(root) if n.shards > 1]:
        cut(light, root, open_, tolerance, names)
        names += 2 * len(open_)
    return root


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not a key law)."""
    rows, total = points(docs, shards)
    root = tree(rows, shards, total / shards * 0.001)
    own = [(h.unit, leaf.first) for leaf in leaves(root) for h in leaf.heavy]
    dealt = F.broadcast(docs.sparkSession.createDataFrame(own, "unit long, own int"))  # at most HEAVY x shards rows
    first = {n.name: n.first for n in leaves(root)}
    shard = F.element_at(F.array(*[F.lit(first.get(k, 0)) for k in range(max(first) + 1)]), place(root) + 1)
    light = rows.where(~F.col("heavy")).withColumn("shard", shard.cast("int"))
    heavy = rows.where("heavy").join(dealt, "unit").withColumn("shard", F.col("own"))
    placed = saved(light.select("doc_id", "size", "text_crc32", "shard").union(heavy.select("doc_id", "size", "text_crc32", "shard")), "placed")
    return numbered(placed, ["shard"], ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
