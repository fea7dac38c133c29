"""Near copies: SimHash fingerprints meet by Golay keys, exact Jaccard similarity decides.

A text is the set of the XXH64 of its five-word shingles (a shorter text is one shingle,
a text without words the empty set). Texts of one set are one node. Two nodes are linked
if their similarity is ``least`` per cent or more; it is counted on the whole sets.

A pair at similarity 0.8 differs in about 15 % of its SimHash bits, 10 of 64, so one
fingerprint with the setting of op5 doesn't reach it. A node has 24 fingerprints of 64 bits,
each over hashes mixed anew, and each is cut and keyed as in simhash.py: 11 exact bits of
a segment and the Golay keys of the next one, which meet by far more often than not. Of
two nodes that meet, a 25th fingerprint is compared inside the join (at most ``FAR`` bits
apart), then all 24 together (at most ``WIDE`` bits apart, sets of ``SMALL`` and more), so
chance meetings make no pairs. What is left goes to the exact similarity. The keys are
read in ``ROUNDS`` parts; only one part is on disk at a time.

Buckets up to ``bucket`` nodes are compared pair by pair. The larger ones that nodes connect
are one group, with one row a node, whatever the number of its buckets. A pair of one group
that also meets in small buckets makes no row there: the group settles it. A group goes
through rounds of pivots, a query set that is compared with all its nodes but former pivots:
first the eight nodes that share most large buckets with others (the middle), then 32 times
as many in each round, drawn from the nodes that are not yet linked to the group's largest
component. Nodes of a group have 72 fingerprints more, compared inside the join where the
24 agree (at most ``DEEP`` bits apart in all 96), since many pairs are only just too far
apart for a link. A group is done when all its nodes that were no pivot are in one component: then each pair in
different components has had a pivot in it, so none is missed. A group of copies collapses
in the first rounds; only nodes similar to nothing else in their group are all compared.

Rows without a doc_id are kept. Of a component the row of the smallest doc_id stays (of
rows with that id, the one with the least text digest).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import discard, record_batch, saved, slices
from webloom.llm.graph import components
from webloom.llm.simhash import segment_keys

SEED, SHINGLE, LEAST = 42, 5, 80
#: Fingerprints with keys, the exact bits in a key, and the parts in which the keys are read.
PRINTS, EXACT, ROUNDS = 24, 11, 4
#: At similarity 0.8 the bits that differ are 10 of 64 (deviation 3) and 233 of 1536 (deviation 14).
FAR, WIDE, SMALL = 21, 310, 32
_DRAWN = np.random.default_rng(SEED)
_FLIP = _DRAWN.integers(0, 1 << 64, PRINTS + 1, dtype=np.uint64)
_TIMES = _DRAWN.integers(0, 1 << 64, PRINTS + 1, dtype=np.uint64) | np.uint64(1)
#: A node of a large group has so many fingerprints besides. In all 96, 931 of 6144 bits differ at similarity 0.8 (deviation 28).
FURTHER, DEEP = 72, 1100
_OTHER_FLIP = _DRAWN.integers(0, 1 << 64, FURTHER, dtype=np.uint64)
_OTHER_TIMES = _DRAWN.integers(0, 1 << 64, FURTHER, dtype=np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B185EBCA87)
_LANES = np.uint64(0x0101010101010101)
#: Pivots of a group in the first round, and how many times more in each further one.
PIVOTS, MORE = 8, 32
#: Tasks to which the nodes of a group are dealt.
SPREAD = 32


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all word shingles of the whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64))


def simhashes(found: np.ndarray, flip: np.ndarray = _FLIP, times: np.ndarray = _TIMES) -> np.ndarray:
    """The 25 fingerprints of a set, or those of other mixings; a bit is 1 if set in over half of the mixed hashes."""
    ones = np.zeros((len(flip), 8, 8), np.int64)  # by byte and bit
    for at in range(0, len(found), 255):  # a lane of 8 bits counts to 255
        mixed = (found[at : at + 255, None] ^ flip) * times
        mixed ^= mixed >> np.uint64(32)
        mixed *= _PRIME
        mixed ^= mixed >> np.uint64(29)
        for bit in range(8):
            lanes = ((mixed >> np.uint64(bit)) & _LANES).sum(axis=0, dtype=np.uint64)
            ones[:, :, bit] += lanes.astype("<u8").view(np.uint8).reshape(len(flip), 8)
    return np.packbits(2 * ones > len(found), axis=2, bitorder="little").reshape(-1).view("<u8").astype(np.uint64).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


_NODE = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("sketch", pa.int64()), ("prints", pa.list_(pa.int64()))])


def printed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, size, sketch, prints) of the rows of doc_id, digest and text."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            node = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            made = [simhashes(s) for s in sets]
            yield record_batch(_NODE, doc_id=batch.column(0), digest=batch.column(1), node=node, size=[len(s) for s in sets], sketch=[m[PRINTS] for m in made], prints=_lists([m[:PRINTS] for m in made]))

    return docs.mapInArrow(run, "doc_id long, digest long, node long, size int, sketch long, prints array<long>")


_KEYED = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("sketch", pa.int64())])


def keyed(nodes: DataFrame, first: int, end: int) -> DataFrame:
    """(key, node, sketch): the Golay keys of the fingerprints ``first`` to ``end`` - 1 of all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            node, sketch = (batch.column(k).to_numpy() for k in (0, 1))
            prints = batch.column(2).flatten().to_numpy().reshape(-1, PRINTS)
            for k in range(first, end):
                at, key = segment_keys(np.ascontiguousarray(prints[:, k]), EXACT)
                yield record_batch(_KEYED, key=np.int64(k) << 42 | key, node=node[at], sketch=sketch[at])

    return nodes.where("size > 0").select("node", "sketch", "prints").mapInArrow(run, "key long, node long, sketch long")


def apart(a: str, b: str) -> Column:
    """Bits that differ in all fingerprints of two arrays."""
    return reduce(add, (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PRINTS)))


def likely(size: str, prints: str, other: str, those: str, least: int) -> Column:
    """Whether sizes and fingerprints let the similarity be ``least`` per cent."""
    alike = (100 * F.least(size, other) >= least * F.greatest(size, other)) & ((F.least(size, other) < SMALL) | (apart(prints, those) <= WIDE))
    return alike if least >= LEAST else F.lit(True)


def close(size: str, prints: str, others: str, other: str, those: str, further: str, least: int) -> Column:
    """``likely`` by all fingerprints of two nodes of a group; the further ones are read only where the first ones agree."""
    if least < LEAST:
        return F.lit(True)
    apart_ = apart(prints, those) + F.aggregate(F.zip_with(others, further, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, b: n + b)
    return likely(size, prints, other, those, least) & ((F.least(size, other) < SMALL) | (apart_ <= DEEP))


def _grown(groups: DataFrame | None, large: DataFrame) -> DataFrame:
    """Saved (node, label) of the groups so far, joined and extended by the large buckets of another part."""
    own = large.select(F.min("hub").over(Window.partitionBy("node")).alias("a"), "hub", "node")  # a node and its hubs hang on the least of these
    edges = own.select("a", F.col("node").alias("b")).union(own.select("a", "hub")).distinct()
    if groups is None:
        return saved(components(edges), "groups")
    if large.isEmpty():
        return groups
    out = saved(components(edges.union(groups.select("label", "node"))), "groups")
    discard(groups)
    return out


def _team(rows: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """``rows`` with the group of the node as ``team``, null without one."""
    if groups.isEmpty():
        return rows.withColumn("team", F.lit(None).cast("long"))
    return rows.join(groups.withColumnRenamed("label", "team"), on, "left")


def _strangers(one: str, two: str) -> Column:
    """Pairs of one group are left to its pivots."""
    return ~F.coalesce(F.col(one) == F.col(two), F.lit(False))


def furthered(docs: DataFrame, heads: DataFrame, grouped: DataFrame) -> DataFrame:
    """``grouped`` with the further fingerprints of each node as ``others``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([simhashes(shingles(t), _OTHER_FLIP, _OTHER_TIMES) for t in batch.column(1).to_pylist()])], names=["node", "others"])

    asked = saved(heads.join(grouped.select("node"), "node").select("node", "doc_id", "digest"), "asked")
    found = docs.join(asked, ["doc_id", "digest"]).select("node", "text").mapInArrow(run, "node long, others array<long>").dropDuplicates(["node"])
    out = saved(grouped.join(found, "node"), "grouped")
    discard(grouped, asked)
    return out


def buckets(nodes: DataFrame, bucket: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of nodes of small buckets, unless one group has both; (key, node, weight, size, prints) of large ones, one row a node:
    key is the group of all nodes that large buckets connect, weight tells how often others share one with the node."""
    pairs, large, groups = [], [], None
    for turn in range(ROUNDS):
        keys = keyed(nodes, turn * PRINTS // ROUNDS, (turn + 1) * PRINTS // ROUNDS)
        same = Window.partitionBy("key")
        met = saved(keys.withColumns({"n": F.count(F.lit(1)).over(same), "hub": F.min("node").over(same)}).where("n > 1"), "met")
        large.append(saved(met.where(F.col("n") > bucket).groupBy("hub", "node").agg(F.sum("n").alias("n")), "large"))
        groups = _grown(groups, large[-1])
        few = _team(met.where(F.col("n") <= bucket).select("key", "node", "sketch"), groups, "node")
        a, b = (few.select("key", F.col("node").alias(c), F.col("sketch").alias(f"{c}_sketch"), F.col("team").alias(f"{c}_team")) for c in "ab")
        near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a_sketch").bitwiseXOR(F.col("b_sketch"))) <= FAR)
        pairs.append(saved(a.join(b.hint("merge"), "key").where(near & _strangers("a_team", "b_team")).select("a", "b").distinct(), "candidates"))
        discard(met)
    teamed = _team(nodes.select("node", "size", "prints"), groups, "node")
    one, two = (teamed.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("prints").alias(f"{c}_prints"), F.col("team").alias(f"{c}_team")) for c in "ab")
    wanted = likely("a_size", "a_prints", "b_size", "b_prints", least) & _strangers("a_team", "b_team")
    asked = reduce(DataFrame.union, pairs).distinct().join(one, "a").join(two, "b").where(wanted).select("a", "b")
    asked = saved(asked, "candidates")
    many = reduce(DataFrame.union, large)
    weights = many.groupBy("node").agg(F.sum("n").alias("weight"))
    grouped = saved(nodes.join(weights, "node").join(groups.withColumnRenamed("label", "key"), "node").select("key", "node", "weight", "size", "prints"), "grouped")
    discard(*pairs, *large, groups)
    return asked, grouped


def joined(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Saved labels after the links ``new``: only the components that these touch are looked at."""
    own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    named = new.join(own("a"), "a", "left").join(own("b"), "b", "left").select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y"))
    named = saved(named, "named")
    moved = components(named.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.union(named.select(F.col("a").alias("node"), "x").union(named.select("b", "y"))).distinct()
    out = saved(known.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    discard(named)
    return out


def similar(docs: DataFrame, heads: DataFrame, bucket: int, least: int) -> DataFrame:
    """(node, label) of all nodes that are linked to others."""
    pairs, large = buckets(heads, bucket, least)
    met = links(docs, heads, pairs, least)
    labels = saved(components(met), "labels")
    discard(pairs, met)
    if not large.isEmpty():
        large = furthered(docs, heads, large)
    # Nodes of large buckets that were no pivot yet.
    open_, turn = large, 0
    while not open_.isEmpty():
        told = saved(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "told")
        waiting = told.join(open_.select("node"), "node", "left_semi")
        by_label = waiting.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
        main = by_label.groupBy("key").agg(F.max(F.struct("n", -F.col("weight"), "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        main = saved(main, "main")
        outside = saved(waiting.join(main, "key").where("label <> main").drop("main", "labels"), "outside")
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PIVOTS * MORE**turn))
        chosen = outside.groupBy("key", slot.alias("slot")).agg(F.max(F.struct("weight", "node", "label", "size", "prints", "others")).alias("p"))
        pivots = saved(chosen.select("key", F.col("p.node").alias("pivot"), F.col("p.label").alias("other"), F.col("p.size").alias("p_size"), F.col("p.prints").alias("p_prints"), F.col("p.others").alias("p_others")), "pivots")
        # A group is dealt to SPREAD tasks, each of which sees all its pivots. The fingerprints are
        # compared in the join itself: what they rule out makes no row.
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int"))
        asking = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        asked = dealt.join(asking, ["key", "part"]).where((F.col("label") != F.col("other")) & close("size", "prints", "others", "p_size", "p_prints", "p_others", least)).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        asked = saved(asked, "candidates")
        if not asked.isEmpty():
            new = links(docs, heads, asked, least)
            if not new.isEmpty():
                before, labels = labels, joined(labels, new)
                discard(before)
            discard(new)
        if pivots.count() == outside.count():  # the nodes of a group that were no pivot are in one component
            discard(told, main, outside, pivots, asked)
            break
        # Only groups with pivots are still looked at.
        rest = open_.select("key", "node").join(main, "key", "left_semi")
        left = saved(rest.join(pivots.select(F.col("pivot").alias("node")), "node", "left_anti"), "open")
        discard(told, main, outside, pivots, asked, *([] if open_ is large else [open_]))
        open_, turn = left, turn + 1
    discard(large, *([] if open_ is large else [open_]))
    return labels


def links(docs: DataFrame, heads: DataFrame, pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs whose similarity is ``least`` per cent or more; ``heads`` names one row of ``docs`` for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t).view(np.int64) for t in batch.column(1).to_pylist()])], names=["node", "found"])

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = saved(heads.join(nodes, "node").select("node", "doc_id", "digest"), "asked")
    sets = saved(docs.join(asked, ["doc_id", "digest"]).select("node", "text").mapInArrow(run, "node long, found array<long>").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("t")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("n"), (F.size("s") + F.size("t")).alias("all"))
    out = saved(shared.where(100 * F.col("n") >= least * (F.col("all") - F.col("n"))).select("a", "b"), "similar")
    discard(asked, sets)
    return out


def representatives(docs: DataFrame, bucket: int = 64, least: int = LEAST) -> DataFrame:
    """One row of ``docs`` for each component; columns stay as they were."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    told = plain.where(F.col(own).isNotNull()).select(F.col(own).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    prints = saved(printed(told), "prints")
    first = F.min(F.struct("doc_id", "digest")).alias("first")
    of = [F.first(c).alias(c) for c in ("size", "sketch", "prints")]  # one set, one value
    heads = saved(prints.groupBy("node").agg(first, *of).select("node", "first.*", "size", "sketch", "prints"), "heads")
    discard(prints)
    labels = similar(told, heads, bucket, least)
    named = heads.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(first)
    stay = saved(named.select(F.col("first.doc_id").alias("_doc"), F.col("first.digest").alias("_digest")), "stay")
    discard(heads, labels)
    kept = plain.join(stay, (F.col(own).cast("long") == F.col("_doc")) & (F.xxhash64(text) == F.col("_digest")), "left_semi").dropDuplicates([own, text])
    return kept.union(plain.where(F.col(own).isNull())).toDF(*names)
