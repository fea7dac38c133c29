"""SimHash near-duplicates found through Golay-code fuzzy keys.

Fingerprints have 64 bits. They are cut into three segments of 22, 21 and 21 bits. Two
fingerprints that differ in at most 2 bits agree exactly in one segment (pigeonhole),
and the next segment differs in at most 2 bits, so its Golay keys meet (see golay.py).
The join key is (segment number, exact bits, codeword index of the next segment): up to
18 keys a fingerprint, about 34 bits each. Candidates are verified by their distance.

Only distinct fingerprints enter the search; copies follow their fingerprint. Buckets up
to ``bucket`` fingerprints are verified pair by pair. In larger ones (thousands of
near copies) no pairs are made: every fingerprint is listed under itself and its 64
one-bit neighbours. Two fingerprints stand under one entry exactly if they differ in at
most 2 bits, an entry has at most 65 of them, and linking each to the first keeps every
component whole. The work is linear in the rows either way.

Null and empty texts have fingerprint zero and link like any other. Repeated rows keep
their row each. Null doc_ids are kept but never name a component unless alone. An empty
table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import golay
from webloom.llm.common import record_batch, saved, slices
from webloom.llm.graph import components

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the XXH64 bits of all word shingles of the whole text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist()))


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield record_batch(_FP, doc_id=batch.column(0), fp=prints)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def segment_keys(prints: np.ndarray, exact: int = 22) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) of all its keys, each with the lowest ``exact`` bits of its exact segment."""
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, out = [], []
    for i in range(len(SEGMENTS)):
        near = golay.keys(parts[(i + 1) % len(SEGMENTS)])
        at, column = np.nonzero(near >= 0)
        rows.append(at)
        out.append((np.int64(i) << 40) | ((parts[i][at] & ((1 << exact) - 1)) << 12) | near[at, column])
    return np.concatenate(rows), np.concatenate(out)


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of distance 2 or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
        for batch in slices(batches, 4096):
            own = batch.column(0).to_numpy()
            at, key = segment_keys(own)
            yield record_batch(schema, key=key, fp=own[at])

    keyed = saved(prints.select("fp").mapInArrow(run, "key long, fp long"), "keys")
    sizes = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = saved(keyed.join(sizes, "key"), "met")
    few = met.where(F.col("n") <= bucket)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where((F.col("a") < F.col("b")) & (apart("a", "b") <= DISTANCE)).select("a", "b")
    many = met.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)])
    stars = many.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars)


def clustered(docs: DataFrame, shingle: int = SHINGLE, bucket: int = 64) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest doc_id reachable)."""
    prints = saved(fingerprints(docs, shingle), "fingerprints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(distinct, bucket))
    linked = saved(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    named = saved(linked.groupBy("label").agg(F.min("first").alias("component_id")), "names")
    of = saved(linked.join(named, "label").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, bucket: int = 64) -> DataFrame:
    """One row of ``docs`` for each component, that of its smallest doc_id; of rows with that id, one.

    Rows without a doc_id are kept: nothing says which of them is first. Columns stay as they were.
    """
    found = saved(clustered(docs, shingle, bucket), "clusters")
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own = f"c{names.index('doc_id')}"
    kept = plain.join(first, F.col(own).cast("long") == first["doc_id"], "left_semi").dropDuplicates([own])
    return kept.union(plain.where(F.col(own).isNull())).toDF(*names)
