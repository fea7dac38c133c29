"""Best-fit packing of documents into token sequences (linear grouping scheme).

The planner works on the histogram of piece lengths, which has at most ``capacity``
rows however large the corpus is, so planning is the driver's and everything that
grows with the corpus stays distributed.

1. Long documents are cut; lengths above ``small`` are *large*.
2. Large lengths, sorted, are split into groups of equal cardinality and rounded up
   to the longest of their group.
3. The configuration programme over these few lengths is solved by column generation;
   whole multiples of its configurations become bins.
4. Real lengths replace the rounded ones, in order; what that frees, and every length
   not placed yet, goes by best fit in decreasing order.
5. Each class of equal bins is one row per length in a plan table; pieces find their
   place by their rank among the pieces of the same length.

Nulls and empty texts are documents of one token (the separator). Repeated rows are
packed as often as they occur. An empty table gives no rows. Columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import numbered, record_batch, saved, slices
from webloom.llm.tokens import byte_bpe

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
SEPARATOR = 0


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), SEPARATOR], dtype="<u4")
                rows += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            yield record_batch(_PIECES, **dict(zip(_PIECES.names, zip(*rows, strict=True), strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


# ---------------------------------------------------------------- planner (driver, bounded)


def grouped(counts: list[tuple[int, int]], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Descending (size, count) runs cut into ``groups`` of equal cardinality: (rounded size, runs)."""
    total = sum(n for _, n in counts)
    per, out, room = max(1, -(-total // groups)), [], 0
    for size, n in sorted(counts, reverse=True):
        while n:
            if not room:
                out.append((size, []))
                room = per
            took = min(n, room)
            out[-1][1].append((size, took))
            n, room = n - took, room - took
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of ``sizes`` within ``capacity``."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        worth = best[room - sizes[fits]] + values[fits]
        k = int(worth.argmax())
        if worth[k] > best[room - 1] + 1e-12:
            best[room], pick[room] = worth[k], fits[k]
        else:
            best[room] = best[room - 1]
    config, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if pick[room] < 0 or best[room] == best[room - 1]:
            room -= 1
            continue
        config[pick[room]] += 1
        room -= int(sizes[pick[room]])
    return float(best[capacity]), config


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(configuration, whole multiplicity): the configuration programme by column generation, rounded down."""
    size, need = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = np.ones(len(size)) @ inverse
        value, column = best_configuration(size, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-7:
            break
        level, step = inverse @ need, inverse @ column
        ratio = np.where(step > 1e-10, level / np.where(step > 1e-10, step, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = column
    level = np.linalg.solve(basis, need)
    return [(basis[:, k].astype(int), int(level[k] + 1e-9)) for k in range(len(size)) if level[k] >= 1 - 1e-9]


def plan(histogram: dict[int, int], capacity: int, groups: int = 96, small: int | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """Classes of equal bins: (number of bins, [(length, how many of it in each bin)])."""
    small = capacity * 7 // 16 if small is None else small
    left = {s: n for s, n in histogram.items() if n}
    classes: list[tuple[int, list[tuple[int, int]]]] = []
    if left.get(capacity):
        classes.append((left.pop(capacity), [(capacity, 1)]))
    large = [(s, n) for s, n in left.items() if s > small]
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    if large:
        parts = grouped(large, min(groups, sum(n for _, n in large)))
        queues = [list(reversed(runs)) for _, runs in parts]
        merged: dict[int, list[int]] = defaultdict(list)
        for g, (size, _) in enumerate(parts):
            merged[size].append(g)
        sizes = sorted(merged, reverse=True)
        queue = {s: [r for g in reversed(merged[s]) for r in queues[g]] for s in sizes}
        for config, times in configurations(sizes, [sum(n for g in merged[s] for _, n in parts[g][1]) for s in sizes], capacity):
            wants = [(s, int(a)) for s, a in zip(sizes, config, strict=True) if a]
            times = min([times, *(sum(n for _, n in queue[s]) // a for s, a in wants)])
            while times > 0:
                run = min([times, *(queue[s][-1][1] // a for s, a in wants)])
                filled: list[tuple[int, int]] = []
                for s, a in wants:
                    take = a * max(run, 1)
                    while take:
                        real, n = queue[s].pop()
                        took = min(n, take)
                        filled.append((real, took // max(run, 1)))
                        if n > took:
                            queue[s].append((real, n - took))
                        take -= took
                for real, k in filled:
                    left[real] -= k * max(run, 1)
                open_[capacity - sum(r * k for r, k in filled)].append((max(run, 1), filled))
                times -= max(run, 1)
    for size in sorted((s for s, n in left.items() if n), reverse=True):
        n = left[size]
        for room in range(size, capacity):
            while n and open_.get(room):
                times, filled = open_[room].pop()
                k = room // size
                whole = min(times, n // k)
                if whole:
                    open_[room - k * size].append((whole, [*filled, (size, k)]))
                    n -= whole * k
                if whole < times and n and n < k:
                    open_[room - n * size].append((1, [*filled, (size, n)]))
                    n, whole = 0, whole + 1
                if whole < times:
                    open_[room].append((times - whole, filled))
            if not n:
                break
        k = capacity // size
        if n // k:
            open_[capacity - k * size].append((n // k, [(size, k)]))
        if n % k:
            open_[capacity - n % k * size].append((1, [(size, n % k)]))
    return classes + [c for room in sorted(open_) for c in open_[room]]


def best_plan(histogram: dict[int, int], capacity: int, groups: int = 96) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan with the fewest bins over a few bounds between small and large lengths."""
    tried = [plan(histogram, capacity, groups, capacity * n // 16) for n in (6, 7, 8)]
    return min(tried, key=lambda classes: sum(times for times, _ in classes))


SEGMENTS = "length long, lo long, hi long, first_sequence long, per_bin long, at long"


def segments(classes: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranks [lo, hi) of a length lie in bins from first_sequence on, per_bin in each, from offset ``at``."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, filled in classes:
        at = 0
        for size, k in filled:
            rows.append((size, rank[size], rank[size] + times * k, sequence, k, at))
            rank[size] += times * k
            at += size * k
        sequence += times
    return rows


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, groups: int = 96) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The plan table is broadcast: it has a few rows for each length up to ``capacity``
    and each configuration, however many documents there are.
    """
    spark = docs.sparkSession
    cut_up = saved(pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = F.broadcast(spark.createDataFrame(segments(best_plan(histogram, capacity, groups)), SEGMENTS).coalesce(1))
    ranked = numbered(cut_up, ["length"], ["doc_id", "piece"], "rank")
    place = ranked.join(places, "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return place.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
    )
