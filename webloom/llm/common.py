"""Shared pieces of the training-data operators.

Everything here is written for a cluster: intermediate tables go to the shared
checkpoint folder, numbering is two-level so that no key meets in one task, and
batches reach Python in bounded slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.storage import discard, saved, shared_dir

__all__ = ["WORD", "discard", "numbered", "record_batch", "saved", "shared_dir", "slices", "table", "utf8_bytes"]

#: Words are maximal runs of characters other than \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most ``rows`` rows and about ``size`` bytes of text, so that the
    Python objects of one slice only are alive; a longer text is a slice by itself."""
    for batch in batches:
        held = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(held)
        at = 0
        while at < batch.num_rows:
            room = (upto[at - 1] if at else 0) + size
            end = max(at + 1, min(at + rows, int(np.searchsorted(upto, room, side="right"))))
            yield batch.slice(at, end - at)
            at = end
        pa.default_memory_pool().release_unused()


def record_batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int = 0) -> DataFrame:
    """Gapless numbers from 0 within each value of ``keys``.

    A key may hold any share of all rows: its rows are hashed to ``buckets`` windows (by
    default as many as there are shuffle partitions, 256 at least),
    numbered there, and shifted by the rows of the buckets before. ``df`` is read
    twice, so give a narrow saved table. Equal rows get distinct numbers.
    """
    buckets = buckets or max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    ranked = dealt.withColumn("_r", F.row_number().over(within))
    return ranked.join(shifts, [*keys, "_b"]).withColumn(out, (F.col("_at") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_at")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
