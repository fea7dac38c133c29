"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed: trigrams of the *shape* of a text (runs of lower case, capitals,
digits, blanks and single or repeated marks), words, and how many words repeat their
predecessor or an earlier word. A bounded sample of labelled texts (``most`` rows, those
first by a hash of their id) gives inverse document frequencies and, by singular value
decomposition, the latent space. The sample's vectors, at most ``most`` x ``rank``
floats, are broadcast; every document is compared with all of them by exact blocked
cosine products, and its ``neighbours`` nearest vote, weighted by a power of similarity.

Scores never see labels, lang, source or doc_id of the scored row. Null and empty texts,
and all texts where there is no label, get the share of label 1 in the sample (0.5
without any). Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import slices

SHAPES, WORDS, REPEATS = 1024, 1024, 2
TERMS = SHAPES + WORDS + REPEATS
#: Weight of each family of terms in a vector.
FAMILIES = ((0, SHAPES, 1.0), (SHAPES, SHAPES + WORDS, 0.3), (SHAPES + WORDS, TERMS, 0.7))


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        table[b] = 1 if b >= 128 or c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == "\n" else 5 if c in " \t\r\x0b\x0c" else 6 + b % 40
    return table


CLASSES = _classes()
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def terms(text: str | None) -> np.ndarray:
    """Term shares of the whole text: square roots, each family of length at most 1."""
    out = np.zeros(TERMS, dtype=np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    blank = SPACES[raw]
    if blank.all():
        return out
    shape = CLASSES[raw]
    first = np.flatnonzero(np.concatenate([[True], shape[1:] != shape[:-1]]))
    code = shape[first]
    code = code + 50 * ((np.diff(np.append(first, len(shape))) > 1) & (code > 5))
    if len(code) >= 3:
        grams = ((code[:-2] * 10007 + code[1:-1]) * 10009 + code[2:]) * 2654435761 % 4294967296 >> 22
        out[:SHAPES] = np.sqrt(np.bincount(grams, minlength=SHAPES) / len(grams))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        begin = np.zeros(len(raw), dtype=np.int64)
        begin[starts] = starts
        begin = np.maximum.accumulate(begin)
        own = (raw.astype(np.uint64) + np.uint64(1)) * POWERS[np.minimum(np.arange(len(raw)) - begin, len(POWERS) - 1)]
        own[blank] = 0
        words = np.add.reduceat(own, starts)
        out[SHAPES : SHAPES + WORDS] = np.sqrt(np.bincount((words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64), minlength=WORDS) / len(words))
    out[-2] = np.sqrt((words[1:] == words[:-1]).sum() / len(words))
    trigrams = words[2:] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[:-2] * np.uint64(7) if len(words) > 2 else words[:0]
    out[-1] = np.sqrt(1 - len(np.unique(trigrams)) / len(trigrams)) if len(trigrams) else 0
    return out


def _powers() -> np.ndarray:
    out = np.ones(256, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, 256):
            out[k] = out[k - 1] * np.uint64(0xD6E8FEB86659FD93)
    return out


POWERS = _powers()


@dataclass
class Latent:
    """Inverse frequencies, latent axes, and the labelled vectors with their labels."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, shares: np.ndarray) -> np.ndarray:
        return self.normed((shares * self.weight) @ self.axes)

    @staticmethod
    def normed(flat: np.ndarray) -> np.ndarray:
        return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)

    def score(self, shares: np.ndarray, neighbours: int, power: float, block: int = 2048) -> np.ndarray:
        out = np.full(len(shares), self.prior)
        if not len(self.labels):
            return out
        mine = self.project(shares)
        near = np.concatenate([mine @ self.vectors[at : at + block].T for at in range(0, len(self.labels), block)], axis=1)
        k = min(neighbours, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(float) ** power
        total = votes.sum(axis=1)
        told = np.abs(shares).sum(axis=1) > 0
        some = told & (total > 0)
        out[some] = (votes * self.labels[best]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string")) % 5 == 0


def shares(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the term shares of ``text`` as float32 bytes, deflated: most are zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([zlib.compress(terms(t).tobytes(), 1) for t in batch.column(0).to_pylist()], pa.binary())], names=[*keep, "shares"])

    own = docs.select("text", *keep)
    return own.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:]) + ", shares binary")


def fitted(docs: DataFrame, labels: DataFrame, most: int = 4000, rank: int = 64) -> Latent:
    """Learn from at most ``most`` labelled rows whose doc_id is not held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    found = shares(texts, ["doc_id", "quality"]).orderBy("doc_id", "quality").limit(most).collect()
    if not found:
        return Latent(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    # The driver holds one such matrix at a time.
    matrix = np.stack([np.frombuffer(zlib.decompress(r["shares"]), dtype=np.float32) for r in found])
    y = np.array([r["quality"] for r in found], dtype=float)
    del found
    weight = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 1
    for a, b, family in FAMILIES:
        weight[a:b] *= family
    matrix *= weight
    _, axes = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    model = Latent(weight, np.ascontiguousarray(axes[:, ::-1][:, : min(rank, TERMS)]).astype(np.float32), np.zeros((0, 1)), y, float(y.mean()))
    model.vectors = model.normed(matrix @ model.axes).astype(np.float32)
    return model


def scored(docs: DataFrame, model: Latent, neighbours: int = 32, power: float = 8.0) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... and ``score``, so that no name of the table can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = [f"c{k}" for k in range(len(docs.columns))], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.stack([terms(t) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(rows, neighbours, power))], names=[*names, "score"])

    return docs.toDF(*names).mapInArrow(run, "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(docs.schema.fields)) + "score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(slim, fitted(docs, labels, most)).withColumnRenamed("c0", "doc_id")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 4000) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    return scored(docs, fitted(docs, labels, most)).where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
