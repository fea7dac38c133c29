"""Substring dedup by level-wise doubling of word windows.

Levels are window lengths, each twice the one before. At the first level (half the
window that is removed, 25 words for 50) only *sampled* windows are compared: of the
windows inside each window of the next level, the one with the least hash. Equal windows
of the next level hold equal samples, so none is lost, and one window in about thirteen
travels. Only windows over a sample that occurs in two different texts are extended to
the next level and compared there, and so on: windows at 2n survive only where the
n-word windows at both their ends did. The doubling ends at the length that is removed
(``extend=False``), or when no candidate survives, which also gives the longest repeat.

Texts with equal words are settled first: all but the one with the smallest doc_id lose
every word (if they have a whole window), and only that one takes part in the levels.
So a group of copies costs one row each, whatever its size.

Windows are compared by 128 bits (two polynomial hashes, each over its own half of the
128-bit word hashes). A window shared by very many texts is first settled inside each
slice of texts: the smallest doc_id stands for the slice, so a hot window has one row a
slice, not a text. What is left of it is aggregated map-side, and the join that tells the
rows reads a saved table, so a hot window can be split there.

A text is named by (doc_id, row), row being the hash of both: rows of one doc_id with
different texts keep their own windows and results.

A window repeats if its words also start in a document with a smaller doc_id; windows
are judged on the input. Rows with a null doc_id keep their words and remove none; null
texts have no words; rows with equal doc_id don't remove each other's words; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import discard, record_batch, saved, slices

#: Fixed odd multipliers of the two window hashes and of the finalizer.
FIRST, SECOND, FINAL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Texts whose windows are settled together before any shuffle.
SLICE = 2048


def split(text: str | None) -> list[bytes]:
    """Words of the whole text; bytes.split() cuts at exactly \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two rows of 64-bit hashes, the halves of the 128-bit ones."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2).T


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse mod 2**64, at least ``n`` of each."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1024, 1 << n.bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[base] = (out[0], out[1])
    return _powers[base]


def window_hashes(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """Finalized hash of each window of ``length`` words."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down[:n], dtype=np.uint64)])
    whole = (sums[length:] - sums[:-length]) * up[: n - length + 1]
    whole ^= whole >> np.uint64(29)
    whole *= np.uint64(FINAL)
    return whole ^ (whole >> np.uint64(32))


def sampled(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of length/2, and for each window of ``length`` where its least one starts."""
    small = window_hashes(hashes, length // 2, FIRST)
    span = length - length // 2 + 1
    if len(small) < span:
        return small, np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(small, span)
    return small, views.argmin(axis=1) + np.arange(len(views))


#: What names a text.
KEY = ["doc_id", "row"]
_KEY = [("doc_id", pa.int64()), ("row", pa.int64())]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), "text")


_FIRST = pa.schema([*_KEY, ("digest", pa.binary()), ("n_words", pa.int64()), ("sha", pa.string()), ("seeds", pa.list_(pa.int64()))])


def first_level(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, row, digest and count of the words, digest of the text if nothing goes, and its distinct samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(2).to_pylist():
                words = split(text)
                sha = hashlib.sha256(b" ".join(words))
                small, least = sampled(word_hashes(words)[0], length)
                rows.append((sha.digest()[:16], len(words), sha.hexdigest(), np.unique(small[least]).view(np.int64)))
            digest, n, sha, seeds = zip(*rows, strict=True)
            yield record_batch(_FIRST, doc_id=batch.column(0), row=batch.column(1), digest=digest, n_words=n, sha=sha, seeds=seeds)

    return docs.mapInArrow(run, "doc_id long, row long, digest binary, n_words long, sha string, seeds array<long>")


#: What a slice of texts knows about a window: nothing more than its own text has it; it
#: stands for the slice and another text of the slice has it too; a smaller doc_id has it.
ALONE, STANDS, LATER = 0, 1, 2


def settled(first: np.ndarray, second: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> dict[str, object]:
    """Rows of a slice for the shuffle: h1, h2, doc_id, row, starts (list) and state.

    A text has one row for each of its windows that still needs comparing, with all
    starts of it, and one row for all starts that the slice has settled.
    """
    order = np.lexsort((at, row, doc, second, first))
    a, b, d, r, p = first[order], second[order], doc[order], row[order], at[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least, most = d[begin], d[np.append(begin[1:], len(d)) - 1]
    state = np.where(d > least[group], LATER, np.where(most > least, STANDS, ALONE)[group])
    open_, done = np.flatnonzero(state < LATER), np.flatnonzero(state == LATER)
    done = done[np.lexsort((r[done], d[done]))]
    changes = lambda k, *of: np.concatenate([[True], np.logical_or.reduce([x[k][1:] != x[k][:-1] for x in of])])[: len(k)]
    head, tail = changes(open_, group, r), changes(done, d, r)
    heads, tails = open_[head], done[tail]
    offsets = np.concatenate([np.flatnonzero(head), len(open_) + np.flatnonzero(tail), [len(open_) + len(done)]])
    return {
        "h1": a[np.concatenate([heads, tails])].view(np.int64), "h2": b[np.concatenate([heads, tails])].view(np.int64), "doc_id": np.concatenate([d[heads], d[tails]]), "row": np.concatenate([r[heads], r[tails]]),
        "starts": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(p[np.concatenate([open_, done])], pa.int32())),
        "state": np.concatenate([state[heads], state[tails]]).astype(np.int8),
    }


_WINDOW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), *_KEY, ("starts", pa.list_(pa.int32())), ("state", pa.int8())])


def extended(texts: DataFrame, length: int, by_seed: bool) -> DataFrame:
    """Candidate windows of ``length``: rows as ``settled`` makes them.

    ``texts`` has doc_id, row, text and marks: repeated samples (by_seed), else the starts of
    the windows of ``length`` whose halves both repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            parts: list[tuple[np.ndarray, ...]] = []
            for doc, row, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                one, two = word_hashes(split(text))
                own = marks.values.to_numpy()
                if by_seed:
                    small, least = sampled(one, length)
                    at = np.flatnonzero(np.isin(small.view(np.int64), own)[least])
                else:
                    at = np.unique(own[own + length <= len(one)])
                if len(at):
                    parts.append((window_hashes(one, length, FIRST)[at], window_hashes(two, length, SECOND)[at], np.full(len(at), doc), np.full(len(at), row), at))
            if parts:
                yield record_batch(_WINDOW, **settled(*(np.concatenate(x) for x in zip(*parts, strict=True))))

    return texts.select(*KEY, "text", "marks").mapInArrow(run, "h1 long, h2 long, doc_id long, row long, starts array<int>, state byte")


def compared(windows: DataFrame) -> DataFrame:
    """Saved (doc_id, row, starts, later) of candidate windows that two texts have; later: a smaller doc_id has it."""
    found = saved(windows, "candidates")
    open_ = found.where(F.col("state") < LATER)
    shared = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("state").alias("most")).where((F.col("lo") < F.col("hi")) | (F.col("most") > ALONE))
    met = open_.join(shared.select("h1", "h2", "lo"), ["h1", "h2"]).select(*KEY, "starts", (F.col("doc_id") > F.col("lo")).alias("later"))
    out = saved(met.union(found.where(F.col("state") == LATER).select(*KEY, "starts", F.lit(True))), "windows")
    discard(found)
    return out


def starts_of(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*KEY).agg(F.flatten(F.collect_list("starts")).alias("marks"))


def repeats(docs: DataFrame, length: int = 50, extend: bool = False) -> tuple[DataFrame, DataFrame]:
    """What to remove: (status of every row: doc_id, row, n_words, sha, copy, longest), (doc_id, row, marks: window starts).

    ``longest`` is the longest level at which a window of the text is also in a text with other words, 0 if none is.
    """
    slim = keyed(docs)
    level = saved(first_level(slim, length), "level")
    owners = saved(level.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("owner")), "owners")
    # Joins on a digest that very many copies share are apart, each from saved tables, so that either can be split.
    owned = saved(level.drop("seeds").join(owners, "digest", "left"), "owned")
    first = saved(level.join(owners.withColumnRenamed("owner", "doc_id"), ["digest", "doc_id"], "left_semi").select(*KEY, "digest", "seeds"), "first")
    seeds = first.select(*KEY, F.explode("seeds").alias("seed"))
    twice = saved(seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed"), "seeds")
    marks = saved(seeds.join(twice, "seed").groupBy(*KEY).agg(F.collect_set("seed").alias("marks")), "marks")
    windows = compared(extended(slim.join(marks, KEY), length, True))
    discard(twice, marks)
    texts = saved(slim.join(windows.select(*KEY).distinct(), KEY, "left_semi"), "texts") if extend else slim  # few texts have what the levels above look at
    remove = saved(starts_of(windows.where("later")), "starts")
    reached = [saved(windows.select(*KEY).distinct().withColumn("longest", F.lit(length)), "reached")]
    size, at_level = 2 * length, windows
    while extend and not at_level.isEmpty():
        at = F.explode(F.concat("starts", F.transform("starts", lambda p: p - size // 2)))  # noqa: B023
        ends = at_level.select(*KEY, at.alias("at"))
        # A window of twice the length starts where one survives and another at its end does.
        whole = saved(starts_of(ends.groupBy(*KEY, "at").count().where("count > 1 and at >= 0").select(*KEY, F.array("at").alias("starts"))), "marks")
        higher = compared(extended(texts.join(whole, KEY), size, False))
        discard(whole, at_level)
        at_level = higher
        reached.append(saved(at_level.select(*KEY).distinct().withColumn("longest", F.lit(size)), "reached"))
        size *= 2
    discard(at_level, *([texts] if extend else []))
    longest = reduce(DataFrame.union, reached).groupBy(*KEY).agg(F.max("longest").alias("longest"))
    reach = saved(first.select(*KEY, "digest").join(longest, KEY).groupBy("digest").agg(F.max("longest").alias("longest")), "longest")
    told = owned.select(*KEY, "digest", "n_words", "sha", (F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False)) & (F.col("n_words") >= length)).alias("copy"))
    status = saved(told.join(reach, "digest", "left").drop("digest").withColumn("longest", F.coalesce("longest", F.lit(0))), "status")
    discard(level, owners, owned, first, reach, *reached)
    return status, remove


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a window of ``length`` that starts at ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts[starts < n], 1)
    np.add.at(edge, np.minimum(starts[starts < n] + length, n), -1)
    return np.cumsum(edge[:n]) > 0


_KEPT = pa.schema([*_KEY, ("n_removed", pa.int64()), ("kept", pa.string())])


def digested(docs: DataFrame, length: int = 50, extend: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and longest of every document."""
    status, remove = repeats(docs, length, extend)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, marks in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = split(text)
                gone = covered(marks.values.to_numpy(), len(words), length)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            removed, kept = zip(*rows, strict=True)
            yield record_batch(_KEPT, doc_id=batch.column(0), row=batch.column(1), n_removed=removed, kept=kept)

    each = keyed(docs).join(remove, KEY).mapInArrow(run, "doc_id long, row long, n_removed long, kept string")
    cut = saved(each.groupBy(*KEY).agg(F.max("n_removed").alias("n_removed"), F.max("kept").alias("kept")), "cut")  # equal rows only
    nothing = hashlib.sha256(b"").hexdigest()
    return status.join(cut, KEY, "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.col("longest").cast("long").alias("longest"),
    )


WORD_AND_SPACE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def without(text: str | None, copy: bool | None, marks: np.ndarray | None, length: int) -> str | None:
    """The text without its removed words and the blanks after them; untouched where nothing goes."""
    if text is None or (marks is None and not copy):
        return text
    if copy:
        return ""
    parts = WORD_AND_SPACE.findall(text)
    gone = covered(marks, len(parts), length).tolist()
    return "".join(p for p, g in zip(parts, gone, strict=True) if not g).rstrip()


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with repeated words removed from ``text``; every row stays, other columns as they were."""
    status, remove = repeats(docs, length)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at, own, text = names.index("text"), f"c{names.index('doc_id')}", f"c{names.index('text')}"
    marks = saved(status.where("copy").select(*KEY).distinct().withColumn("copy", F.lit(True)).join(remove, KEY, "full_outer"), "removal")
    doc = F.col(own).cast("long")
    joined = plain.withColumns({"_doc": doc, "_row": F.xxhash64(doc, text)}).join(marks, (F.col("_doc") == marks["doc_id"]) & (F.col("_row") == marks["row"]), "left").drop("_doc", "_row", *KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts = [m.values.to_numpy() if m.is_valid else None for m in batch.column(len(names) + 1)]
            texts = [without(t, c, m, length) for t, c, m in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), starts, strict=True)]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(names))])

    return joined.mapInArrow(run, ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))).toDF(*names)
