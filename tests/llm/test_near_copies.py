"""The near-duplicate stage of the pipeline against Jaccard similarity by brute force."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline as C
from tests.conftest import SF
from webloom.llm import golay, near_copies


def plain_set(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(5, len(words))
    return frozenset(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def plain_kept(rows):
    """doc_ids that stay: the smallest of each component of pairs with Jaccard 0.8 or more."""
    sets = {d: plain_set(t) for d, t in rows}
    to = {d: d for d in sets}

    def find(d):
        while to[d] != d:
            d = to[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            to[y] = x
    return {d for d in to if find(d) == d}


def edited(words, n, draw):
    words = list(words)
    for at in draw.sample(range(len(words)), n):
        words[at] = f"x{draw.random()}"
    return " ".join(words)


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in C.near_duplicates(spark, docs, SF).collect()} == plain_kept(rows)


def test_copies_with_edits(spark):
    draw, rows = random.Random(1), []
    for k in range(60):  # 200 words, 1 to 8 words replaced: similarity from below 0.7 to 0.95
        words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, edited(words, 1 + k % 8, draw)), (3 * k + 2, edited(words, 1 + k % 5, draw))]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (1005, "one three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in C.near_duplicates(spark, docs, "").collect()} == plain_kept(rows)


def test_large_group_goes_by_pivots(spark):
    draw = random.Random(2)
    words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows = [(k, edited(words, draw.randrange(1, 6), draw)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.representatives(docs, bucket=8).collect()} == plain_kept(rows)


def test_large_buckets_lose_no_link(spark):
    """Stars whose copies are similar to the middle only, chains, and loners, all in buckets far beyond the limit."""
    draw, rows = random.Random(5), []
    common = [f"c{draw.randrange(10**6)}" for _ in range(300)]
    for star in range(3):  # the middles are 0.6 to each other: they share buckets
        middle = edited(common, 10, draw).split(" ")
        rows += [(1000 * star + k, edited(middle, 5, draw)) for k in range(90)] + [(1000 * star + 500, " ".join(middle))]
    chain = list(common)
    for k in range(40):  # each link is 5 words away from the one before
        chain = edited(chain, 5, draw).split(" ")
        rows.append((5000 + k, " ".join(chain)))
    rows += [(6000 + k, edited(common, 12, draw)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = plain_kept(rows)
    assert len(kept) > 40  # the loners stay
    assert {r["doc_id"] for r in near_copies.representatives(docs, bucket=4).collect()} == kept


def test_rows_of_one_id_with_other_texts_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (None, "a b c d e f g"), (3, "o p q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in near_copies.representatives(docs).collect())
    assert kept == [(0, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m n"), (3, "o p q r s")]


def test_candidates_come_from_simhash_and_golay_keys(spark, monkeypatch):
    """Fingerprints are majorities; pairs at 0.8 meet by Golay keys with recall 0.99, unlike texts hardly ever."""
    draw = np.random.default_rng(7)
    sets = []
    for _ in range(200):  # 160 of 200 hashes in common
        both = draw.integers(0, 1 << 64, 200, dtype=np.uint64)
        sets += [both[:180], both[20:]]
    prints = np.array([near_copies.simhashes(s) for s in sets])
    one = np.array([near_copies.simhashes(sets[0][k : k + 1]) for k in range(180)]).view(np.uint64)
    bits = np.unpackbits(one.view(np.uint8).reshape(180, -1), axis=1, bitorder="little")
    assert (np.packbits(2 * bits.sum(axis=0) > 180, bitorder="little").view(np.int64) == prints[0]).all()
    nodes = spark.createDataFrame([(k, 180, int(p[-1]), p[:-1].tolist()) for k, p in enumerate(prints)], "node long, size int, sketch long, prints array<long>")
    pairs, grouped = near_copies.buckets(nodes, 64, near_copies.LEAST)
    met = {(r["a"], r["b"]) for r in pairs.collect()}
    assert len(met & {(2 * k, 2 * k + 1) for k in range(200)}) >= 198 and len(met) <= 202 and grouped.isEmpty()
    pairs, grouped = near_copies.buckets(nodes, 1, near_copies.LEAST)  # large groups: one row a node
    assert pairs.isEmpty() and grouped.count() == grouped.select("node").distinct().count() >= 396
    monkeypatch.setattr(golay, "keys", lambda words: np.full((len(words), 6), -1))
    assert not near_copies.segment_keys(prints[:, 0].copy())[0].size


def test_pairs_of_a_group_make_no_rows_in_small_buckets(spark, monkeypatch):
    """A group of near copies is settled by its pivots alone; the pairs that are compared stay far below its square."""
    draw = random.Random(11)
    words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows = [(k, edited(words, draw.randrange(1, 5), draw)) for k in range(160)]  # copies of each other
    rows += [(1000 + k, edited(words, 13, draw)) for k in range(80)]  # 0.6 to 0.7 to all others
    asked, whole = [], near_copies.links

    def counted(docs, heads, pairs, least=near_copies.LEAST):
        asked.append(pairs.count())
        return whole(docs, heads, pairs, least)

    monkeypatch.setattr(near_copies, "links", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.representatives(docs, bucket=16).collect()} == plain_kept(rows)
    assert asked[0] < 400 and sum(asked) < 4000, asked


def test_further_fingerprints_keep_pairs_at_the_limit():
    draw = np.random.default_rng(3)
    bits = lambda s: np.concatenate([near_copies.simhashes(s)[:-1], near_copies.simhashes(s, near_copies._OTHER_FLIP, near_copies._OTHER_TIMES)]).view(np.uint64)
    for n, both in ((36, 32), (45, 40), (144, 128)):  # 0.8 each
        for _ in range(40):
            drawn = draw.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
            assert int(np.bitwise_count(bits(drawn[:n]) ^ bits(drawn[n - both :])).sum()) <= near_copies.DEEP
