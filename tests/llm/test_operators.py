"""Each training-data operator against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF
from webloom.llm import classifier, golay, media, packing, pieces, quality_rules, secrets, sharding, simhash, substring_dedup
from webloom.llm.common import numbered
from webloom.llm.graph import components
from webloom.llm.queries import op3_neighbour_quality, op5_golay_simhash, tokenizer

DOCS = T.StructType([T.StructField(n, t()) for n, t in (("doc_id", T.LongType), ("text", T.StringType), ("lang", T.StringType), ("source", T.StringType), ("n_chars", T.LongType))])
LONG = " ".join(f"w{k % 977}" for k in range(4000))
ODD = [
    (1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", "s", 3), (5, "one", "en", "s", 3), (5, "one", "en", "s", 3),
    (6, LONG, "en", "s", 1), (7, "x " + LONG, None, "s", 1), (8, "漢字 🙂 naïve\x0b\x0cÉTÉ ſecret=abcdefgh", "fr", "t", 9), (9, "a" * 5000, "en", "s", 5000), (None, "no id at all", "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Edge rows, with columns whose names clash with those the operators make."""
    return spark.createDataFrame(ODD, DOCS).withColumns({"fp": F.lit("mine"), "_score": F.lit(-1), "size": F.lit("mine"), "copy": F.lit(0), "c0": F.lit(7), "spans": F.lit("mine")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- 1


def brute_windows(rows, length):
    first = {}
    for doc, text in rows:
        w = words_of(text)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if doc is not None and first.get(tuple(w[k : k + length]), doc) < doc:
                gone[k : k + length] = [True] * length
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [50, 6])
def test_windows_match_brute_force(spark, docs, odd, length):
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digested(df, length, extend=True).collect()), key=repr)
        assert got == brute_windows(rows, length)


def clashing():
    """Rows that share a doc_id but not the text."""
    words = [f"a{k}" for k in range(120)]
    passage, other = " ".join(words), " ".join(f"b{k}" for k in range(200))
    return [(1, passage), (2, f"x {passage} tail"), (2, other), (2, other), (3, f"{other} {passage}"), (3, f"y {other}"), (4, None), (4, "  " + passage.replace(" ", "  ")), (None, passage), (None, other), (5, other + " " + other)]


def test_rows_of_one_id_with_other_texts(spark):
    df = spark.createDataFrame(clashing(), "doc_id long, text string")
    for extend in (True, False):
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digested(df, 50, extend).collect()), key=repr)
        assert got == brute_windows(clashing(), 50)
    out = sorted(((r["doc_id"], len(words_of(r["text"]))) for r in substring_dedup.deduplicated(df, 50).collect()), key=repr)
    assert out == sorted(((d, n - gone) for d, n, gone, _ in brute_windows(clashing(), 50)), key=repr)


def test_slices_settle_by_text(spark):
    """Rows of a slice by hand: the smallest doc_id stands, whichever of its texts has the window."""
    n = np.array
    got = substring_dedup.settled(n([7, 7, 7, 7, 9], np.uint64), n([1, 1, 1, 1, 1], np.uint64), n([5, 5, 6, 6, 6]), n([50, 51, 60, 60, 60]), n([3, 4, 5, 6, 7]))
    rows = sorted(zip(got["h1"].tolist(), got["doc_id"].tolist(), got["row"].tolist(), got["starts"].to_pylist(), got["state"].tolist(), strict=True))
    assert rows == [(7, 5, 50, [3], 1), (7, 5, 51, [4], 1), (7, 6, 60, [5, 6], 2), (9, 6, 60, [7], 0)]


def test_hot_passage_and_longest_level(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(130))
    rows = [(k, " ".join(f"u{rng.random()}" for _ in range(20)) + " " + passage + f" end{k}") for k in range(300)]
    got = {r["doc_id"]: r for r in substring_dedup.digested(spark.createDataFrame(rows, "doc_id long, text string"), 50, extend=True).collect()}
    assert got[0]["n_removed"] == 0 and all(got[k]["n_removed"] == 130 and got[k]["longest"] == 100 for k in range(1, 300))


def test_dedup_keeps_rows_and_columns(spark, odd, empty):
    out = substring_dedup.deduplicated(odd, 50)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[6] == LONG and texts[7] == "x" and texts[1] is None and texts[3] == " \n\t "
    assert substring_dedup.digested(empty).count() == 0 and substring_dedup.deduplicated(empty).count() == 0


# ---------------------------------------------------------------- 2


def test_shards(spark, docs, odd, empty):
    big = docs.select("doc_id", "text", "lang", "source").unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit("copy of one text " * 8).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source")))
    rows = sharding.sharded(big, 4).collect()
    assert len(rows) == big.count() and {r["shard"] for r in rows} == set(range(4))
    sizes = Counter()
    slots = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[(r["shard"], r["slot"])] += 1
    most = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * most
    assert max(slots.values()) == 1 and all(max(s for k, s in slots if k == shard) + 1 == sum(k == shard for k, _ in slots) for shard in range(4))
    text = {r["doc_id"]: r["text"] for r in big.collect()}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    assert sharding.sharded(odd, 5).count() == odd.count() and sharding.sharded(empty, 3).count() == 0


def walked(node, rows):
    """Every cut against the plain weighted quantile of the light points of its node, sorted along its dimension."""
    light = sorted((r[node.dimension] * sharding.HALF + r["tie"], r["size"]) for r in rows if not r["heavy"]) if node.left else []
    assert sum(r["size"] for r in rows if not r["heavy"]) == node.size and {r["unit"] for r in rows if r["heavy"]} == {h.unit for h in node.heavy}
    if node.left is None:
        return
    assert node.box[node.dimension][1] - node.box[node.dimension][0] == max(b - a for a, b in node.box.values())
    assert all(a <= r[d] <= b for r in rows if not r["heavy"] for d, (a, b) in node.box.items())
    total = node.size + sum(h.size for h in node.heavy)
    wanted = min(max(total * node.left.shards / node.shards - sum(h.size for h in node.left.heavy), 0), node.size)
    sums, best = [0], float("inf")
    for k, (at, size) in enumerate(light):
        sums.append(sums[-1] + size)
    edges = [0, *[k for k in range(1, len(light)) if light[k][0] != light[k - 1][0]], len(light)]
    best = min(abs(sums[k] - wanted) for k in edges)
    assert abs(node.left.size - wanted) <= best + 1 and node.left.size == sum(s for at, s in light if at < node.at)
    left = {h.unit for h in node.left.heavy}
    goes = lambda r: r["unit"] in left if r["heavy"] else r[node.dimension] * sharding.HALF + r["tie"] < node.at
    walked(node.left, [r for r in rows if goes(r)])
    walked(node.right, [r for r in rows if not goes(r)])


def copies(spark, docs):
    """Documents with groups of copies: light ones, heavy ones, and one that no shard can hold."""
    more = [(10_000 + k, f"group {k % 7} " * 40, "en", f"s{k % 3}") for k in range(200)] + [(20_000 + k, "heavy copy of one text " * 60, "fr", "hot") for k in range(60)] + [(30_000 + k, "hot copy " * 90, "en", "hot") for k in range(900)]
    return docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))


def test_tree_matches_plain_quantiles(spark, docs):
    rows, total = sharding.points(copies(spark, docs), 7)
    plain = rows.collect()
    assert sum(r["size"] for r in plain) == total
    walked(sharding.tree(rows, 7, 0.0), plain)


def test_equal_texts_share_a_shard(spark, docs):
    df = copies(spark, docs)
    rows = sharding.sharded(df, 8).collect()
    text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    sizes, of, weight = Counter(), {}, Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
        of.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        weight[text[r["doc_id"]]] += r["size"]
    target = sum(sizes.values()) / 8
    assert len(rows) == df.count() and all(len(s) == 1 for t, s in of.items() if weight[t] <= target) and len(of["hot copy " * 90]) > 1
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_numbers_are_gapless_for_a_hot_key(spark):
    df = spark.range(1000).select((F.col("id") % 10 == 0).alias("k"), (F.col("id") % 7).alias("o"))
    rows = numbered(df, ["k"], ["o"], "n", 16).collect()
    assert sorted(r["n"] for r in rows if r["k"]) == list(range(100)) and sorted(r["n"] for r in rows if not r["k"]) == list(range(900))


# ---------------------------------------------------------------- 3


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op3_neighbour_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in judged) / len(judged) > 0.9


def test_votes_match_plain_loop():
    rng = np.random.default_rng(0)
    shares = np.abs(rng.normal(size=(50, classifier.TERMS))).astype(np.float32)
    model = classifier.Latent(np.ones(classifier.TERMS, np.float32), rng.normal(size=(classifier.TERMS, 8)).astype(np.float32), np.zeros((0, 8)), rng.integers(0, 2, 50).astype(float), 0.5)
    model.vectors = model.project(shares).astype(np.float32)
    asked = shares[:7] + 0.01
    mine = model.project(asked)
    for row, got in zip(mine, model.score(asked, 5, 8.0, block=16), strict=True):
        near = sorted(((float(v @ row), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:5]
        weight = [max(s, 0) ** 8 for s, _ in near]
        assert abs(got - sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight)) < 1e-4


def test_classifier_edges(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (6, 0), (99, None), (5, 1)], "doc_id long, quality int")
    got = classifier.classified(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert classifier.classified(odd, labels.limit(0)).where("score = 0.5").count() == odd.count()
    assert classifier.classified(empty, labels).count() == 0
    assert classifier.accepted(odd, labels.limit(0)).columns == odd.columns
    kept = classifier.accepted(odd, labels).collect()
    assert all(r["_score"] == -1 for r in kept) and len(kept) == sum(r["score"] >= 0.3 for r in got)


# ---------------------------------------------------------------- 4


def test_packing(spark, docs, odd, empty):
    path = tokenizer("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    for df in (docs, odd):
        rows = packing.packed(df, path).collect()
        texts = Counter((r["doc_id"], r["text"]) for r in df.collect())
        used, at = Counter(), {}
        for r in rows:
            used[r["sequence_id"]] += r["length"]
            at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert max(used.values()) <= 2048
        for spans in at.values():
            end = 0
            for start, n in sorted(spans):
                assert start == end
                end = start + n
        want = Counter()
        for (doc, text), n in texts.items():
            ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
            first = len(ids) % 2048 or 2048
            for k, start in enumerate([0, *range(first, len(ids), 2048)]):
                part = ids[start : first if k == 0 else start + 2048]
                want[(doc, k, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += n
        assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
        total = sum(r["length"] for r in rows)
        assert len(used) <= -(-total // 2048) * 1.12 + 2
    assert packing.packed(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece(seed):
    rng = random.Random(seed)
    histogram = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(3000))
    classes = packing.plan(dict(histogram), 2048)
    held = Counter()
    for times, filled in classes:
        assert times > 0 and sum(s * k for s, k in filled) <= 2048
        for s, k in filled:
            held[s] += times * k
    assert held == histogram
    assert sum(t for t, _ in classes) <= sum(s * n for s, n in histogram.items()) / 2048 * 1.02 + 2


# ---------------------------------------------------------------- 5


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[a : a + k]), 42) for a in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_meet_within_two_errors():
    words = np.random.default_rng(5).integers(0, 1 << 23, 400)
    own = golay.keys(words)
    for error in [0, *(1 << a for a in range(23)), *((1 << a) | (1 << b) for a in range(23) for b in range(a))]:
        other = golay.keys(words ^ error)
        assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2)).all()


def joined_by_distance(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("bucket", [64, 1])
def test_components_match_brute_force(spark, docs, odd, bucket):
    rng = random.Random(1)
    for df in (docs, odd):
        prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
        group = joined_by_distance(sorted({p for _, p in prints}))
        first = {}
        for doc, p in prints:
            if doc is not None:
                first[group[p]] = min(first.get(group[p], doc), doc)
        want = Counter((doc, p, first.get(group[p], doc)) for doc, p in prints)
        assert want == Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.clustered(df, bucket=bucket).collect())
    bits = [rng.getrandbits(64) for _ in range(60)]
    bits += [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in bits for _ in range(4)]
    bits += [bits[0] ^ (1 << a) for a in range(40)]
    signed = sorted({b - (1 << 64 if b >> 63 else 0) for b in bits})
    edges = simhash.links(spark.createDataFrame([(b,) for b in signed], "fp long"), bucket)
    labels = {r["node"]: r["label"] for r in components(edges).collect()}
    want = joined_by_distance(bits)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    full = {b: labels.get(b - (1 << 64 if b >> 63 else 0), f"alone{b}") for b in want}
    assert groups(full) == groups(want)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    labels = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({labels[k] for k in range(201)}) == 1 and len({labels[k] for k in range(1000, 1300)}) == 1 and 5000 not in labels and labels[0] != labels[1000]


def test_representatives(spark, odd, empty):
    out = simhash.representatives(odd)
    rows = [(r[0], r[1]) for r in ODD]
    group = joined_by_distance(sorted({brute_fingerprint(t) for _, t in rows}))
    first = {}
    for doc, text in rows:
        if doc is not None:
            first.setdefault(group[brute_fingerprint(text)], doc)
    assert out.columns == odd.columns and sorted((r["doc_id"], r["text"]) for r in out.where("doc_id is not null").collect()) == sorted({(d, t) for d, t in rows if d in first.values()}, key=lambda x: x[0])
    assert out.where("doc_id is null").count() == 1
    assert simhash.representatives(empty).count() == 0
    assert {len(r["fingerprint"]) for r in op5_golay_simhash(spark, SF).collect()} == {16}


# ---------------------------------------------------------------- 6


def test_base_spans():
    text = 'Password: "abcdef" token=ab token = token=xy AKIA' + "A" * 16 + " AKIAB " + "0123456789abcdef" * 2 + "G ſecret=abcdefgh api_key='k-1.2/3='"
    spans = [(k, text[a:b]) for k, a, b in secrets.base_spans(text)]
    assert spans == [("assign", 'Password: "abcdef'), ("assign", "token = token=xy"), ("assign", "api_key='k-1.2/3="), ("access", "AKIA" + "A" * 16), ("hex", "0123456789abcdef" * 2)]


ORDINARY = [
    "getUserAccountByIdentifier{n}", "section/part" + "1" * 28 + "/item{n}", "assets/images/gallery/photo{n}", "release-2024-01-15-build-{n}", "com/example/project/Main{n}", "user_profile_settings_page_{n}",
    "INVOICE2024NUMBER000000{n}", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{n}", "abcdefghijklmnopqrstuvwxyz{n}", "HandleHttpRequestTimeoutError{n}", "the-quick-brown-fox-jumps-over-{n}", "order20240115000000000{n}",
]
PROSE = "The committee will consider the report and its annex at the next meeting in March, when members of both houses return. "


def plain_statistics(token, letters):
    """The three p-values of one token, by loops."""
    upper = lambda z: max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)
    at = [letters.index(c) for c in token]
    n, size = len(at), len(letters)
    chi, free = sum((at.count(k) - n / size) ** 2 / (n / size) for k in range(size)), size - 1
    uniform = upper(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    side = [x >= size / 2 for x in at]
    ups = sum(side)
    runs, most = 1 + sum(a != b for a, b in zip(side, side[1:], strict=False)), 2 * ups * (n - ups)
    spread = most * (most - n) / (n * n * (n - 1))
    run_p = 2 * upper(abs(runs - most / n - 1) / math.sqrt(spread) if spread > 0 else math.sqrt(n))
    mean = sum(at) / n
    power = sum((x - mean) ** 2 for x in at)
    lagged = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:], strict=False))
    return uniform, min(1, run_p), min(1, 2 * upper(abs(lagged / power * n + 1) / math.sqrt(n) if power else math.sqrt(n)))


def test_battery_matches_loops():
    rng = random.Random(6)
    for k, (_, letters, least) in enumerate(secrets.ENCODINGS):
        for n in (least, 77, 1000):
            for token in ("".join(rng.choice(letters) for _ in range(n)), "".join(rng.choice(letters[:3]) for _ in range(n)), letters[1] * n):
                got = secrets.battery(np.array([[secrets._PLACE[k][c] for c in token]]), len(letters))[0]
                assert np.allclose(np.log(got), np.log(plain_statistics(token, letters)), rtol=1e-6, atol=1e-6)
    uniform, runs, serial = secrets.battery(np.array([list(range(16)) * 4]), 16)[0]
    assert uniform > 0.9 and runs < 0.01 and serial < 0.01


def test_discoveries_match_benjamini_hochberg():
    rng = random.Random(8)
    ps = [(k + 1) / 50 for k in range(50)]
    for _ in range(200):
        bins = Counter(min(int(rng.expovariate(rng.choice([0.05, 0.5]))), 49) for _ in range(rng.randrange(1, 60)))
        each = sorted(ps[b] for b in bins.elements())
        rank = max((k + 1 for k, p in enumerate(each) if p <= 0.2 * (k + 1) / len(each)), default=0)
        last = secrets.discovered(bins, ps, 0.2)
        assert sum(n for b, n in bins.items() if last is not None and b <= last) == rank


def test_share_of_ordinary_tokens_among_the_reported(spark):
    """Planted keys among ten times as many ordinary tokens, in a table of prose."""
    rng = random.Random(2)
    letters = secrets.ENCODINGS[5][1]
    keys = ["".join(rng.choice(letters[: rng.choice([62, 64])]) for _ in range(rng.choice([32, 40, 64, 88, 700]))) for _ in range(120)]
    plain = [rng.choice(ORDINARY).format(n=rng.randrange(10**4)) for _ in range(1200)]
    rows = [(k, PROSE * 5 + f"see {t} here") for k, t in enumerate(keys + plain)]
    got = {r["doc_id"] for r in secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect() if "random" in r["spans"]}
    caught, wrong = sum(k < 120 for k in got), sum(k >= 120 for k in got)
    assert caught >= 95 and wrong <= 0.05 * len(got)
    assert secrets.scanned(spark.createDataFrame(rows[120:], "doc_id long, text string")).where("spans like '%random%'").count() == 0


def test_least_lengths_and_alphabets():
    assert [secrets.ENCODINGS[k][0] for t in ("0a1b" * 6, "0A1B" * 6, "XYZ234" * 4, "zx09" * 6, "aB3" * 7, "aB3+" * 5, "aB3_" * 5) if (k := secrets.inferred(t)) is not None] == [n for n, _, _ in secrets.ENCODINGS]
    assert all(secrets.inferred(t) is None for t in ("aB3" * 6, "0a1b" * 5, "abcdefgh" * 5, "12345678" * 5, "aB3+/-_" * 9))
    mixed = "Ab3" * 8 + "+x_" + "Zy9" * 9
    assert [(a, b) for a, b, _, _ in secrets.candidates(f"x {mixed} y", [])] == [(2, 28), (29, 56)]


def test_secrets_edges(spark, odd, empty):
    got = {r["doc_id"]: r for r in secrets.scanned(odd).collect()}
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[8]["n_assign"] == 0
    out = secrets.redacted(odd)
    assert out.columns == odd.columns and sorted(map(repr, (r["text"] for r in out.collect()))) == sorted(map(repr, ("[SECRET]" if r[0] == 9 else r[1] for r in ODD)))
    assert secrets.scanned(empty).count() == 0
    one = spark.createDataFrame([(1, "é token=abcdefgh🙂 and password: secret99 end")], "doc_id long, text string")
    assert secrets.redacted(one).first()["text"] == "é [SECRET]🙂 and [SECRET] end"


# ---------------------------------------------------------------- 7 and 10


def test_pieces_match_the_library(spark, docs, odd, empty):
    path = tokenizer("piece_bpe_32k.model")
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, odd):
        want = Counter()
        for r in df.collect():
            ids = plain.encode(r["text"] or "")
            want[(r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(plain.decode(ids)))] += 1
        got = pieces.encoded(df, path).collect()
        assert want == Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) and all(r["agenda_agrees"] for r in got)
        assert {r["whole_agrees"] for r in got} == {True, None}
        assert all(r["whole_agrees"] for r in pieces.encoded(df, path, every=1).collect())
    assert pieces.encoded(empty, path).count() == 0


def test_ids_are_those_of_the_agenda():
    """A broken agenda changes the ids and is told, for the rows it concerns and for chunks met before."""
    words = pieces.Vocabulary(tokenizer("piece_bpe_32k.model"))
    right = words.agendas
    batch = pa.record_batch({"doc_id": [1, 2, 3, 4], "text": ["good text here", "a bad word", "", "bad again"]})
    plain = pieces.encoded_rows(words, batch, 1).to_pylist()
    words.met = pieces.Met()

    def broken(chunks):
        values, sizes = right(chunks)
        at = np.cumsum(sizes) - sizes
        for c, a in zip(chunks, at, strict=True):
            if "bad" in c:
                values[a] = 5
        return values, sizes

    words.agendas = broken
    for _ in range(2):
        got = pieces.encoded_rows(words, batch, 2).to_pylist()
        assert [r["agenda_agrees"] for r in got] == [True, False, True, False] and [r["whole_agrees"] for r in got] == [True, None, True, None]
        assert [a["ids_sha256"] == b["ids_sha256"] for a, b in zip(got, plain, strict=True)] == [True, False, True, False]


def test_agenda_of_one_equals_many_and_library():
    words = pieces.Vocabulary(tokenizer("piece_bpe_32k.model"))
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeéèñ漢🙂 \n\t▁thing.,!") for _ in range(rng.randrange(1, 90))) for _ in range(400)]
    for text in texts:
        assert [i for c in words.chunks(text) for i in words.agenda(c)] == words.library.encode(text)
    chunks = sorted({c for t in texts for c in words.chunks(t)})
    values, sizes = words.agendas(chunks)
    at = np.cumsum(sizes) - sizes
    assert all(values[a : a + n].tolist() == words.agenda(c) for c, a, n in zip(chunks, at, sizes, strict=True))


def brute_unigram(words, chunk):
    unknown = words._table[3]
    best = [(0.0, 0)]
    for d in range(1, len(chunk) + 1):
        options = []
        for n in range(1, min(d, 16) + 1):
            piece = chunk[d - n : d]
            if piece in words.score:
                options.append((best[d - n][0] + words.score[piece], -best[d - n][1] - 1))
            elif n == 1:
                options.append((best[d - 1][0] + unknown, -best[d - 1][1] - len(piece.encode())))
        score, tokens = max(options)
        best.append((score, -tokens))
    return best[-1][1]


def test_very_long_chunks():
    words = pieces.Vocabulary(tokenizer("piece_bpe_32k.model"))
    rng = random.Random(9)
    for n in (13, 21, 257, 3000):
        chunk = "".join(rng.choice("theinganord漢é🙂") for _ in range(n))
        assert words.unigram_counts([chunk, "a"]) == [brute_unigram(words, chunk), 1]
        assert words.agenda(chunk) == words.library.encode("\n" + chunk)[2:]
    assert words.unigram_counts(["x" * 300_000])[0] > 0


def test_trie_counts_match_brute_force(spark, docs, odd, empty):
    path = tokenizer("piece_bpe_32k.model")
    words = pieces.Vocabulary(path)
    known = {}
    for df in (docs, odd):
        got = pieces.token_counts(df, path).collect()
        want = Counter()
        for r in df.collect():
            cut = words.chunks(r["text"] or "")
            for c in cut:
                if c not in known:
                    known[c] = brute_unigram(words, c)
            want[(r["doc_id"], len(cut), sum(known[c] for c in cut))] += 1
        assert want == Counter((r["doc_id"], r["n_chunks"], r["n_tokens"]) for r in got)
    assert pieces.token_counts(empty, path).count() == 0


# ---------------------------------------------------------------- 8


def test_quality_base_columns(spark, docs, odd, empty):
    for df in (docs, odd):
        want = Counter()
        for r in df.collect():
            text = r["text"] or ""
            w = words_of(text)
            seen = Counter(zip(w, w[1:], w[2:], strict=False))
            covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in text.split("\n") if words_of(x)]
            failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
            want[(r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)] += 1
        rows = quality_rules.judged(df).collect()
        assert want == Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
        assert all(not (r["kept"] and r["base_failed"]) for r in rows)
    assert quality_rules.judged(empty).count() == 0


def plain_kept(metrics, spread=16.0, prior=200.0):
    """doc_id: kept, with quartiles from sorted lists (sketches of fewer than 200 values are exact)."""
    groups = {}
    for r in metrics:
        groups.setdefault((r["lang"], r["source"]), []).append(r)
    at = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    out = {}
    for (lang, _), rows in groups.items():
        weight = len(rows) / (len(rows) + prior)
        fences = {}
        for rule in quality_rules.RULES:
            mine = [at([r[rule.metric] for r in rows], q) for q in quality_rules.QUARTILES]
            theirs = [at([r[rule.metric] for r in metrics if r["lang"] == lang], q) for q in quality_rules.QUARTILES]
            low, middle, high = (t + weight * (m - t) for m, t in zip(mine, theirs, strict=True))
            half = spread * max(rule.least, min(middle - low, high - middle))
            fences[rule.metric] = (middle - half, middle + half)
        for r in rows:
            base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
            out[r["doc_id"]] = not base and all(a <= r[m] <= b for m, (a, b) in fences.items())
    return out


def styled(k, length, symbols=0):
    """A text of 90 distinct words of about ``length`` letters, ``symbols`` of them followed by a mark."""
    draw = random.Random(k)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(max(1, round(draw.gauss(length, length / 12))))) for _ in range(90)]
    return " ".join(w + ("#$" if j < symbols else "") for j, w in enumerate(words))


def test_fences_come_from_the_sketches(spark):
    rows = [(k, styled(k, 5, 30 if k % 10 < 4 else 0), "en", "mixed") for k in range(90)]  # 40 % junk
    rows += [(100 + k, styled(100 + k, 13), "en", "long") for k in range(60)]  # a source of long words
    rows += [(200 + k, styled(200 + k, 13 if k == 7 else 5), "en", "short") for k in range(90)]
    rows += [(300, styled(300, 5), "de", None), (301, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    metrics = quality_rules.measured(docs)
    fences = {r["source"]: r for r in quality_rules.thresholds(metrics, 16.0, 2.0).where("lang = 'en'").collect()}
    assert fences["long"]["mean_word_low"] > fences["short"]["mean_word_low"] + 1 and fences["long"]["mean_word_high"] > fences["short"]["mean_word_high"] + 3
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, prior=2.0).collect()}
    assert kept == plain_kept(metrics.collect(), prior=2.0)
    assert all(kept[k] == (k % 10 >= 4) for k in range(90)) and all(kept[100 + k] for k in range(60))
    assert not kept[207] and kept[206] and kept[107]  # words of one length: usual in one source, odd in the other


def test_quality_keeps_clean_and_drops_symbols(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in quality_rules.judged(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r["doc_id"] in labels]
    assert all(r["kept"] or r["base_failed"] for r in rows if labels[r["doc_id"]] == 1)
    bad = [r for r in rows if labels[r["doc_id"]] == 0]
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)


# ---------------------------------------------------------------- 9


def png() -> bytes:
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


def test_sniffing_and_carving(spark):
    import gzip

    inner, broken = png(), bytearray(png())
    broken[20] ^= 1
    assert media.corrected("image/jpeg", inner) == ("image/png", True, [])
    assert media.corrected("image/png", bytes(broken)) == (media.UNKNOWN, True, [])
    assert media.corrected("text/plain", b"BM GIF89a RIFFxxxxWAVE %PDF-") == ("text/plain", False, [])
    rows = spark.createDataFrame([(1, bytearray(b"zz" + inner + b"yy" + gzip.compress(b"q")), "application/zip"), (2, None, None)], "k int, content binary, declared string")
    got = media.typed(rows).orderBy("k").collect()
    assert [(c["offset"], c["media_type"]) for c in got[0]["carved"]] == [(2, "image/png"), (4 + len(inner), "application/gzip")] and bytes(got[0]["carved"][0]["content"]) == inner
    assert got[1]["carved"] == [] and got[1]["media_type"] == media.UNKNOWN
    form = media.stored(b"x" * 192)
    assert media.wav(memoryview(form), 0) == len(form) and media.wav(memoryview(form[:-1]), 0) == 0 and media.samples(form) == b"x" * 192


PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"


def test_pdf_ends_and_long_values():
    import time

    two = PDF + b"zz" + PDF
    assert media.sniffed(two) == [(0, len(PDF), "application/pdf"), (len(PDF) + 2, len(PDF), "application/pdf")]
    assert media.sniffed(b"%PDF-1 %%EOF startxref") == [] and media.sniffed(b"%PDF-x startxref %%EOF") == []
    began = time.perf_counter()
    assert media.sniffed(b"%PDF-1.7 " * 400_000) == [] and len(media.sniffed(b"%PDF-1 " * 20_000 + PDF)) == 20_001
    assert time.perf_counter() - began < 20


def test_media_planted_in_documents(spark):
    """Formats whose bytes are ASCII, planted in texts, with declared types that are right, wrong or missing."""
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + bytes([0x2C, 0, 0, 0, 0, 1, 0, 1, 0, 0, 2, 2, 0x4C, 1, 0, 0x3B])
    form = media.stored(b"inner " * 10)
    assert max(gif) < 128 and media.sniffed(gif) == [(0, len(gif), "image/gif")]
    rows = [(1, "see " + PDF.decode() + " and " + gif.decode(), "text/plain"), (2, "nothing here", "audio/wav"), (3, "GIF89a BM %PDF-1.4", None), (4, None, "image/png")]
    got = {r["doc_id"]: r["feature"] for r in media.media_columns(spark.createDataFrame(rows, "doc_id long, text string, kind string"), "kind").collect()}
    at = 44 + 4
    assert got[1].endswith(f"declared=text/plain;corrected=true;embedded=application/pdf@{at}+{len(PDF)},image/gif@{at + len(PDF) + 5}+{len(gif)}")
    assert got[2].endswith("declared=audio/wav;corrected=false;embedded=") and got[3].endswith("declared=application/octet-stream;corrected=true;embedded=") and got[4].endswith("declared=image/png;corrected=true;embedded=")
    inside = b"head" + form + b"tail"
    clash = spark.createDataFrame([(1, bytearray(inside), "text/plain", "mine", 7)], "k int, content binary, declared string, media_type string, carved int")
    row = media.typed(clash).first()
    assert row["media_type"] == "text/plain" and not row["was_wrong"] and [(c["offset"], c["length"], c["media_type"]) for c in row["carved"]] == [(4, len(form), "audio/wav")]
    assert media.typed(clash).columns == ["k", "content", "declared", "media_type", "was_wrong", "carved"]


def test_media_round_trip(spark, docs, odd, empty):
    for df in (docs, odd):
        want = Counter()
        for r in df.collect():
            raw = (r["text"] or "").encode()
            padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
            want[(r["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))] += 1
        assert want == Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.media_columns(df).collect())
    assert media.media_columns(empty).count() == 0
