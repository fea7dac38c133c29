"""Secret scanning: fixed patterns, and a randomness test battery over other tokens.

Base kinds (always reported, leftmost and not overlapping within a kind):

* ``assign``: a credential name, ``:`` or ``=`` and a value of at least 6 characters;
* ``access``: ``AKIA`` and capitals or digits, at least 20 characters;
* ``hex``: at least 24 lower-case hexadecimal digits.

The span of a kind is its whole match, in code points, end exclusive.

``random`` spans are added by the battery. Tokens have any length; of one that meets base
spans, the parts outside them are judged. A token's encoding is inferred from its
characters (hex, base32, base36, base62, base64 and its URL form; a token that none covers
is cut at ``-`` and ``_``). Three tests of a uniformly random string of that encoding are
taken: chi-squared uniformity of the alphabet, runs above and below its middle, and lag-1
serial correlation; Fisher's method joins them to one score, low for random strings.

The score is read against two tables for each encoding and length, both simulated, so
that short tokens aren't judged by asymptotic tails:

* random strings: a token above their 1 - ``alpha`` quantile isn't random;
* ordinary strings, the hypothesis that a discovery rejects: letters as frequent as in
  all texts of the corpus outside such tokens, in each string an own share of digits
  (up to 0.4) and of capitals (up to 0.25).

Benjamini-Hochberg at level ``q`` is applied to the second p-values, over the whole corpus,
within strata of encoding and length: of the tokens reported, at most a share ``q`` is
expected to be ordinary ones. A token shorter than the least length of its encoding, or
without a letter or a digit, has too little to test and is left to the base kinds.

Scores are kept as bins, so the corpus-wide step sums at most strata x bins rows, and the
text is read once.

Null texts are empty. Repeated rows are scanned each. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import saved, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: (name, characters, least length). The first whose characters cover the token is inferred.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", 24),
    ("HEX", _DIGITS + "ABCDEF", 24),
    ("base32", _UPPER + "234567", 24),
    ("base36", _DIGITS + _LOWER, 24),
    ("base62", _UPPER + _LOWER + _DIGITS, 20),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", 20),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", 20),
)
_COVERED = tuple(frozenset(letters) for _, letters, _ in ENCODINGS)
_PLACE = tuple({c: k for k, c in enumerate(letters)} for _, letters, _ in ENCODINGS)
#: Lengths for which tables are simulated: a token is read against the longest that isn't longer than it.
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128, 256, 512)
#: Bins of the score: width and number.
WIDTH, BINS = 0.25, 400
DRAWS, SEED = 4000, 42
#: Ordinary strings have digits and capitals up to these shares, marks at this one, and so much of their letters is even.
DIGIT_SHARE, UPPER_SHARE, MARK_SHARE, EVEN = 0.4, 0.25, 0.04, 0.1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def inferred(token: str) -> int | None:
    """Index of the encoding; None for tokens without both letters and digits, too short ones and those that none covers."""
    own = frozenset(token)
    if not any(c in _DIGITS for c in own) or own.isdisjoint(_UPPER + _LOWER):
        return None
    kind = next((k for k, covered in enumerate(_COVERED) if own <= covered), None)
    return kind if kind is not None and len(token) >= ENCODINGS[kind][2] else None


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _upper(z: np.ndarray) -> np.ndarray:
    return np.maximum(0.5 * _erfc(np.minimum(z, 40.0) / math.sqrt(2)).astype(float), 1e-300)


def battery(at: np.ndarray, size: int) -> np.ndarray:
    """p-values of uniformity (upper tail), runs and serial correlation (two-sided) of each row of letter numbers."""
    m, n = at.shape
    counts = np.bincount((at + np.arange(m)[:, None] * size).ravel(), minlength=m * size).reshape(m, size)
    chi, free = size / n * (counts.astype(float) ** 2).sum(axis=1) - n, size - 1
    uniform = _upper(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    high = at >= size / 2
    ups = high.sum(axis=1).astype(float)
    most = 2 * ups * (n - ups)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    spread = np.maximum(most * (most - n) / (n * n * (n - 1)), 0)
    run_p = 2 * _upper(np.where(spread > 0, np.abs(runs - most / n - 1) / np.sqrt(np.where(spread > 0, spread, 1)), math.sqrt(n)))
    centred = at - at.mean(axis=1, keepdims=True)
    power = (centred**2).sum(axis=1)
    lagged = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.where(power > 0, power, 1)
    serial = 2 * _upper(np.where(power > 0, np.abs(lagged * n + 1) / math.sqrt(n), math.sqrt(n)))
    return np.minimum(np.stack([uniform, run_p, serial], axis=1), 1.0)


def scores(at: np.ndarray, size: int) -> np.ndarray:
    """Fisher's joint score of each row, as -ln of the product of its p-values."""
    return -np.log(battery(at, size)).sum(axis=1)


def binned(score: np.ndarray) -> np.ndarray:
    return np.minimum(score / WIDTH, BINS - 1).astype(int)


def stratum_of(kind: int, length: int) -> int:
    return kind * len(LENGTHS) + sum(length >= n for n in LENGTHS) - 1


def ordinary_strings(alphabet: str, n: int, letters: dict[str, int], draw: np.random.Generator) -> np.ndarray:
    """Letter numbers of DRAWS ordinary strings: in each a share of digits and one of capitals, few marks, letters
    as frequent as in the corpus with a part drawn evenly."""
    groups = {g: np.array([c in of for c in alphabet]) for g, of in (("digit", _DIGITS), ("upper", _UPPER), ("lower", _LOWER), ("mark", "+/-_"))}
    often = np.array([letters.get(c.lower(), 0) + letters.get(c.upper(), 0) * (c.lower() != c.upper()) for c in alphabet], dtype=float)
    picked = {}
    for g, own in groups.items():
        if own.any():
            even = own / own.sum()
            seen = often * own if g in ("upper", "lower") else np.zeros(len(alphabet))
            picked[g] = draw.choice(len(alphabet), (DRAWS, n), p=(1 - EVEN) * seen / seen.sum() + EVEN * even if seen.sum() else even)
    share = {"digit": draw.uniform(0, DIGIT_SHARE, (DRAWS, 1)), "upper": draw.uniform(0, UPPER_SHARE, (DRAWS, 1)), "mark": np.full((DRAWS, 1), MARK_SHARE)}
    out = picked.get("lower", picked.get("upper"))
    for g in ("upper", "mark", "digit"):
        if g in picked:
            out = np.where(draw.random((DRAWS, n)) < share[g], picked[g], out)
    return out


def tables(stratum: int, letters: dict[str, int], alpha: float) -> tuple[int, list[float]]:
    """(greatest bin of a random string, p-value of each bin for an ordinary string) of an encoding and length."""
    kind, n = ENCODINGS[stratum // len(LENGTHS)], LENGTHS[stratum % len(LENGTHS)]
    draw, size = np.random.default_rng([SEED, stratum]), len(kind[1])
    random = np.sort(scores(draw.integers(0, size, (DRAWS, n)), size))
    ordinary = np.sort(scores(ordinary_strings(kind[1], n, letters, draw), size))
    ends = (np.arange(BINS) + 1) * WIDTH
    ps = (np.searchsorted(ordinary, ends, side="right") + 1) / (DRAWS + 1)
    # Beyond the draws the tail goes on as that of a log-normal score, from the twentieth smallest one.
    logs = np.log(np.maximum(ordinary, 1e-9))
    anchor, centre, spread = ordinary[19], logs.mean(), max(logs.std(), 1e-9)
    tail = lambda x: _upper((centre - np.log(np.maximum(x, 1e-9))) / spread)
    low = ends < anchor
    ps[low] = 20 / DRAWS * tail(ends[low]) / tail(np.array([anchor]))
    ps[-1] = 1.0
    return int(binned(random[[math.ceil((1 - alpha) * DRAWS) - 1]])[0]), np.maximum.accumulate(ps).tolist()


def parts(start: int, end: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What is left of a token outside the base spans."""
    left, at = [], start
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if a >= end:
            break
        if b > at:
            if a > at:
                left.append((at, a))
            at = b
    return left + [(at, end)] if at < end else left


PIECE = re.compile(r"[A-Za-z0-9+/]+")


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of the tokens, or their parts outside base spans, that the battery judges."""
    found = []
    for m in TOKEN.finditer(text):
        if not any(c.isdigit() for c in m[0]):
            continue
        for start, end in parts(m.start(), m.end(), base):
            token = text[start:end].rstrip("=")
            if start > m.start():  # what joins the part to a base span says nothing of its encoding
                token = token.lstrip("+/_-")
            if end < m.end():
                token = token.rstrip("+/_-")
            whole = any(frozenset(token) <= c for c in _COVERED)
            for a, b, piece in [(start, end, token)] if whole else [(start + x.start(), start + x.end(), x[0]) for x in PIECE.finditer(text[start:end])]:
                kind = inferred(piece)
                if kind is not None:
                    at = np.array([[_PLACE[kind][c] for c in piece]])
                    found.append((a, b, stratum_of(kind, len(piece)), int(binned(scores(at, len(ENCODINGS[kind][1])))[0])))
    return found


_CANDIDATE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32())]))
_SCAN = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string()), ("tokens", _CANDIDATE), ("letters", pa.list_(pa.int64()))])
SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, base string, tokens array<struct<start:int,end:int,stratum:int,bin:int>>, letters array<long>"


def counted(text: str) -> np.ndarray:
    """How often each ASCII character occurs."""
    return np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)[:128]


def scan_rows(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in _SCAN.names[1:]}
    seen = np.zeros(128, np.int64)
    for text in texts:
        text = text or ""
        base = base_spans(text)
        line = told(base)
        for k in KINDS[:3]:
            out[f"n_{k}"].append(sum(s[0] == k for s in base))
        out["base_sha256"].append(hashlib.sha256(line.encode()).hexdigest())
        out["base"].append(line)
        tokens = candidates(text, base)
        out["tokens"].append([dict(zip(("start", "end", "stratum", "bin"), c, strict=True)) for c in tokens])
        seen += counted(text)
        for start, end, _, _ in tokens:
            seen -= counted(text[start:end])
    # How often each ASCII character occurs in the slice outside the tokens, told by its first row.
    out["letters"] = [seen.tolist() if k == 0 else None for k in range(len(texts))]
    return out


def cutoffs(scanned: DataFrame, q: float, alpha: float) -> dict[int, int]:
    """By stratum, the greatest bin that is reported (absent: none)."""
    counts: dict[int, dict[int, int]] = {}
    for r in scanned.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    letters = {chr(r["c"]): r["n"] for r in scanned.select(F.posexplode("letters").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()} if counts else {}
    found = {}
    for stratum, bins in counts.items():
        most, ps = tables(stratum, letters, alpha)
        last = discovered(bins, ps, q)
        if last is not None:
            found[stratum] = min(last, most)
    return found


def discovered(bins: dict[int, int], ps: list[float], q: float) -> int | None:
    """Benjamini-Hochberg over binned p-values: the greatest bin whose tokens are rejected as ordinary."""
    total, upto, last = sum(bins.values()), 0, None
    for b in sorted(bins):
        upto += bins[b]
        if ps[b] <= q * upto / total:
            last = b
    return last


def scanned(docs: DataFrame, q: float = 0.05, keep: tuple[str, ...] = (), alpha: float = 0.001) -> DataFrame:
    """doc_id, base counts and digest, ``spans`` (all spans joined), and the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = scan_rows(batch.column(1).to_pylist())
            arrays = [batch.column(0), *[pa.array(rows[f.name], f.type) for f in list(_SCAN)[1:]]]
            names = list(_SCAN.names)
            for k in range(2, batch.num_columns):
                arrays.append(batch.column(k))
                names.append(f"kept_{k}")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text"), *[F.col(c) for c in keep])
    types = "".join(f", kept_{k + 2} {own.schema[k + 2].dataType.simpleString()}" for k in range(len(keep)))
    found = saved(own.mapInArrow(run, f"doc_id long, {SCAN}{types}"), "secrets")
    limits = cutoffs(found, q, alpha)
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<int,int>")
    kept = F.filter("tokens", lambda t: t["bin"] <= F.coalesce(F.element_at(limit, t["stratum"]), F.lit(-1)))
    ordered = F.array_sort(
        F.concat(
            F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), _rank(F.split(s, ":")[0]).alias("k"), F.split(s, ":")[2].cast("int").alias("b"), s.alias("s"))),
            F.transform(kept, lambda t: F.struct(t["start"].alias("a"), F.lit(3).alias("k"), t["end"].alias("b"), F.concat(F.lit("random:"), t["start"], F.lit(":"), t["end"]).alias("s"))),
        )
    )
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(F.transform(ordered, lambda x: x["s"]), ",").alias("spans"), *[F.col(f"kept_{k + 2}").alias(c) for k, c in enumerate(keep)])


def _rank(kind):
    return F.when(kind == "assign", 0).when(kind == "access", 1).otherwise(2)


def redacted(docs: DataFrame, mask: str = "[SECRET]", q: float = 0.05) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask``; other columns as they were."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    text, doc = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    found = scanned(plain.withColumns({"doc_id": F.col(doc).cast("long"), "text": F.col(text)}), q, tuple(plain.columns))
    # Spans as (start, end), merged where they overlap; the text between them and the masks is joined again.
    edges = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b")))
    done = F.aggregate(
        edges,
        F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda acc, e: F.when(e["b"] <= acc["at"], acc).otherwise(
            F.struct(
                F.concat(acc["t"], F.when(e["a"] >= acc["at"], F.concat(F.substring(F.col(text), acc["at"] + 1, e["a"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))).alias("t"),
                e["b"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["t"], F.substring(F.col(text), acc["at"] + 1, F.lit(2**31 - 1) - acc["at"])),
    )
    out = found.withColumn(text, F.when(F.col("spans") == "", F.col(text)).otherwise(done))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
