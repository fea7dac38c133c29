"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.substring_dedup import digested

    return digested(table(spark, sf_dir, "documents"), length=50, extend=True)


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents"), shards=24)


def op3_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.classifier import classified

    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048)


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.simhash import clustered

    found = clustered(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.secrets import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op7_agenda_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.pieces import encoded

    return encoded(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.quality_rules import judged

    return judged(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op10_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.llm.pieces import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


WORD = r"[^\x20\x09-\x0D]+"
#: Window by window, for the removed length and, for ``longest``, for each level among texts of different words.
OP1 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM d, range(1, len(w) - 48) r(i)),
bad AS (SELECT doc_id, i FROM win JOIN (SELECT t, min(doc_id) AS m FROM win GROUP BY t) f USING (t) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM bad, range(0, 50) r(k)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, range(1, len(w) + 1) r(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
own AS (SELECT min(doc_id) AS owner, w FROM d GROUP BY w),
lvl AS (SELECT n, owner, hash(w[i:i + n - 1]) AS h FROM own, (SELECT CAST(50 * power(2, k) AS BIGINT) AS n FROM range(0, 12) r(k)) l, range(1, len(w) - n + 2) r(i)),
far AS (SELECT owner, max(n) AS longest FROM lvl JOIN (SELECT n, h FROM lvl GROUP BY n, h HAVING count(DISTINCT owner) > 1) f USING (n, h) GROUP BY owner)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256, coalesce(far.longest, 0) AS longest
FROM d JOIN own ON d.w = own.w LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN far ON far.owner = own.owner"""

_LE = "unhex(" + " || ".join(f"printf('%02x', ({{0}} >> {8 * k}) & 255)" for k in range(4)) + ")"
_BYTE = "CAST(('0x' || substr(hx, CAST(2 * k + 1 AS BIGINT), 2)) AS BIGINT)"
#: The RIFF form spelled out; CRC-32 by its bits; no text of these tables holds a valid embedded file.
OP9 = f"""WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, greatest(192, ((n + 191) // 192) * 192) AS m, raw || encode(repeat(' ', CAST(greatest(192, ((n + 191) // 192) * 192) - n AS INTEGER))) AS payload FROM t),
f AS (SELECT *, hex(payload) AS hx, encode('RIFF') || {_LE.format("(m + 36)")} || encode('WAVEfmt ') || unhex('1000000001000100401F0000401F000001000800') || encode('data') || {_LE.format("m")} || payload AS form FROM p),
c AS (SELECT *, list_reduce(list_concat([4294967295], list_transform(range(m - 16, m), lambda k: {_BYTE})), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc,
list_sum(list_transform(range(m), lambda k: {_BYTE})) // m AS mean FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256, CAST(xor(crc, 4294967295) AS BIGINT) AS tail_crc32, CAST(m + 44 AS BIGINT) AS media_bytes, sha256(form) AS media_sha256,
'audio/wav;pcm_u8;samples=' || CAST(m AS VARCHAR) || ';mean=' || CAST(mean AS VARCHAR) || ';declared=application/octet-stream;corrected=true;embedded=' AS feature FROM c"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express over whole tables; tests hold the others against brute force."""
    return {"op1_substring_dedup": OP1, "op9_media_columns": OP9}
