"""Quality rules with adaptive thresholds, by DataFrame functions only.

Two fixed rules stay (fewer than 50 words; over half of the words in repeated 3-word
windows). The other cutoffs are learnt: per language and source a mergeable quantile
sketch (KLL) of each metric gives its quartiles, and the fences lie ``spread`` half
widths on either side of the median. The half width is the narrower of the two from the
median to a quartile: junk on one side, up to half of a source, doesn't widen it. Where a
source doesn't vary at all it is ``least`` of the metric instead.

A source's quartiles are blended with those of its language's merged sketch, with weight
n / (n + ``prior``) for n texts: large sources are judged by themselves, a source of one
text by its language, and nothing switches in between. Sketches are combined map-side,
so a source that holds a third of all rows sends a few kilobytes from each task.

Windows of words are told apart by their 64-bit XXH64. Null texts have no words. Null
lang or source is a value of its own. Repeated rows are judged each. An empty table
gives no rows. Columns other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import WORD, saved

WINDOW, LEAST_WORDS, REPEATED_SHARE = 3, 50, 50
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie between its fences; ``least`` is the narrowest half width, for sources that don't vary."""

    metric: str
    least: float


RULES = (
    Rule("symbol_share", 0.004),
    Rule("dup_line_share", 0.03),
    Rule("repeat_share", 0.03),
    Rule("capital_share", 0.001),
    Rule("mean_word", 0.05),
)
QUARTILES = (0.25, 0.5, 0.75)


def covered_words(placed: str) -> Column:
    """Words that the windows found twice or more cover, first occurrence included; ``placed``: sorted (h, at) of all windows."""
    nothing = F.lit(None).cast("struct<h:bigint,at:int>")
    n = F.greatest(F.size(placed), F.lit(1))
    around = F.arrays_zip(F.col(placed).alias("own"), F.concat(F.array(nothing), F.slice(placed, 1, n - 1)).alias("before"), F.concat(F.slice(placed, 2, n), F.array(nothing)).alias("after"))
    twice = F.filter(around, lambda x: F.coalesce(x["own"]["h"] == x["before"]["h"], F.lit(False)) | F.coalesce(x["own"]["h"] == x["after"]["h"], F.lit(False)))
    at = F.array_sort(F.transform(twice, lambda x: x["own"]["at"]))
    return F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n")), lambda acc: acc["n"])


def measured(docs: DataFrame) -> DataFrame:
    """Saved narrow table: doc_id, lang, source, counts and metrics of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    base = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"),
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
    )
    # Words are hashed once; only a text with a repeated window goes through the sort.
    hashed = base.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    window = F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    windowed = hashed.withColumn("win", F.when(F.size("h") > WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    again = F.size("win") > F.size(F.array_distinct("win"))
    placed = F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    counted = windowed.withColumn("placed", F.when(again, placed)).select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered_words("placed"), F.lit(0)).cast("long").alias("n_repeat_words"), "n_capitals", F.size("lines").cast("long").alias("n_lines"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return saved(
        counted.select(
            "*", share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
            share("n_capitals", "word_chars").alias("capital_share"), share("word_chars", "n_words").alias("mean_word"),
        ),
        "metrics",
    )


def thresholds(metrics: DataFrame, spread: float, prior: float) -> DataFrame:
    """lang, source and ``<metric>_low``, ``<metric>_high`` of every language and source."""
    own = saved(metrics.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(r.metric).alias(r.metric) for r in RULES]), "sketches")
    language = own.groupBy("lang").agg(*[F.kll_merge_agg_double(r.metric).alias(f"all_{r.metric}") for r in RULES])
    weight = F.col("n") / (F.col("n") + F.lit(float(prior)))

    def blended(metric: str, q: float) -> Column:
        mine, theirs = (F.kll_sketch_get_quantile_double(c, F.lit(q)) for c in (metric, f"all_{metric}"))
        return theirs + weight * (mine - theirs)

    quartiles = own.join(language, "lang").select("lang", "source", *[blended(r.metric, q).alias(f"{r.metric}_{k}") for r in RULES for k, q in enumerate(QUARTILES)])
    columns = []
    for r in RULES:
        low, middle, high = (F.col(f"{r.metric}_{k}") for k in range(3))
        half = F.greatest(F.lit(r.least), F.least(middle - low, high - middle))
        columns += [(middle - spread * half).alias(f"{r.metric}_low"), (middle + spread * half).alias(f"{r.metric}_high")]
    return saved(quartiles.select("lang", "source", *columns), "thresholds")


def judged(docs: DataFrame, spread: float = 16.0, prior: float = 200.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and ``rejected_by``."""
    metrics = measured(docs)
    limits = thresholds(metrics, spread, prior)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when((F.col(r.metric) < F.col(f"{r.metric}_low")) | (F.col(r.metric) > F.col(f"{r.metric}_high")), F.lit(r.metric)) for r in RULES]))
    return metrics.join(limits, ["lang", "source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("rejected_by"),
    )
