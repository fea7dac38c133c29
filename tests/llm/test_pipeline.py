"""The pipeline against a plain one built from the operators' brute-force forms."""

from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.conftest import SF
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_operators import brute_windows
from webloom.llm import secrets
from webloom.llm.common import saved
from webloom.llm.queries import op3_neighbour_quality


def test_stages_follow_the_plain_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    rows = docs
    for name, stage in C.STAGES[:-1]:
        rows = saved(stage(spark, rows, SF), name)
        assert rows.columns == docs.columns
        out[name] = {r["doc_id"]: r["text"] for r in rows.collect()}
    good = {r["doc_id"] for r in op3_neighbour_quality(spark, SF).where("predicted = 1").collect()}
    assert set(out["quality_classifier"]) == good
    assert set(out["simhash_near_dedup"]) == plain_kept(list(out["quality_classifier"].items()))
    told = {d: n for d, _, n, _ in brute_windows(list(out["simhash_near_dedup"].items()), 50)}
    for d, text in out["simhash_near_dedup"].items():
        assert (out["substring_dedup"][d] == text) == (told[d] == 0)
    for d, text in out["substring_dedup"].items():
        assert not any(text[a:b] in out["secret_scans"][d] for _, a, b in secrets.base_spans(text))
    packed = C.STAGES[-1][1](spark, rows, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(out["secret_scans"])
    assert C.run(spark, SF).select(F.sum("length")).first() == packed.select(F.sum("length")).first()
