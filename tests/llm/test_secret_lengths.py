"""Tokens of any length, and tokens that are joined to a base span."""

import random

import pytest

from webloom.llm import secrets

LETTERS = secrets.ENCODINGS[4][1][:62]


@pytest.mark.parametrize("length", [512, 513, 600, 5000])
def test_long_keys_are_judged(spark, length):
    draw = random.Random(length)
    keys = ["".join(draw.choice(LETTERS) for _ in range(length)) for _ in range(20)]
    docs = spark.createDataFrame([(k, f"see {t}== here") for k, t in enumerate(keys)], "doc_id long, text string")
    assert all(secrets.candidates(f"see {t}== here", [])[0][:2] == (4, 6 + length) for t in keys)
    assert sum(r["text"] == "see [SECRET] here" for r in secrets.redacted(docs).collect()) >= 17


def test_secret_joined_to_an_access_id(spark):
    draw = random.Random(4)
    rows = [(k, "id AKIA" + "".join(draw.choice("ABCDEFGHIJ234567") for _ in range(16)) + "/" + "".join(draw.choice(LETTERS) for _ in range(40)) + " end") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [r["spans"] for r in secrets.scanned(docs).collect()]
    assert all(s.startswith("access:3:23") for s in spans) and sum(s == "access:3:23,random:23:64" for s in spans) >= 17


def test_parts_outside_base_spans():
    base = [("hex", 10, 20), ("access", 5, 12), ("assign", 40, 50)]
    assert secrets.parts(0, 30, base) == [(0, 5), (20, 30)]
    assert secrets.parts(6, 18, base) == [] and secrets.parts(20, 40, base) == [(20, 40)]
