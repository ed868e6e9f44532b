"""Shared inputs: awkward rows, and a folder of small given tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

#: Columns that operators use inside must not clash with those of the input.
EXTRA = ("score", "kept", "shard", "block", "token", "uid", "row", "n", "id", "key", "size", "taken", "start")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    copy = prose(120)
    texts = [
        None, "", " \t\n ", "one", "Two Words", "a b c d", "a b c d e", copy, copy, copy + " more",
        prose(30_000), "x" * 5000, "same line here\n" * 40, prose(60) + "\n" + copy, " " + prose(40), "É ÉÉ é\x0b#",
    ]
    rows = [(i, t, ("en", None, "de")[i % 3], ("b", None, "a", "é")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, copy, "en", "b", 1), (None, None, None, None, None), (40, prose(50), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in EXTRA:
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
