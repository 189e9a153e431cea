from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = ["_text", "_key", "row", "key", "bucket", "comp", "n", "rep", "digest", "words", "_row", "_range", "next", "sketch"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, blank, very long, repeated and tied rows."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünder", "x1"]) for _ in range(30_000))
    same = "one two three four five six seven eight nine ten"
    return [(None, "text without an id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, same), (6, same), (5, same),
            (7, "z" * 40_000), (8, "﻿\x00odd \x1f bytes   here"), (9, "a")]


@pytest.fixture(scope="session")
def edges(make_docs, edge_rows):
    """The edge rows, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    docs = make_docs(edge_rows)
    return docs.select("*", *[F.lit(name).alias(name) for name in CLASHES])


@pytest.fixture(scope="session")
def sample(spark):
    return "/root/testdata/sf0.001"
