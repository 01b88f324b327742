from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder() -> str:
    return SMALL


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang, source) with columns whose names clash with those of results."""

    def build(rows):
        full = [(i, text, lang, source, None if text is None else len(text)) for i, text, lang, source in rows]
        df = spark.createDataFrame(full, SCHEMA)
        clashing = ("kept", "score", "shard", "slot", "rank", "row", "size", "block", "order", "key", "number", "group", "id", "copies", "sequence_id", "offset", "__n")
        return df.select("*", *[F.lit("clash").alias(c) for c in clashing])

    return build


#: Nulls, empty and very long texts, ties and repeated rows.
EDGE = [
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "one two three four five six seven eight nine ten", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (None, "one two three four five six seven eight nine ten", None, "b"),
    (5, "word", "de", None),
    (6, "  \t\n ", "de", "c"),
    (7, "long " * 40_000, "en", "a"),
    (8, "é" * 3000 + "\U0001f600 </s>", "fr", "a"),
    (9, "ONE two three four five six seven eight nine ten", "en", "c"),
]


@pytest.fixture
def edge(documents):
    return documents(EDGE)


@pytest.fixture
def empty(documents):
    return documents([])
