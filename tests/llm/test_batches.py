from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditframe.llm import language, minhash, packing
from auditframe.llm.common import BATCH_BYTES, FLUSH_BYTES


@pytest.fixture
def unset(spark):
    """The session without a limit of its own, during the test."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.unset(BATCH_BYTES)
    yield spark
    spark.conf.unset(BATCH_BYTES)
    if before is not None:
        spark.conf.set(BATCH_BYTES, before)


@pytest.fixture
def long_texts(spark):
    """32 MB of texts in one partition."""
    return spark.range(0, 320, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 100_000).alias("text"), F.lit("en").alias("lang"))


def handed(texts):
    """Bytes and rows of the largest batch that Python gets, and all rows."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [sum(len(x.as_py()) for x in batch.column(0))], "rows": [batch.num_rows]})

    largest = F.max("bytes").alias("bytes"), F.max("rows").alias("rows"), F.sum("rows").alias("all")
    return texts.select("text").mapInArrow(run, "bytes long, rows long").agg(*largest).first()


@pytest.mark.parametrize(
    "step",
    [
        packing.token_pieces,
        lambda docs: minhash.features(docs.select("doc_id", F.lit(0).cast("long"), "text"), 5),
        lambda docs: language.identify(docs, language.train([], [])),
    ],
)
def test_texts_reach_python_in_small_batches(unset, long_texts, step):
    assert handed(long_texts)["bytes"] > 4 * FLUSH_BYTES
    step(long_texts)
    found = handed(long_texts)
    assert found["bytes"] < 2 * FLUSH_BYTES and found["all"] == 320

    @F.pandas_udf("long")
    def total(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts), dtype="int64")

    assert long_texts.select(total("text").alias("n")).agg(F.max("n")).first()[0] < 2 * FLUSH_BYTES


def test_short_rows_are_handed_over_as_before(unset, spark, long_texts):
    packing.token_pieces(long_texts)
    assert handed(spark.range(0, 20_000, 1, 1).select(F.lit("a").alias("text")))["rows"] == 10_000


def test_a_limit_of_the_session_stays(unset, long_texts):
    unset.conf.set(BATCH_BYTES, "1m")
    packing.token_pieces(long_texts)
    assert unset.conf.get(BATCH_BYTES) == "1m"


def test_pieces_do_not_depend_on_the_batches(unset, documents, edge):
    slim = ["doc_id", "piece", "start", "length", F.crc32("ids")]
    unset.conf.set(BATCH_BYTES, "64m")
    before = sorted(map(str, packing.token_pieces(edge).select(*slim).collect()))
    unset.conf.set(BATCH_BYTES, "100")
    assert sorted(map(str, packing.token_pieces(edge).select(*slim).collect())) == before
