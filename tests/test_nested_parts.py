"""Texts that a view makes of short rows are judged by these: neither the driver nor a shuffle may get them."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.catalog import load, redaction
from auditframe.functions import redact
from auditframe.session import task_count


def parts(spark, folder, keys):
    """``part`` with one row per key, of few bytes each."""
    rows = [(k, f"small box{i}", f"Brand#{i}", f"SMALL {i}", i % 50, 1.0) for i, k in enumerate(keys)]
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return spark.read.parquet(f"{folder}/part.parquet")


def test_texts_of_nested_records_stay_where_they_are_made(spark, tmp_path):
    parts(spark, tmp_path, range(100))
    found = load()[0]["r8_nested"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    # Each side is dealt out once, before its rows are texts, and the tasks are not merged by their few bytes.
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in line for line in dealt)
    assert found.rdd.getNumPartitions() == task_count(spark)


def test_equal_and_missing_keys(spark, tmp_path):
    part = parts(spark, tmp_path, [1, 1, 2, None])
    found = load()[0]["r8_nested"](spark, str(tmp_path))
    text = redact.redact_text(F.col("text"), "high")
    texts = spark.sql(redaction.PLANTED, part=part).select("p_partkey", text.alias("text"))
    plain = part.select("p_partkey", F.col("p_size").alias("number")).join(texts, "p_partkey").select(
        "p_partkey", "number", *[F.col("text").alias(c) for c in ("inner_text", "listed", "map_value")],
        F.lit("k [EMAIL_REDACTED]").alias("map_key"),
    )
    assert found.count() == plain.count() == 5
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
