"""All pairs of a popular name: dealt out by their number, and small where they are written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditframe.operators import correlate, grouping


def sides(spark, claims: int, files: int):
    """API claims that all say ``run``, some of them twice, and files that all define it; other names beside it."""
    text = F.when(F.col("id") % 3 == 0, F.lit("run and run")).otherwise(F.concat(F.lit("run of n"), F.col("id") % 7))
    said = spark.range(claims).select(
        F.lit("r").alias("repo_id"), F.concat("id", F.lit(":api:0:0")).alias("claim_id"), F.lit("api").alias("claim_type"),
        text.alias("text"),
    )
    path = F.concat(F.lit("src/m"), "id", F.lit(".py")).alias("path")
    run = spark.range(files).select(F.lit("r").alias("repo_id"), path, F.lit("run").alias("symbol"))
    others = spark.range(files).select(F.lit("r").alias("repo_id"), path, F.concat(F.lit("n"), F.col("id") % 9).alias("symbol"))
    return said, run.unionByName(others)


def test_pairs_of_one_name_take_few_bytes(spark, tmp_path):
    claims, files = 100, 20_000
    said, defined = sides(spark, claims, files)
    correlate.api_related_files(said, defined.filter("symbol = 'run'")).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == claims * files
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * claims * files


@pytest.mark.parametrize("cell, task", [(50, 300), (1 << 22, 1 << 25)])
def test_every_pair_once(spark, monkeypatch, cell, task):
    monkeypatch.setattr(grouping, "CELL_PAIRS", cell)
    monkeypatch.setattr(grouping, "TASK_PAIRS", task)
    said, defined = sides(spark, 60, 150)
    found = correlate.api_related_files(said, defined)
    plain = correlate._api_words(said, correlate.REPO).join(defined, ["repo_id", "symbol"]).select(*found.columns)
    assert found.columns == ["repo_id", "symbol", "claim_id", "times", "path"]
    assert found.count() == plain.count() > 60 * 150
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    assert found.rdd.getNumPartitions() >= (30 if cell == 50 else 8)
    # One name's pairs are no longer one task's.
    used = found.filter("symbol = 'run'").select(F.spark_partition_id()).distinct().count()
    assert used > 8 if cell == 50 else used == 1


def test_nothing_in_common(spark):
    said, defined = sides(spark, 5, 5)
    assert correlate.api_related_files(said, defined.filter("symbol = 'none'")).isEmpty()


def test_without_repositories(spark):
    said, defined = sides(spark, 10, 20)
    found = correlate.api_related_files(said.drop("repo_id"), defined.drop("repo_id"), by=())
    assert found.filter("symbol = 'run'").count() == 200
