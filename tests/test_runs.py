"""Runs are readable as a whole or not at all; staged tables end with the run; totals come from one scan."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditframe.operators import history, metrics
from auditframe.operators.grouping import with_totals
from auditframe.plans import runs
from auditframe.plans.audit import AuditTables
from auditframe.schemas import COMMIT_FILES, COMMITS, FUNCTION_METRICS, TAGS, TEST_RUNS
from auditframe.session import checkpoint_folder, owned_stages, stage


def staged(spark, name):
    return [p for p in Path(checkpoint_folder(spark).removeprefix("file:")).glob(f"{name}-*")]


def test_a_run_is_read_back_and_leaves_no_staged_table(spark, tmp_path):
    def build():
        numbers = stage(spark.range(5).withColumn("none", F.lit(None).cast("string")), "run-numbers")
        assert staged(spark, "run-numbers")
        return {"numbers": numbers, "sums": numbers.agg(F.sum("id").alias("total")), "empty": numbers.filter("id > 9")}

    run = runs.write_run(spark, str(tmp_path), build)
    assert not staged(spark, "run-numbers")
    read = runs.read_run(spark, str(tmp_path))
    assert list(read) == ["numbers", "sums", "empty"]
    assert sorted(r["id"] for r in read["numbers"].collect()) == list(range(5))
    assert read["numbers"].columns == ["id", "none"]
    assert read["sums"].first()["total"] == 10 and read["empty"].count() == 0
    assert runs.committed_runs(spark, str(tmp_path)) == [run]


def test_a_failed_run_leaves_the_one_before_in_force(spark, tmp_path):
    with pytest.raises(ValueError):
        runs.read_run(spark, str(tmp_path))
    first = runs.write_run(spark, str(tmp_path), lambda: {"t": spark.range(3)})
    broken = spark.range(3).select(F.raise_error(F.lit("killed")).alias("x"))

    def build():
        return {"t": stage(spark.range(7), "run-broken"), "u": broken}

    with pytest.raises(Exception, match="killed"):
        runs.write_run(spark, str(tmp_path), build)
    assert not staged(spark, "run-broken")
    assert runs.committed_runs(spark, str(tmp_path)) == [first]
    assert runs.read_run(spark, str(tmp_path))["t"].count() == 3
    assert len(list((tmp_path / "runs").iterdir())) == 2
    assert runs.remove_unfinished(spark, str(tmp_path), 0) == []
    assert len(runs.remove_unfinished(spark, str(tmp_path), time.time() + 60)) == 1
    assert [p.name for p in (tmp_path / "runs").iterdir()] == [first]
    newest = runs.write_run(spark, str(tmp_path), lambda: {"t": spark.range(4)})
    assert runs.committed_runs(spark, str(tmp_path)) == [first, newest]
    assert runs.read_run(spark, str(tmp_path))["t"].count() == 4
    assert runs.read_run(spark, str(tmp_path), first)["t"].count() == 3


def test_partitioned_tables_keep_their_columns(spark, tmp_path):
    table = spark.createDataFrame([("01", 1), ("b", 2)], "repo_id string, n int")
    runs.write_run(spark, str(tmp_path), lambda: {"t": table}, ("repo_id",))
    read = runs.read_run(spark, str(tmp_path))["t"]
    assert sorted((r["repo_id"], r["n"]) for r in read.collect()) == [("01", 1), ("b", 2)]


def test_stages_outside_a_block_stay(spark):
    kept = stage(spark.range(2), "run-kept")
    with owned_stages():
        stage(spark.range(2), "run-owned")
    assert kept.count() == 2 and not staged(spark, "run-owned")


def scans_run(df):
    """Scans of the executed plan that really read, not those of a reused exchange."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan"), plan.count("ReusedExchange")


def test_totals_come_from_one_scan(spark, tmp_path):
    rows = [(f"r{i % 3}", f"a{i % 7}", i % 5, i % 2 == 0) for i in range(300)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "repo_id string, author string, n int, old boolean").write.parquet(path)
    table = spark.read.parquet(path)
    assert scans_run(metrics.share_of_total(table, "author")) == (1, 1)
    counts = table.groupBy("repo_id", "author").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    totals = with_totals(counts, {"ns": "n", "ms": "m"}, ("repo_id",))
    assert scans_run(totals) == (1, 1)
    for r in totals.collect():
        mine = [x for x in rows if x[0] == r["repo_id"]]
        assert (r["ns"], r["ms"]) == (sum(x[2] for x in mine), len(mine))


def test_bus_factor_reads_commits_once(spark, tmp_path):
    path = str(tmp_path / "c")
    moments = spark.range(400).select(
        F.concat(F.lit("r"), F.col("id") % 4).alias("repo_id"), F.concat(F.lit("a"), F.col("id") % 9).alias("author"),
        F.timestamp_seconds(1_700_000_000 - F.col("id") * 86_400).alias("ts"), F.lit("work").alias("subject"),
        F.lit(1).alias("parents"),
    )
    moments.write.parquet(path)
    authors = history.contributors(spark.read.parquet(path), "2023-11-20")
    assert scans_run(history.bus_factor(authors))[0] == 1


def test_an_audit_as_a_run(spark, project, tmp_path):
    empty = [spark.createDataFrame([], schema) for schema in (COMMITS, COMMIT_FILES, TAGS)]
    functions = spark.createDataFrame([("r", "main.py", "many", 10, 35)], FUNCTION_METRICS)
    tests = spark.createDataFrame([("r", "python", "pytest", 1, "4 passed, 1 failed", "", None)], TEST_RUNS)
    before = set(Path(checkpoint_folder(spark).removeprefix("file:")).iterdir())
    runs.audit_run(AuditTables(project, *empty, functions, tests), str(tmp_path), "2024-06-30")
    assert set(Path(checkpoint_folder(spark).removeprefix("file:")).iterdir()) == before
    read = runs.read_run(spark, str(tmp_path))
    row = read["summary"].first()
    assert (row["failed"], row["gate_status"], row["has_history"]) == (1, 1, False)
    assert {r["type"] for r in read["issues"].collect()} >= {"high_complexity", "test_failures"}
    assert read["document"].count() == 1
