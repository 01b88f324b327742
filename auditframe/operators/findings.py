"""Findings of linters, checkers and scanners in one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.classify import complexity_rank, is_severe
from auditframe.operators.facts import fact
from auditframe.operators.grouping import By
from auditframe.schemas import FINDINGS

REPO = ("repo_id",)


# --- one schema -----------------------------------------------------------------------------------


def as_findings(df: DataFrame, category: str, tool: str, **columns: Column | str) -> DataFrame:
    """Map a tool's rows to the findings schema; columns that are not named become NULL."""
    given = {"category": F.lit(category), "tool": F.lit(tool)}
    for name, value in columns.items():
        given[name] = F.col(value) if isinstance(value, str) else value
    if "repo_id" in df.columns:
        given.setdefault("repo_id", F.col("repo_id"))
    return df.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDINGS.fields]
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns one side lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- per file -------------------------------------------------------------------------------------


def secret_findings(files: DataFrame, by: By = REPO) -> DataFrame:
    """One row per file and kind of secret, with the number of matches."""
    return files.select(*by, "path", F.inline(fact(files, "secrets")))


def lint_lines(files: DataFrame, by: By = REPO) -> DataFrame:
    """Long parameter lists, missing docstrings and bare excepts in Python files."""
    return files.select(*by, "path", F.inline(fact(files, "lint")))


# --- rollups --------------------------------------------------------------------------------------


def messages_by_type(messages: DataFrame, by: By = REPO) -> DataFrame:
    """Linter messages per type. The messages of a type stay rows."""
    return messages.groupBy(*by, "type").agg(F.count("*").alias("issues"))


def issues_per_tool(findings: DataFrame, by: By = REPO) -> DataFrame:
    return findings.groupBy(*by, "category", "tool").agg(F.count("*").alias("total_issues"))


def static_issue_total(findings: DataFrame, by: By = REPO) -> DataFrame:
    """Findings of linting, type checking and security tools."""
    counted = F.col("category").isin("linting", "type_checking", "security")
    return findings.groupBy(*by).agg(F.count_if(counted).alias("total_issues"))


def checks_per_language(logs: DataFrame, by: By = REPO) -> DataFrame:
    """Contract checks per language: tools used, files, entries."""
    return logs.groupBy(*by, "language").agg(
        F.array_sort(F.collect_set("tool")).alias("tools_used"),
        F.count_distinct("path").alias("files_analyzed"),
        F.count("*").alias("checks"),
    )


def junit_rollup(suites: DataFrame, by: By = REPO) -> DataFrame:
    """Suite counts added up; passed is what is left."""
    total, failed, errors, skipped = (F.sum(c) for c in ("tests", "failures", "errors", "skipped"))
    return suites.groupBy(*by).agg(
        F.count("*").alias("suites"),
        total.alias("total"),
        (total - failed - errors - skipped).alias("passed"),
        failed.alias("failed"),
        skipped.alias("skipped"),
        errors.alias("errors"),
        F.sum("time").alias("time"),
    )


def test_totals(runs: DataFrame, by: By = REPO) -> DataFrame:
    """Counts over all frameworks and the success rate, 0 without tests."""
    totals = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "passed", "failed", "skipped")}
    rate = F.coalesce(F.try_divide(totals["passed"], totals["total"]), F.lit(0.0)) * 100
    return runs.groupBy(*by).agg(
        totals["total"].alias("total_tests"),
        *[totals[c].alias(c) for c in ("passed", "failed", "skipped")],
        rate.alias("success_rate"),
        F.array_sort(F.collect_set(F.concat_ws("_", "language", "framework"))).alias("frameworks_used"),
    )


def severe_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(is_severe(F.col("severity"))).withColumn("severity", F.lower("severity"))


def detailed_findings(functions: DataFrame, findings: DataFrame, complexity_above: int = 10) -> DataFrame:
    """Complex functions and all security results in one table."""
    complexity = F.col("complexity")
    complex_ = functions.filter(complexity > complexity_above)
    issues = as_findings(
        complex_,
        "complexity",
        "complexity",
        path="path",
        line="lineno",
        kind="name",
        severity=complexity_rank(complexity),
        message=complexity.cast("string"),
    )
    return issues.unionByName(findings.filter(F.col("category") == "security").select(issues.columns))
