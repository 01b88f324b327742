"""Schemas of the audit tables.

``repo_id`` groups repositories. It may be left out of all tables, but where it is, it is never NULL: the
empty text stands for an unnamed repository, and ``named`` puts it there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


def ddl(text: str) -> T.StructType:
    """Flat schemas; Spark's own parser would need a running session at import."""
    pairs = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FILES = ddl("repo_id string, path string, text string")
FUNCTION_METRICS = ddl("repo_id string, path string, name string, lineno int, complexity int")
FILE_METRICS = ddl(
    "repo_id string, path string, language string, loc int, sloc int, comments int, blank int, "
    "functions bigint, total_complexity bigint, average_complexity double"
)
COMMITS = ddl("repo_id string, hash string, ts timestamp, author string, email string, subject string")
COMMIT_FILES = ddl("repo_id string, hash string, ts timestamp, author string, path string, change string")
TAGS = ddl("repo_id string, tag string, ts timestamp, message string")
CLAIMS = ddl(
    "repo_id string, path string, unit_no int, line_number int, claim_type string, pattern_no int, "
    "match_no int, text string, confidence double, context string"
)
FINDINGS = ddl(
    "repo_id string, category string, tool string, path string, line int, col int, kind string, "
    "severity string, confidence string, message string, test_id string"
)
TOOL_LOGS = ddl(
    "repo_id string, language string, tool string, path string, exit_code int, stdout string, stderr string"
)
TEST_RUNS = ddl(
    "repo_id string, language string, framework string, exit_code int, stdout string, stderr string, report string"
)
ISSUES = ddl(
    "repo_id string, type string, severity string, location string, description string, recommendation string"
)
RECOMMENDATIONS = ddl("repo_id string, category string, priority string, recommendation string, action string")
INSIGHTS = ddl("repo_id string, type string, category string, message string")


def named(df: DataFrame) -> DataFrame:
    """Rows without a repository, put into the unnamed one."""
    if "repo_id" not in df.columns:
        return df
    return df.withColumn("repo_id", F.coalesce("repo_id", F.lit("")))
