"""S: sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditframe.catalog.registry import query, sql_lines, sql_strip
from auditframe.functions.fixed_values import EXCLUDED_PARTS, SOURCE_SUFFIXES
from auditframe.operators.findings import union_all
from auditframe.sources import files, logs, reports
from auditframe.session import checkpoint_folder
from auditframe.sources.bindings import Bindings
from auditframe.streaming import arriving_logs, continuous


#: Lines of a part of an arriving log.
LINES_OF_PART = 50_000


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    "s1_file_scan",
    " UNION ALL ".join(
        f"SELECT '{caller}' AS caller, repo_id, path, CAST(length(text) AS INT) AS n_chars FROM files "
        f"WHERE regexp_extract(path, '[^/](\\.[^./]+)$', 1) IN ({', '.join(repr(s) for s in suffixes)}) "
        f"AND NOT list_has_any(string_split(path, '/'), {_list(EXCLUDED_PARTS[caller])})"
        for caller, suffixes in SOURCE_SUFFIXES.items()
    ),
    ("files",),
)
def file_scan(b: Bindings):
    return union_all(
        [
            files.source_files(b.files, caller).select(
                F.lit(caller).alias("caller"), "repo_id", "path", F.length("text").alias("n_chars")
            )
            for caller in SOURCE_SUFFIXES
        ]
    )


@query(
    "s2_documentation_files",
    r"""
    SELECT repo_id, path FROM (SELECT repo_id, path FROM project_files UNION ALL SELECT repo_id, path FROM files)
    WHERE (regexp_matches(path, '^(README|readme|DOCUMENTATION|documentation|GUIDE|guide|MANUAL|manual|API|api)[^/]*$')
           OR regexp_matches(path, '^[^/]*\.(md|rst|txt)$') OR regexp_matches(path, '(^|/)(docs|doc|wiki)/[^/]+$'))
      AND regexp_extract(path, '[^/](\.[^./]+)$', 1) NOT IN ('.pyc', '.class', '.o', '.so', '.dll', '.exe')""",
    ("files", "project_files"),
)
def documentation_files(b: Bindings):
    both = union_all([b.project_files.drop("text"), b.files.drop("text")])
    return files.documentation_files(both).select("repo_id", "path")


@query(
    "s3_commit_log",
    r"""
    SELECT event_id, m.hash AS hash, CAST(m.epoch AS BIGINT) AS epoch, m.author AS author, m.email AS email,
           m.subject AS subject
    FROM (SELECT event_id, regexp_extract(line, '^([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$',
                                          ['hash', 'epoch', 'author', 'email', 'subject']) AS m
          FROM commit_log_lines
          WHERE regexp_matches(line, '^([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$'))""",
    ("commit_log_lines",),
)
def commit_log(b: Bindings):
    commits = logs.commit_log(b.commit_log_lines)
    return commits.select("event_id", "hash", F.unix_seconds("ts").alias("epoch"), "author", "email", "subject")


@query(
    "s3_commit_log_files",
    r"""
    SELECT m.hash AS hash, CAST(m.epoch AS BIGINT) AS epoch, m.author AS author, m.email AS email, m.subject AS subject
    FROM (SELECT regexp_extract(line, '^([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$',
                                ['hash', 'epoch', 'author', 'email', 'subject']) AS m
          FROM commit_log_lines
          WHERE regexp_matches(line, '^([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$'))""",
    ("commit_log_lines",),
)
def commit_log_files(b: Bindings):
    """The same log written as text files and read again by blocks."""
    folder = f"{checkpoint_folder(b.spark).rstrip('/')}/commit-log-{uuid.uuid4().hex}"
    b.commit_log_lines.select("line").write.text(folder)
    commits = logs.commit_log(logs.read_lines(b.spark, folder))
    return commits.select("hash", F.unix_seconds("ts").alias("epoch"), "author", "email", "subject")


@query(
    "s4_commit_file_log",
    """
    SELECT log_id, line_no, epoch, line AS path
    FROM (SELECT *, last_value(CASE WHEN contains(line, '|') THEN CAST(split_part(line, '|', 1) AS BIGINT) END IGNORE NULLS)
                    OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
          FROM file_log_lines WHERE line <> '')
    WHERE NOT contains(line, '|') AND epoch IS NOT NULL""",
    ("file_log_lines",),
)
def commit_file_log(b: Bindings):
    touched = logs.commit_file_log(b.file_log_lines)
    return touched.select("log_id", "line_no", F.unix_seconds("ts").alias("epoch"), "path")


@query(
    "s4_arriving_log_parts",
    """
    SELECT log_id, epoch, line AS path
    FROM (SELECT *, last_value(CASE WHEN contains(line, '|') THEN CAST(split_part(line, '|', 1) AS BIGINT) END IGNORE NULLS)
                    OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
          FROM file_log_lines WHERE line <> '')
    WHERE NOT contains(line, '|') AND epoch IS NOT NULL""",
    ("file_log_lines",),
)
def arriving_log_parts(b: Bindings):
    """The same logs written in parts, cut anywhere, and read as a stream that carries headers from part to part."""
    name = f"log-parts-{uuid.uuid4().hex}"
    folder = f"{checkpoint_folder(b.spark).rstrip('/')}/{name}"
    # A range of lines per task: its files of the logs have names in the order of the ranges.
    cut = b.file_log_lines.repartitionByRange("line_no").sortWithinPartitions("log_id", "line_no")
    # Files end after so many lines that each fits a cell, however long its log is within the range.
    parts = cut.select("log_id", "line").write.partitionBy("log_id").option("maxRecordsPerFile", LINES_OF_PART)
    parts.text(f"{folder}/in")
    parts = arriving_logs.read_parts(b.spark, f"{folder}/in", parts_per_batch=None)
    touched = arriving_logs.commit_files_of_parts(parts.withColumn("log_id", F.substring_index("log_id", "=", -1)))
    continuous.write_stream(touched, f"{folder}/out", name).awaitTermination()
    rows = b.spark.read.schema(arriving_logs.ROWS).parquet(f"{folder}/out")
    return rows.select("log_id", F.unix_seconds("ts").alias("epoch"), "path")


# --- tool reports ---------------------------------------------------------------------------------


@query(
    "s5_lint_messages",
    """
    SELECT repo_id, report_id, coalesce(json_extract_string(m, '$.type'), 'unknown') AS type,
           json_extract_string(m, '$.path') AS path, CAST(json_extract_string(m, '$.line') AS INT) AS line,
           CAST(json_extract_string(m, '$.column') AS INT) AS col, json_extract_string(m, '$.message') AS message,
           json_extract_string(m, '$.symbol') AS symbol
    FROM (SELECT repo_id, report_id, unnest(CAST(report AS JSON[])) AS m FROM lint_reports WHERE json_valid(report))""",
    ("lint_reports",),
)
def lint_messages(b: Bindings):
    return reports.lint_messages(b.lint_reports).withColumnRenamed("column", "col")


@query(
    "s5_security_results",
    "SELECT repo_id, report_id, path, line, severity, confidence, message, test_id FROM function_findings",
    ("function_findings",),
)
def security_results(b: Bindings):
    return reports.security_results(b.security_reports).select(
        "repo_id", "report_id", F.col("filename").alias("path"), F.col("line_number").alias("line"),
        F.col("issue_severity").alias("severity"), F.col("issue_confidence").alias("confidence"),
        F.col("issue_text").alias("message"), "test_id",
    )


@query(
    "s5_lint_file_messages",
    """
    SELECT repo_id, report_id, path, json_extract_string(m, '$.ruleId') AS rule,
           CAST(json_extract_string(m, '$.severity') AS INT) AS severity, json_extract_string(m, '$.message') AS message,
           CAST(json_extract_string(m, '$.line') AS INT) AS line
    FROM (SELECT repo_id, report_id, json_extract_string(f, '$.filePath') AS path,
                 unnest(CAST(json_extract(f, '$.messages') AS JSON[])) AS m
          FROM (SELECT repo_id, report_id, unnest(CAST(report AS JSON[])) AS f
                FROM lint_file_reports WHERE json_valid(report)))""",
    ("lint_file_reports",),
)
def lint_file_messages(b: Bindings):
    return reports.lint_file_messages(b.lint_file_reports).select(
        "repo_id", "report_id", "path", F.col("ruleId").alias("rule"), "severity", "message", "line"
    )


@query(
    "s5_report_totals",
    """
    SELECT repo_id, report_id, 'messages' AS kind,
           CASE WHEN report = '' OR json_valid(report) THEN 'completed' ELSE 'failed' END AS status,
           CASE WHEN report = '' THEN 0 WHEN json_valid(report) THEN CAST(json_array_length(report) AS INT) END AS total_issues
    FROM lint_reports
    UNION ALL
    SELECT repo_id, report_id, 'results' AS kind,
           CASE WHEN report = '' OR json_valid(report) THEN 'completed' ELSE 'failed' END AS status,
           CASE WHEN report = '' THEN 0
                WHEN json_valid(report) THEN CAST(json_array_length(report, '$.results') AS INT) END AS total_issues
    FROM security_reports
    UNION ALL
    SELECT repo_id, report_id, 'files' AS kind, CASE WHEN json_valid(report) THEN 'completed' ELSE 'failed' END AS status,
           CASE WHEN json_valid(report)
                THEN CAST(json_array_length(report, '$[0].messages') + json_array_length(report, '$[1].messages') AS INT) END
    FROM lint_file_reports""",
    ("lint_reports", "security_reports", "lint_file_reports"),
)
def report_totals(b: Bindings):
    return union_all(
        [
            reports.report_totals(df, kind).withColumn("kind", F.lit(kind))
            for df, kind in (
                (b.lint_reports, "messages"), (b.security_reports, "results"), (b.lint_file_reports, "files"),
            )
        ]
    )


@query(
    "s5_object_reports",
    """
    SELECT repo_id, report_id, json_extract_string(report, '$.results[0].test_id') AS test_id,
           CAST(json_extract_string(report, '$.metrics.n') AS INT) AS n
    FROM security_reports WHERE json_valid(report)""",
    ("security_reports",),
)
def object_reports(b: Bindings):
    return reports.object_reports(b.security_reports).select(
        "repo_id", "report_id", F.try_variant_get("report", "$.results[0].test_id", "string").alias("test_id"),
        F.try_variant_get("report", "$.metrics.n", "int").alias("n"),
    )


# --- line logs ------------------------------------------------------------------------------------


def _exploded(view: str) -> str:
    return (
        f"SELECT * EXCLUDE (stdout), unnest({sql_lines('stdout')}) AS line, "
        f"CAST(unnest(range(1, len({sql_lines('stdout')}) + 1)) AS INT) AS line_no FROM {view}"
    )


@query(
    "s6_json_lines",
    f"""
    SELECT repo_id, log_id, line_no, json_extract_string(line, '$.code') AS code,
           json_extract_string(line, '$.message') AS message
    FROM ({_exploded('json_logs')}) WHERE json_valid(line)""",
    ("json_logs",),
)
def json_lines(b: Bindings):
    found = logs.json_lines(b.json_logs)
    return found.select(
        "repo_id", "log_id", "line_no", F.get_json_object("line", "$.code").alias("code"),
        F.get_json_object("line", "$.message").alias("message"),
    )


@query(
    "s7_type_check_lines",
    rf"""
    SELECT repo_id, log_id, line_no, m.path AS path, m.line AS line, {sql_strip('m.kind')} AS kind,
           {sql_strip('m.message')} AS message
    FROM (SELECT *, regexp_extract(line, '^([^:]*):([^:]*):([^:]*):(.*)$', ['path', 'line', 'kind', 'message']) AS m
          FROM ({_exploded('type_logs')}) WHERE regexp_matches(line, '^([^:]*):([^:]*):([^:]*):(.*)$'))""",
    ("type_logs",),
)
def type_check_lines(b: Bindings):
    return logs.type_check_lines(b.type_logs)


@query(
    "s8_compiler_lines",
    f"""
    SELECT repo_id, log_id, line_no, {sql_strip('line')} AS message
    FROM ({_exploded('compiler_logs')}) WHERE contains(line, '(') AND contains(line, ')')""",
    ("compiler_logs",),
)
def compiler_lines(b: Bindings):
    return logs.compiler_lines(b.compiler_logs)


@query(
    "s9_complexity_lines",
    rf"""
    SELECT repo_id, log_id, line_no, TRY_CAST(p[1] AS INT) AS complexity, p[2] AS package, p[3] AS name,
           split_part(p[-1], ':', 1) AS path
    FROM (SELECT *, string_split_regex({sql_strip('line')}, '\s+') AS p FROM ({_exploded('complexity_logs')}))
    WHERE len(p) >= 4 AND TRY_CAST(p[1] AS INT) IS NOT NULL""",
    ("complexity_logs",),
)
def complexity_lines(b: Bindings):
    return logs.complexity_lines(b.complexity_logs)


@query(
    "s10_complexity_messages",
    """
    SELECT repo_id, report_id, path, line, CAST(regexp_extract(message, 'complexity of ([0-9]+)', 1) AS INT) AS complexity
    FROM (SELECT repo_id, report_id, path, json_extract_string(m, '$.ruleId') AS rule,
                 json_extract_string(m, '$.message') AS message, CAST(json_extract_string(m, '$.line') AS INT) AS line
          FROM (SELECT repo_id, report_id, json_extract_string(f, '$.filePath') AS path,
                       unnest(CAST(json_extract(f, '$.messages') AS JSON[])) AS m
                FROM (SELECT repo_id, report_id, unnest(CAST(report AS JSON[])) AS f
                      FROM lint_file_reports WHERE json_valid(report))))
    WHERE contains(rule, 'complexity') AND regexp_matches(message, 'complexity of [0-9]+')""",
    ("lint_file_reports",),
)
def complexity_messages(b: Bindings):
    return reports.complexity_messages(b.lint_file_reports)


# --- test reports, manifests ----------------------------------------------------------------------


@query(
    "s11_json_test_summary",
    r"""
    SELECT repo_id, run_id, run_part, framework,
           CASE framework WHEN 'jest' THEN CAST(json_extract_string(report, '$.numTotalTests') AS BIGINT)
                WHEN 'pytest' THEN CAST(json_extract_string(report, '$.summary.total') AS BIGINT)
                WHEN 'gotest' THEN 3 ELSE run_part + 3 END AS total,
           CASE framework WHEN 'jest' THEN CAST(json_extract_string(report, '$.numPassedTests') AS BIGINT)
                WHEN 'pytest' THEN CAST(json_extract_string(report, '$.summary.passed') AS BIGINT)
                WHEN 'gotest' THEN len(regexp_extract_all(report, '"pass"')) ELSE run_part END AS passed,
           CASE framework WHEN 'jest' THEN CAST(json_extract_string(report, '$.numFailedTests') AS BIGINT)
                WHEN 'pytest' THEN CAST(json_extract_string(report, '$.summary.failed') AS BIGINT)
                WHEN 'gotest' THEN len(regexp_extract_all(report, '"fail"')) ELSE 1 END AS failed,
           CASE framework WHEN 'jest' THEN CAST(json_extract_string(report, '$.numPendingTests') AS BIGINT)
                WHEN 'mocha' THEN 2 ELSE 0 END AS skipped
    FROM test_reports""",
    ("test_reports",),
)
def json_test_summary(b: Bindings):
    return reports.test_summary(b.test_reports).drop("report", "stdout")


@query(
    "s12_junit_suites",
    r"""
    SELECT repo_id, report_id, coalesce(nullif(regexp_extract(tag, ' name="([^"]*)"', 1), ''), 'Unknown') AS name,
           coalesce(TRY_CAST(regexp_extract(tag, ' tests="([0-9]+)"', 1) AS INT), 0) AS tests,
           coalesce(TRY_CAST(regexp_extract(tag, ' failures="([0-9]+)"', 1) AS INT), 0) AS failures,
           coalesce(TRY_CAST(regexp_extract(tag, ' errors="([0-9]+)"', 1) AS INT), 0) AS errors,
           coalesce(TRY_CAST(regexp_extract(tag, ' skipped="([0-9]+)"', 1) AS INT), 0) AS skipped,
           coalesce(TRY_CAST(regexp_extract(tag, ' time="([0-9.]+)"', 1) AS DOUBLE), 0) AS time
    FROM (SELECT repo_id, report_id, unnest(regexp_extract_all(xml, '<testsuite [^>]*>')) AS tag FROM junit_reports)""",
    ("junit_reports",),
)
def junit_suites(b: Bindings):
    return reports.junit_suites(b.junit_reports)


@query(
    "s13_manifest_dependencies",
    """
    SELECT repo_id, manifest_id,
           CASE WHEN json_valid(manifest) THEN json_extract_string(manifest, '$.dependencies.shared') END AS shared,
           CASE WHEN json_valid(manifest) THEN 2 ELSE 0 END AS dependencies,
           json_valid(manifest) AND manifest_id % 4 = 0 AS jest, json_valid(manifest) AND manifest_id % 4 = 1 AS mocha,
           json_valid(manifest) AND manifest_id % 4 = 2 AS vitest
    FROM manifests""",
    ("manifests",),
)
def manifest_dependencies(b: Bindings):
    merged = b.manifests.withColumn("deps", reports.manifest_dependencies(F.col("manifest")))
    used = [reports.uses_framework(F.col("deps"), F.lit(f)).alias(f) for f in ("jest", "mocha", "vitest")]
    return merged.select(
        "repo_id", "manifest_id", F.try_element_at("deps", F.lit("shared")).alias("shared"),
        F.size("deps").alias("dependencies"), *used,
    )
