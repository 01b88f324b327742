"""Reports: console metrics, Markdown lines, JSON documents, and the tables behind them.

Whatever grows with a repository (issues, findings, claims) stays a table of rows next to the document;
the document holds only bounded lists, so no row and no task grows with the largest repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.fixed_values import COMPLEXITY_BINS
from auditframe.operators.grouping import By, join_groups

REPO = ("repo_id",)
SUMMARY, DISTRIBUTION, FILES, TESTS, HISTORY, INSIGHTS, ISSUES, RECOMMENDATIONS = range(8)


def number(value: Column, digits: int) -> Column:
    """A non-negative number with one or two digits; ties of its exact binary value go to the even digit.

    ``format_string`` rounds the shortest decimal text of the value, and ties upwards. Here the fraction
    is taken as whole units of 2**-56 and what is left of them, so that the comparison is exact.
    """
    scale, unit = 10**digits, 2**56
    value = value.cast("double")
    whole = F.floor(value)
    units = (value - whole) * float(unit)
    counted = F.floor(units)
    scaled = counted * scale
    last = F.shiftright(scaled, 56)
    below_tie = F.lit(unit // 2) - scaled.bitwiseAND(F.lit(unit - 1))
    left = (units - counted) * scale
    up = (left > below_tie) | ((left == below_tie) & (last % 2 == 1))
    rounded = whole * scale + last + up.cast("bigint")
    digits_text = F.lpad((rounded % scale).cast("string"), digits, "0")
    return F.concat(F.floor(rounded / scale).cast("string"), F.lit("."), digits_text)


def _text(value: Column) -> Column:
    return value.cast("string")


# --- bounded lists --------------------------------------------------------------------------------


def bounded_list(df: DataFrame, columns: list[str], k: int, name: str, by: By = REPO) -> DataFrame:
    """The first k ranked rows of each group as an array of structs; rows beyond k go before the shuffle."""
    first = df.filter(F.col("rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    return first.groupBy(*by).agg(
        F.transform(listed, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name)
    )


def test_results_by_framework(runs: DataFrame, by: By = REPO) -> DataFrame:
    """Counts per language and framework."""
    name = F.concat_ws("_", "language", "framework").alias("runner")
    return runs.groupBy(*by, name).agg(
        *[F.sum(c).alias(c) for c in ("total", "passed", "failed", "skipped")]
    )


def git_report(
    history: DataFrame, contributors: DataFrame, insights: DataFrame, by: By = REPO, listed_contributors: int = 5
) -> DataFrame:
    """History block of a report: counts, the first contributors (a top list of the given length) and all insights."""
    top = bounded_list(contributors, ["author", "commits"], listed_contributors, "top_contributors", by)
    # At most six rules can hold, so this list is bounded by itself.
    listed = F.array_sort(F.collect_list(F.struct("ord", "category", "message")))
    told = insights.groupBy(*by).agg(listed.alias("insights"))
    rows = join_groups(join_groups(history, top, by), told, by)
    blocks = {
        "repository_info": ["repo_age_days", "first_commit_date", "last_commit_date", "total_commits"],
        "commit_patterns": ["features", "fixes", "documentation", "refactoring", "tests", "breaking_changes"],
        "contributor_summary": ["total_contributors", "bus_factor", "top_contributors"],
        "stability_metrics": ["high_churn_files", "stable_files"],
        "documentation_sync": ["documentation_files", "outdated_docs"],
        "version_info": ["latest_version", "total_versions", "follows_semver"],
    }
    structs = [F.struct(*columns).alias(block) for block, columns in blocks.items()]
    return rows.select(*by, *structs, F.transform("insights", lambda i: i.dropFields("ord")).alias("insights"))


def complexity_report(
    summary: DataFrame, distribution: DataFrame, top_files: DataFrame, by: By = REPO, listed_files: int = 10
) -> DataFrame:
    """Complexity block of a report: metrics, all six bins, the most complex files (a top list of the given length)."""
    # Six rows per group at most.
    bins = distribution.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "functions")))).alias("complexity_distribution")
    )
    files = bounded_list(top_files, ["path", "total_complexity", "loc", "functions"], listed_files, "top_complex_files", by)
    metrics = F.struct(
        F.col("total_files").alias("files_analyzed"),
        F.col("total_loc").alias("total_lines"),
        F.col("average_complexity"),
        F.col("total_complexity"),
    )
    rows = join_groups(join_groups(summary, bins, by), files, by)
    return rows.select(*by, metrics.alias("metrics"), "complexity_distribution", "top_complex_files")


def verification_report(issues: DataFrame, by: By = REPO) -> DataFrame:
    """Number of issues per tool, for each kind of check. Tools are few, so the maps are bounded."""

    def of(category: str) -> Column:
        entry = F.when(F.col("category") == category, F.struct("tool", "total_issues"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    return issues.groupBy(*by).agg(
        of("security").alias("security_summary"),
        of("type_checking").alias("type_checking_summary"),
        of("linting").alias("static_analysis_summary"),
    )


def contracts_report(checks: DataFrame, by: By = REPO) -> DataFrame:
    """Contract tools per language; languages are few."""
    tools = F.struct("tools_used", F.size("tools_used").alias("files_analyzed"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("language"), tools.alias("tools"))))
    return checks.groupBy(*by).agg(F.map_from_entries(entries).alias("contracts_verified"))


def finding_counts(findings: DataFrame, by: By = REPO) -> DataFrame:
    """Sizes of the detailed findings, which stay rows: complex functions and results of security tools."""
    category = F.col("category")
    return findings.groupBy(*by).agg(
        F.count_if(category == "complexity").alias("complexity_issues"),
        F.count_if(category == "security").alias("security_issues"),
    )


def advice_list(recommendations: DataFrame, by: By = REPO) -> DataFrame:
    """All recommendations of a repository; at most one per rule."""
    told = F.struct("rule", "category", "priority", "recommendation", "action")
    listed = F.array_sort(F.collect_list(told))
    return recommendations.groupBy(*by).agg(listed.alias("recommendations"))


def report_document(
    scored: DataFrame,
    complexity: DataFrame,
    git: DataFrame,
    languages: DataFrame,
    issue_counts: DataFrame,
    by: By = REPO,
    verification: list[DataFrame] | None = None,
    claims: DataFrame | None = None,
    details: DataFrame | None = None,
    advice: DataFrame | None = None,
) -> DataFrame:
    """One nested row per repository. Blocks of ``verification`` are joined into one."""
    rows = scored.select(
        *by,
        F.struct(
            "health_score", "gate_status", "total_files", "total_tests", "passed", "failed", "success_rate",
            "security_issues", "secrets_found",
        ).alias("summary"),
    )
    for name, part in (
        ("complexity_analysis", complexity),
        ("git_analysis", git),
        ("languages_detected", languages),
        ("issues", issue_counts),
    ):
        columns = [c for c in part.columns if c not in by]
        block = part.select(*by, F.struct(*columns).alias(name))
        rows = join_groups(rows, block, by)
    if verification:
        parts = scored.select(*by)
        for part in verification:
            parts = join_groups(parts, part, by)
        blocks = [c for c in parts.columns if c not in by]
        rows = join_groups(rows, parts.select(*by, F.struct(*blocks).alias("verification_analysis")), by)
    for name, part in (("claim_summary", claims), ("detailed_findings", details)):
        if part is not None:
            columns = [c for c in part.columns if c not in by]
            rows = join_groups(rows, part.select(*by, F.struct(*columns).alias(name)), by)
    return rows if advice is None else join_groups(rows, advice, by)


# --- console --------------------------------------------------------------------------------------


def console_summary(scored: DataFrame, distribution: DataFrame, by: By = REPO) -> DataFrame:
    """Ordered ``(metric, value)`` rows; empty bins and absent findings are left out."""
    has_tests = F.col("total_tests") > 0
    entries: list[tuple[str, Column, Column]] = [
        ("Files analyzed", F.lit(True), _text(F.col("total_files"))),
        ("Total lines", F.lit(True), _text(F.col("total_loc"))),
        ("Average complexity", F.lit(True), number(F.col("average_complexity"), 2)),
        ("Total tests", has_tests, _text(F.col("total_tests"))),
        ("Passed", has_tests, _text(F.col("passed"))),
        ("Failed", has_tests, _text(F.col("failed"))),
        ("Success rate", has_tests, F.concat(number(F.col("success_rate"), 1), F.lit("%"))),
        ("No tests found", ~has_tests, F.lit("")),
        ("Security issues found", F.lit(True), _text(F.col("security_issues"))),
        ("Potential secrets found", F.col("secrets_found") > 0, _text(F.col("secrets_found"))),
        ("Type checking issues", F.col("type_errors") > 0, _text(F.col("type_errors"))),
    ]
    structs = [
        F.when(shown, F.struct(F.lit(i * 10).alias("ord"), F.lit(metric).alias("metric"), value.alias("value")))
        for i, (metric, shown, value) in enumerate(entries)
    ]
    lines = scored.select(*by, F.inline(F.array_compact(F.array(*structs))))
    position = F.lit(None).cast("int")
    for i, (_, label, _) in enumerate(COMPLEXITY_BINS):
        position = F.when(F.col("bin") == label, F.lit(21 + i)).otherwise(position)
    bins = distribution.filter(F.col("functions") > 0).select(
        *by,
        position.alias("ord"),
        F.col("bin").alias("metric"),
        F.concat(_text(F.col("functions")), F.lit(" functions")).alias("value"),
    )
    return lines.unionByName(bins)


# --- Markdown -------------------------------------------------------------------------------------


def _lines(df: DataFrame, section: int, key: Column, texts: list[Column], by: By) -> DataFrame:
    """Rows ``(section, key, ord, line)``; ``key`` orders the entries of a section."""
    return df.select(
        *by, F.lit(section).alias("section"), key.cast("string").alias("key"), F.posexplode(F.array(*texts)).alias("ord", "line")
    )


def _item(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- **{label}**: "), value)


def _title(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def markdown_report(
    scored: DataFrame,
    languages: DataFrame,
    distribution: DataFrame,
    top_files: DataFrame,
    insights: DataFrame,
    issues: DataFrame,
    recommendations: DataFrame,
    by: By = REPO,
) -> DataFrame:
    """The report as rows; ``sorted_report`` puts them in order."""
    rows = join_groups(scored, languages, by)
    none = F.lit("")
    parts = [
        _lines(
            rows,
            SUMMARY,
            none,
            [
                F.lit("# Code Analysis Report"),
                F.lit("## Executive Summary"),
                _item("Health Score", F.concat(number(F.col("health_score"), 1), F.lit("/100"))),
                _item("Files Analyzed", _text(F.col("total_files"))),
                _item("Languages", F.array_join(F.coalesce("languages", F.array().cast("array<string>")), ", ")),
                F.lit("## Complexity Analysis"),
                _item("Total Lines", _text(F.col("total_loc"))),
                _item("Average Complexity", number(F.col("average_complexity"), 2)),
            ],
            by,
        ),
        _lines(
            distribution,
            DISTRIBUTION,
            F.col("bin"),
            [F.concat(F.lit("- "), F.col("bin"), F.lit(": "), _text(F.col("functions")), F.lit(" functions"))],
            by,
        ),
        _lines(
            top_files.filter(F.col("rank") <= 5),
            FILES,
            F.col("rank"),
            [
                F.concat(
                    _text(F.col("rank")), F.lit(". `"), F.col("path"), F.lit("` - Complexity: "),
                    _text(F.col("total_complexity")),
                )
            ],
            by,
        ),
        _lines(
            rows,
            TESTS,
            none,
            [
                F.lit("## Test Analysis"),
                _item("Total Tests", _text(F.col("total_tests"))),
                _item("Passed", _text(F.col("passed"))),
                _item("Failed", _text(F.col("failed"))),
                _item("Success Rate", F.concat(number(F.col("success_rate"), 1), F.lit("%"))),
            ],
            by,
        ),
        _lines(
            rows.filter(F.col("has_history")),
            HISTORY,
            none,
            [
                F.lit("## Git History Analysis"),
                _item("Age", F.concat(_text(F.col("repo_age_days")), F.lit(" days"))),
                _item("Bus Factor", _text(F.col("bus_factor"))),
                _item("High Churn Files", _text(F.col("high_churn_files"))),
                _item("Features", _text(F.col("features"))),
                _item("Bug Fixes", _text(F.col("fixes"))),
            ],
            by,
        ),
        _lines(
            insights,
            INSIGHTS,
            F.col("ord"),
            [F.concat(F.lit("- **"), _title(F.col("category")), F.lit("**: "), F.col("message"))],
            by,
        ),
        _lines(
            issues,
            ISSUES,
            F.concat_ws("|", "type", "location", "description"),
            [
                F.concat(F.lit("### "), _title(F.col("type"))),
                _item("Severity", F.col("severity")),
                _item("Location", F.concat(F.lit("`"), F.col("location"), F.lit("`"))),
                _item("Description", F.col("description")),
                _item("Recommendation", F.col("recommendation")),
            ],
            by,
        ),
        _lines(
            recommendations,
            RECOMMENDATIONS,
            F.concat_ws("|", "category", "rule"),
            [
                F.concat(F.lit("### "), F.col("category"), F.lit(" (Priority: "), F.col("priority"), F.lit(")")),
                F.concat(F.lit("**"), F.col("recommendation"), F.lit("**")),
                F.concat(F.lit("Action: "), F.col("action")),
            ],
            by,
        ),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def sorted_report(lines: DataFrame, by: By = REPO) -> DataFrame:
    """Range-partitioned order: a repository with many issues spreads over several sorted files."""
    return lines.orderBy(*by, "section", "key", "ord")


# --- sinks ----------------------------------------------------------------------------------------


def write_report(tables: dict[str, DataFrame], folder: str, partition_by: By = ()) -> None:
    """Write each table as JSON lines below ``folder``; values JSON does not know become text."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if partition_by and all(c in table.columns for c in partition_by):
            writer = writer.partitionBy(*partition_by)
        writer.json(f"{folder.rstrip('/')}/{name}")


def write_markdown(lines: DataFrame, folder: str, by: By = REPO) -> None:
    """Write the ordered lines as text, one folder per repository."""
    ordered = sorted_report(lines, by).select(*by, F.col("line").alias("value"))
    ordered.write.mode("overwrite").partitionBy(*by).text(folder)


def as_json(document: DataFrame, by: By = REPO) -> DataFrame:
    """Documents as JSON texts."""
    columns = [c for c in document.columns if c not in by]
    return document.select(*by, F.to_json(F.struct(*columns)).alias("report"))
