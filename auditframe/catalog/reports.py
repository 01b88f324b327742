"""A24 to A30, J8 and K: issues, scores, recommendations, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.catalog.aggregates import (
    CATEGORY_COUNTS,
    FILE_ROLLUP,
    REPOSITORY_INFO,
    TEST_TOTALS,
    VERSION_STATS,
    judged,
)
from auditframe.catalog.classifiers import LINE_METRICS
from auditframe.catalog.rankings import FEATURE_COMMITS, OUTDATED
from auditframe.catalog.registry import AS_OF_COMMITS, AS_OF_FILES, lint_findings, query, rounded, scanner_findings, type_findings
from auditframe.functions.fixed_values import COMPLEXITY_BINS, INSIGHTS, ISSUE_ADVICE, REPORT_ADVICE
from auditframe.operators import discovery, findings, history, metrics, verdicts
from auditframe.operators.findings import union_all
from auditframe.plans import report, scoring
from auditframe.session import stage
from auditframe.sources.bindings import Bindings
from auditframe.sources.reports import test_summary

# --- the summary row ------------------------------------------------------------------------------

# The commits end in 2024, the touched files in 2001, so each part of the history has its own "now".
_HISTORY = f"""
    SELECT i.repo_id, repo_age_days, total_commits, c.features, c.fixes, c.tests, c.breaking_changes, b.bus_factor,
           coalesce(o.n, 0) AS outdated_docs, coalesce(f.n, 0) AS recent_features, coalesce(h.n, 0) AS high_churn_files,
           coalesce(v.has_versions, false) AS has_versions, coalesce(v.follows_semver, false) AS follows_semver
    FROM ({REPOSITORY_INFO}) i
    LEFT JOIN ({CATEGORY_COUNTS}) c ON c.repo_id = i.repo_id
    LEFT JOIN (SELECT repo_id, CAST(count_if(n > 0.1 * total) AS BIGINT) AS bus_factor
               FROM (SELECT repo_id, author, count(*) AS n, sum(count(*)) OVER (PARTITION BY repo_id) AS total
                     FROM commits GROUP BY repo_id, author) GROUP BY repo_id) b ON b.repo_id = i.repo_id
    LEFT JOIN (SELECT repo_id, count(*) AS n FROM ({OUTDATED}) GROUP BY repo_id) o ON o.repo_id = i.repo_id
    LEFT JOIN (SELECT repo_id, count(*) AS n FROM ({FEATURE_COMMITS}) GROUP BY repo_id) f ON f.repo_id = i.repo_id
    LEFT JOIN (SELECT repo_id, count(*) AS n
               FROM (SELECT repo_id, path FROM commit_files
                     WHERE ts >= TIMESTAMP '{AS_OF_FILES}' - INTERVAL 6 MONTH GROUP BY repo_id, path HAVING count(*) > 2)
               GROUP BY repo_id) h ON h.repo_id = i.repo_id
    LEFT JOIN ({VERSION_STATS}) v ON v.repo_id = i.repo_id"""
_HISTORY_VIEWS = ("commits", "commit_files", "tags")


def whole_history(b: Bindings):
    return history.history_summary(
        b.commits, b.commit_files, b.tags, AS_OF_COMMITS, files_as_of=AS_OF_FILES, churn_above=2
    )


def history_row(b: Bindings, whole: DataFrame | None = None):
    rows = whole_history(b) if whole is None else whole
    return rows.select(
        "repo_id", "repo_age_days", "total_commits", "features", "fixes", "tests", "breaking_changes", "bus_factor",
        "outdated_docs", "recent_features", "high_churn_files", "has_versions", "follows_semver",
    )


_CI = """SELECT repo_id, bool_or(starts_with(path, '.github/workflows/')) AS has_ci FROM project_files GROUP BY repo_id"""
_FRAMEWORKS = r"""
    SELECT repo_id, count(DISTINCT f) AS frameworks FROM (
        SELECT repo_id, unnest(list_concat(
            CASE WHEN path = 'pytest.ini' OR regexp_matches(path, '(^|/)(test_[^/]*\.py|[^/]*_test\.py)$') THEN ['pytest'] ELSE [] END,
            list_concat(CASE WHEN regexp_matches(path, '(^|/)test[^/]*\.py$') THEN ['unittest'] ELSE [] END,
            list_concat(CASE WHEN path LIKE '%.py' THEN ['doctest'] ELSE [] END,
            list_concat(CASE WHEN path = 'jest.config.js' OR path = 'package.json' THEN ['jest'] ELSE [] END,
            list_concat(CASE WHEN path = 'package.json' THEN ['mocha', 'ts_jest'] ELSE [] END,
            list_concat(CASE WHEN starts_with(path, 'spec/') THEN ['jasmine', 'rspec'] ELSE [] END,
            list_concat(CASE WHEN path = 'Cargo.toml' OR starts_with(path, 'tests/') THEN ['cargo'] ELSE [] END,
            list_concat(CASE WHEN starts_with(path, 'tests/') THEN ['gtest'] ELSE [] END,
            list_concat(CASE WHEN path = 'go.mod' OR regexp_matches(path, '_test\.go$') THEN ['gotest'] ELSE [] END,
                        CASE WHEN starts_with(path, 'src/test/java/') THEN ['junit'] ELSE [] END)))))))))) AS f
        FROM project_files) GROUP BY repo_id"""
_SUMMARY = f"""
    SELECT r.repo_id, coalesce(x.total_files, 0) AS total_files, coalesce(x.total_complexity, 0) AS total_complexity,
           coalesce(x.average_complexity, 0) AS average_complexity,
           coalesce(x.high_complexity_functions, 0) AS high_complexity_functions,
           coalesce(t.total_tests, 0) AS total_tests, coalesce(t.passed, 0) AS passed, coalesce(t.failed, 0) AS failed,
           coalesce(t.success_rate, 0) AS success_rate, coalesce(s.n, 0) AS security_issues, coalesce(y.n, 0) AS type_errors,
           coalesce(w.frameworks, 0) AS frameworks, coalesce(ci.has_ci, false) AS has_ci,
           coalesce(h.repo_age_days, 365) AS repo_age_days, coalesce(h.bus_factor, 3) AS bus_factor,
           coalesce(h.high_churn_files, 0) AS high_churn_files, coalesce(h.outdated_docs, 0) AS outdated_docs,
           h.repo_id IS NOT NULL AS has_history
    FROM (SELECT DISTINCT repo_id FROM project_files) r
    LEFT JOIN (SELECT m.repo_id, count(*) AS total_files, CAST(sum(total_complexity) AS BIGINT) AS total_complexity,
                      sum(total_complexity) / CAST(count(*) AS DOUBLE) AS average_complexity,
                      max(q.n) AS high_complexity_functions
               FROM ({FILE_ROLLUP}) m
               JOIN (SELECT repo_id, CAST(count_if(complexity > 30) AS BIGINT) AS n FROM function_metrics GROUP BY repo_id) q
                 ON q.repo_id = m.repo_id GROUP BY m.repo_id) x ON x.repo_id = r.repo_id
    LEFT JOIN ({TEST_TOTALS}) t ON t.repo_id = r.repo_id
    LEFT JOIN (SELECT repo_id, count(*) AS n FROM function_findings GROUP BY repo_id) s ON s.repo_id = r.repo_id
    LEFT JOIN (SELECT repo_id, count(*) AS n FROM (SELECT repo_id, unnest(string_split(stdout, chr(10))) AS line FROM type_logs)
               WHERE regexp_matches(line, '^[^:]*:[^:]*:[^:]*:') GROUP BY repo_id) y ON y.repo_id = r.repo_id
    LEFT JOIN ({_FRAMEWORKS}) w ON w.repo_id = r.repo_id
    LEFT JOIN ({_CI}) ci ON ci.repo_id = r.repo_id
    LEFT JOIN ({_HISTORY}) h ON h.repo_id = r.repo_id"""
_VIEWS = (
    "function_metrics", "stdout_counts", "function_findings", "type_logs", "project_files", *_HISTORY_VIEWS,
)


def _lines(b: Bindings):
    return metrics.line_metrics(union_all([b.files, b.source_docs]))


def summary_row(
    b: Bindings, lines: DataFrame | None = None, rollup: DataFrame | None = None, whole: DataFrame | None = None
):
    """The summary row; line counts, file metrics and history may be given by a caller that needs them elsewhere too."""
    lines = _lines(b) if lines is None else lines
    rollup = metrics.file_metrics(b.function_metrics, lines) if rollup is None else rollup
    names = b.project_files
    frameworks = discovery.detected_frameworks(names).groupBy("repo_id").agg(F.count("*").alias("frameworks"))
    git = history_row(b, whole)
    return scoring.combine(
        names.select("repo_id").distinct(),
        [
            metrics.summary_with_lines(rollup, lines),
            scoring.high_complexity(b.function_metrics),
            scoring.findings_summary(union_all([scanner_findings(b), type_findings(b)])),
            findings.test_totals(test_summary(b.test_runs)).drop("frameworks_used"),
            frameworks,
            discovery.has_ci(names),
            git.withColumn("has_history", F.lit(True)),
        ],
    )


_SUMMARY_COLUMNS = [
    "repo_id", "total_files", "total_complexity", "average_complexity", "high_complexity_functions", "total_tests",
    "failed", "success_rate", "security_issues", "type_errors", "frameworks", "has_ci", "repo_age_days", "bus_factor",
    "high_churn_files", "outdated_docs", "has_history",
]


def _rounded(name: str) -> str:
    return f"round({name}, 6) AS {name}" if name in ("average_complexity", "success_rate") else name


@query("j8_summary_row", f"SELECT {', '.join(_rounded(c) for c in _SUMMARY_COLUMNS)} FROM ({_SUMMARY})", _VIEWS)
def combined(b: Bindings):
    return summary_row(b).select(*_SUMMARY_COLUMNS).withColumns(
        {c: rounded(c) for c in ("average_complexity", "success_rate")}
    )


# --- score ----------------------------------------------------------------------------------------

_SCORE = """
    greatest(0, 100 - CASE WHEN average_complexity > 10 THEN least(20, (average_complexity - 10) * 2) ELSE 0 END
        - CASE WHEN high_complexity_functions > 0 THEN least(15, high_complexity_functions * 3) ELSE 0 END
        - (100 - success_rate) * 0.3
        - CASE WHEN security_issues > 0 THEN least(25, security_issues * 2) ELSE 0 END
        - CASE WHEN has_history AND repo_age_days < 90 THEN 5 ELSE 0 END
        - CASE WHEN has_history AND bus_factor < 3 THEN least(10, (3 - bus_factor) * 5) ELSE 0 END
        - CASE WHEN has_history AND high_churn_files > 5 THEN least(10, high_churn_files) ELSE 0 END)"""


@query("a28_health_score", f"SELECT repo_id, round(CAST({_SCORE} AS DOUBLE), 6) AS health_score FROM ({_SUMMARY})", _VIEWS)
def health_score(b: Bindings):
    return scoring.scored(summary_row(b)).select("repo_id", rounded("health_score").alias("health_score"))


# A part per repository, so that every rule fires somewhere and stays silent elsewhere.
_INPUT = """
    SELECT concat('p', CAST(p_partkey AS STRING)) AS repo_id, p_size / 2.0E0 AS average_complexity,
           CAST(p_partkey % 4 AS BIGINT) AS high_complexity_functions, CAST(p_size % 20 AS BIGINT) AS total_tests,
           CAST(p_size % 3 AS BIGINT) AS failed, p_size * 2.0E0 AS success_rate, CAST(p_partkey % 7 AS BIGINT) AS security_issues,
           CAST(p_partkey % 2 AS BIGINT) AS security_analyses, CAST(p_partkey % 3 AS BIGINT) AS frameworks,
           CAST(p_partkey % 9 AS BIGINT) AS under_commented_files, p_partkey % 5 = 0 AS has_ci,
           CAST(p_partkey % 200 AS BIGINT) AS repo_age_days, CAST(p_partkey % 5 AS BIGINT) AS bus_factor,
           CAST(p_size % 9 AS BIGINT) AS high_churn_files, CAST(p_partkey % 6 AS BIGINT) AS outdated_docs,
           p_partkey % 11 > 0 AS has_history, CAST(p_size % 13 AS BIGINT) AS features, CAST(p_partkey % 29 AS BIGINT) AS fixes,
           CAST(p_partkey % 3 AS BIGINT) AS tests, CAST(p_size % 8 AS BIGINT) AS breaking_changes,
           CAST(p_partkey % 2 AS BIGINT) AS recent_features, p_partkey % 2 = 0 AS has_versions, p_size > 20 AS follows_semver
    FROM {part}"""
_INPUT_SQL = _INPUT.replace("{part}", "part")


def rule_input(b: Bindings):
    return scoring.combine(b.sql(_INPUT), [])


@query("a28_health_score_rules", f"SELECT repo_id, round(CAST({_SCORE} AS DOUBLE), 6) AS health_score FROM ({_INPUT_SQL})")
def health_score_rules(b: Bindings):
    return scoring.scored(rule_input(b)).select("repo_id", rounded("health_score").alias("health_score"))


def _filled(text: str, number: str) -> str:
    parts = [f"'{p.replace(chr(39), chr(39) * 2)}'" for p in text.split("{n}")]
    return f"concat({parts[0]}, {number}, {parts[1]})" if len(parts) == 2 else parts[0]


def _rules_sql(source: str, names: tuple[str, ...], rules: list[tuple[str, tuple[str, ...], str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT repo_id, {', '.join(f'{_filled(t, number)} AS {n}' for n, t in zip(names, texts, strict=True))} "
        f"FROM ({source}) WHERE {condition}"
        for condition, texts, number in rules
    )


_RECOMMENDATIONS = _rules_sql(
    _INPUT_SQL,
    ("category", "priority", "recommendation", "action"),
    [
        ("frameworks = 0", REPORT_ADVICE["no_framework"], ""),
        ("frameworks > 0 AND total_tests < 10", REPORT_ADVICE["few_tests"], ""),
        ("average_complexity > 15", REPORT_ADVICE["complex_code"], ""),
        ("security_analyses = 0", REPORT_ADVICE["no_security"], ""),
        ("under_commented_files > 5", REPORT_ADVICE["few_comments"], ""),
        ("NOT has_ci", REPORT_ADVICE["no_ci"], ""),
        ("has_history AND repo_age_days < 90", REPORT_ADVICE["young"], "repo_age_days"),
        ("has_history AND bus_factor < 3", REPORT_ADVICE["bus_factor"], "bus_factor"),
        ("has_history AND outdated_docs > 3", REPORT_ADVICE["outdated_docs"], "outdated_docs"),
    ],
)


@query("a25_recommendations", _RECOMMENDATIONS)
def recommendations(b: Bindings):
    return scoring.recommendations(rule_input(b)).drop("rule")


_INSIGHT_RULES = [
    ("repo_age_days < 90", INSIGHTS["young"], ""),
    ("fixes > features * 2", INSIGHTS["fixes"], ""),
    ("breaking_changes > 5", INSIGHTS["breaking"], ""),
    ("outdated_docs > 0", INSIGHTS["outdated_docs"], ""),
    ("bus_factor < 3", INSIGHTS["bus_factor"], "bus_factor"),
    ("high_churn_files > 5", INSIGHTS["churn"], ""),
]


@query("a26_insights", _rules_sql(_HISTORY, ("type", "category", "message"), _INSIGHT_RULES), _HISTORY_VIEWS)
def insights(b: Bindings):
    return scoring.insights(history_row(b)).drop("ord")


@query("a26_insight_rules", _rules_sql(_INPUT_SQL, ("type", "category", "message"), _INSIGHT_RULES))
def insight_rules(b: Bindings):
    return scoring.insights(rule_input(b)).drop("ord")


def _verification_issues(source: str) -> str:
    return f"""
    SELECT repo_id, 'medium' AS severity, 'missing_tests' AS type,
           'Many features added without corresponding tests' AS description,
           concat('Feature commits: ', features, ', Test commits: ', tests) AS evidence
    FROM ({source}) WHERE features / CAST(greatest(tests, 1) AS DOUBLE) > 3
    UNION ALL
    SELECT repo_id, 'medium', 'outdated_documentation', 'Recent features may not be properly documented',
           'Documentation hasn''t been updated recently despite new features'
    FROM ({source}) WHERE recent_features > 0 AND outdated_docs > 0
    UNION ALL
    SELECT repo_id, 'low', 'versioning_inconsistency', 'Version tags don''t follow semantic versioning',
           'Inconsistent version tag format detected'
    FROM ({source}) WHERE has_versions AND NOT follows_semver"""


@query("a27_verification_issues", _verification_issues(_HISTORY), _HISTORY_VIEWS)
def verification_issues(b: Bindings):
    return scoring.verification_issues(history_row(b))


@query("a27_verification_issue_rules", _verification_issues(_INPUT_SQL))
def verification_issue_rules(b: Bindings):
    return scoring.verification_issues(rule_input(b))


_ISSUES = f"""
    SELECT repo_id, 'high_complexity' AS type, 'high' AS severity, concat(path, ':', lineno) AS location,
           concat('Function ''', name, ''' has complexity ', complexity, ' (threshold: 20)') AS description
    FROM function_metrics WHERE complexity > 20
    UNION ALL
    SELECT repo_id, 'security_vulnerability', lower(severity), concat(path, ':', line), message
    FROM function_findings WHERE severity IN ('HIGH', 'MEDIUM')
    UNION ALL
    SELECT repo_id, 'hardcoded_secret', 'critical', path, 'Potential token found'
    FROM files WHERE regexp_matches(path, '\\.(py|js|java)$')
      AND regexp_matches(text, '(?i)(token|auth)\\s*[:=]\\s*[\\x22\\x27]?([a-zA-Z0-9_-]{{20,}})')
    UNION ALL
    SELECT repo_id, 'type_errors', 'medium', 'mypy type checking', concat(count(*), ' type errors found')
    FROM (SELECT repo_id, unnest(string_split(stdout, chr(10))) AS line FROM type_logs)
    WHERE regexp_matches(line, '^[^:]*:[^:]*:[^:]*:') GROUP BY repo_id
    UNION ALL
    SELECT repo_id, 'test_failures', 'high', 'test suite', concat(failed, ' tests are failing') FROM ({_SUMMARY}) WHERE failed > 0
    UNION ALL
    SELECT repo_id, 'low_bus_factor', 'high', 'repository',
           concat('Low bus factor (', bus_factor, ') - over-reliance on few contributors')
    FROM ({_SUMMARY}) WHERE has_history AND bus_factor < 2
    UNION ALL
    SELECT repo_id, 'outdated_documentation', 'medium', 'documentation', concat(outdated_docs, ' documentation files may be outdated')
    FROM ({_SUMMARY}) WHERE has_history AND outdated_docs > 0"""
_ISSUE_CASES = " ".join(f"WHEN '{kind}' THEN '{advice}'" for kind, advice in ISSUE_ADVICE.items())


def issue_rows(b: Bindings, summary):
    secrets = scoring.secrets_as_findings(findings.secret_findings(b.files))
    found = union_all([scanner_findings(b), type_findings(b), secrets])
    return scoring.critical_issues(b.function_metrics, found, summary)


@query(
    "a24_critical_issues",
    f"SELECT *, CASE type {_ISSUE_CASES} END AS recommendation FROM ({_ISSUES})",
    (*_VIEWS, "files"),
)
def critical_issues(b: Bindings):
    return issue_rows(b, summary_row(b))


# --- report tables --------------------------------------------------------------------------------


@query(
    "a30_results_by_framework",
    """
    SELECT repo_id, language || '_' || framework AS runner, CAST(sum(total) AS BIGINT) AS total,
           CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(skipped) AS BIGINT) AS skipped
    FROM stdout_counts GROUP BY repo_id, language, framework""",
    ("stdout_counts",),
)
def results_by_framework(b: Bindings):
    return report.test_results_by_framework(test_summary(b.test_runs))


def git_block(b: Bindings, whole: DataFrame | None = None):
    rows = whole_history(b) if whole is None else whole
    return report.git_report(rows, history.top_contributors(b.commits, AS_OF_COMMITS), scoring.insights(rows))


@query(
    "a30_git_report",
    f"""
    SELECT i.repo_id, i.repo_age_days, i.total_commits, t.top, CAST(n.insights AS INT) AS insights
    FROM ({REPOSITORY_INFO}) i
    JOIN (SELECT repo_id, string_agg(author || '=' || n, ',' ORDER BY n DESC, author) AS top
          FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, author) AS r
                FROM (SELECT repo_id, author, count(*) AS n FROM commits GROUP BY ALL)) WHERE r <= 5 GROUP BY repo_id) t
      ON t.repo_id = i.repo_id
    JOIN (SELECT repo_id, {' + '.join(f'CAST({rule} AS INT)' for rule, _, _ in _INSIGHT_RULES)} AS insights
          FROM ({_HISTORY})) n ON n.repo_id = i.repo_id""",
    _HISTORY_VIEWS,
)
def git_report(b: Bindings):
    pair = F.transform("contributor_summary.top_contributors", lambda c: F.concat(c["author"], F.lit("="), c["commits"].cast("string")))
    return git_block(b).select(
        "repo_id", "repository_info.repo_age_days", "repository_info.total_commits", F.array_join(pair, ",").alias("top"),
        F.size("insights").alias("insights"),
    )


def _complexity_block(b: Bindings, lines: DataFrame | None = None, rollup: DataFrame | None = None):
    lines = _lines(b) if lines is None else lines
    rollup = metrics.file_metrics(b.function_metrics, lines) if rollup is None else rollup
    return report.complexity_report(
        metrics.summary_with_lines(rollup, lines), metrics.complexity_distribution(b.function_metrics),
        metrics.top_complex_files(rollup),
    )


_LABELS = {letter: label for letter, label, _ in COMPLEXITY_BINS}


@query(
    "a30_complexity_report",
    f"""
    SELECT s.repo_id, s.files_analyzed, round(s.average_complexity, 6) AS average_complexity, s.best_bin, t.top
    FROM (SELECT m.repo_id, count(*) AS files_analyzed, sum(total_complexity) / CAST(count(*) AS DOUBLE) AS average_complexity,
                 max(q.n) AS best_bin
          FROM ({FILE_ROLLUP}) m
          JOIN (SELECT repo_id, CAST(count_if(complexity <= 5) AS BIGINT) AS n FROM function_metrics GROUP BY repo_id) q
            ON q.repo_id = m.repo_id GROUP BY m.repo_id) s
    JOIN (SELECT repo_id, string_agg(path, ',' ORDER BY total_complexity DESC, path) AS top
          FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY total_complexity DESC, path) AS r FROM ({FILE_ROLLUP}))
          WHERE r <= 10 GROUP BY repo_id) t ON t.repo_id = s.repo_id""",
    ("function_metrics",),
)
def complexity_report(b: Bindings):
    return _complexity_block(b).select(
        "repo_id", "metrics.files_analyzed", rounded("metrics.average_complexity").alias("average_complexity"),
        F.col("complexity_distribution")[_LABELS["A"]].alias("best_bin"),
        F.array_join("top_complex_files.path", ",").alias("top"),
    )


@query("k1_report_document")
def report_document(b: Bindings):
    """The whole report of each repository as one JSON text. Blocks are written one by one, as their plans are large.

    Line counts, file metrics and the history, which the summary and a block of their own need, are written before them.
    """
    lines = stage(_lines(b), "lines")
    rollup = stage(metrics.file_metrics(b.function_metrics, lines), "file-metrics")
    whole = stage(whole_history(b), "history")
    scored = stage(scoring.scored(summary_row(b, lines, rollup, whole)), "summary")
    counts = issue_rows(b, scored).groupBy("repo_id").agg(
        F.count("*").alias("critical_issues"), F.count_if(F.col("severity") == "critical").alias("critical")
    )
    secrets = scoring.secrets_as_findings(findings.secret_findings(b.files))
    found = union_all([scanner_findings(b), type_findings(b), lint_findings(b), secrets])
    contracts = b.tool_logs.groupBy("repo_id", "language").agg(F.array_sort(F.collect_set("tool")).alias("tools_used"))
    document = report.report_document(
        scored,
        stage(_complexity_block(b, lines, rollup), "complexity"),
        stage(git_block(b, whole), "git"),
        metrics.report_languages(b.project_files.drop("text")),
        stage(counts, "issue-counts"),
        verification=[
            stage(report.verification_report(findings.issues_per_tool(found)), "verification"),
            report.contracts_report(contracts),
        ],
        claims=stage(verdicts.verdict_summary(judged(b)), "claim-summary"),
        details=report.finding_counts(findings.detailed_findings(b.function_metrics, scanner_findings(b))),
        advice=report.advice_list(scoring.recommendations(scored)),
    )
    return report.as_json(document)


@query("k2_markdown_report")
def markdown_report(b: Bindings):
    """All lines of all reports; ``report.sorted_report`` puts them in order."""
    scored = stage(scoring.scored(summary_row(b)), "summary")
    rollup = metrics.file_rollup(b.function_metrics)
    return report.markdown_report(
        scored,
        metrics.report_languages(b.project_files.drop("text")),
        metrics.complexity_distribution(b.function_metrics),
        metrics.top_complex_files(rollup),
        scoring.insights(scored.filter(F.col("has_history"))),
        issue_rows(b, scored),
        scoring.recommendations(scored),
    )


_BIN_LINES = " UNION ALL ".join(
    f"SELECT repo_id, {21 + i} AS ord, '{label}' AS metric, concat(count(*), ' functions') AS value "
    f"FROM function_metrics WHERE complexity > {lower} AND complexity <= {upper if upper else 1_000_000} GROUP BY repo_id"
    for i, ((_, label, upper), lower) in enumerate(
        zip(COMPLEXITY_BINS, [-1] + [upper for _, _, upper in COMPLEXITY_BINS[:-1]], strict=True)
    )
)


@query(
    "k3_console_summary",
    f"""
    SELECT repo_id, 0 AS ord, 'Files analyzed' AS metric, CAST(total_files AS VARCHAR) AS value FROM ({_SUMMARY})
    UNION ALL SELECT s.repo_id, 10, 'Total lines', CAST(coalesce(l.loc, 0) AS VARCHAR)
              FROM ({_SUMMARY}) s LEFT JOIN (SELECT repo_id, CAST(sum(loc) AS BIGINT) AS loc FROM ({LINE_METRICS}) GROUP BY repo_id) l
                ON l.repo_id = s.repo_id
    UNION ALL SELECT repo_id, 20, 'Average complexity', printf('%.2f', average_complexity) FROM ({_SUMMARY})
    UNION ALL SELECT repo_id, 30, 'Total tests', CAST(total_tests AS VARCHAR) FROM ({_SUMMARY}) WHERE total_tests > 0
    UNION ALL SELECT repo_id, 40, 'Passed', CAST(passed AS VARCHAR) FROM ({_SUMMARY}) WHERE total_tests > 0
    UNION ALL SELECT repo_id, 50, 'Failed', CAST(failed AS VARCHAR) FROM ({_SUMMARY}) WHERE total_tests > 0
    UNION ALL SELECT repo_id, 60, 'Success rate', concat(printf('%.1f', success_rate), '%') FROM ({_SUMMARY}) WHERE total_tests > 0
    UNION ALL SELECT repo_id, 70, 'No tests found', '' FROM ({_SUMMARY}) WHERE total_tests = 0
    UNION ALL SELECT repo_id, 80, 'Security issues found', CAST(security_issues AS VARCHAR) FROM ({_SUMMARY})
    UNION ALL SELECT repo_id, 100, 'Type checking issues', CAST(type_errors AS VARCHAR) FROM ({_SUMMARY}) WHERE type_errors > 0
    UNION ALL {_BIN_LINES}""",
    (*_VIEWS, "files", "source_docs"),
)
def console_summary(b: Bindings):
    return report.console_summary(scoring.scored(summary_row(b)), metrics.complexity_distribution(b.function_metrics))


