"""A: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.catalog.classifiers import LANGUAGE_CASES, RANK_CASES, category_sql
from auditframe.catalog.joins import CORRELATED_VIEWS, FILE_METRICS, RELATED, correlated, joined_file_metrics
from auditframe.catalog.registry import (
    AS_OF_COMMITS,
    AS_OF_FILES,
    lint_findings,
    query,
    rounded,
    scanner_findings,
    sql_method,
    sql_suffix,
    sql_verifiable,
    type_findings,
)
from auditframe.functions.fixed_values import (
    COMMIT_CATEGORY_WORDS,
    COMPLEXITY_BINS,
    EXCLUDED_PARTS,
    REVIEW_ADVICE,
    SEMVER,
    VERIFICATION_ADVICE,
)
from auditframe.operators import claims, correlate, discovery, findings, history, metrics, verdicts
from auditframe.operators.findings import union_all
from auditframe.session import stage
from auditframe.sources.bindings import Bindings
from auditframe.sources.files import documentation_files
from auditframe.sources.reports import junit_suites, lint_messages, test_summary

# --- languages and complexity ---------------------------------------------------------------------

_BOTH = "(SELECT repo_id, path FROM files UNION ALL SELECT repo_id, path FROM project_files)"
_EXCLUDED = "[" + ", ".join(f"'{p}'" for p in EXCLUDED_PARTS["census"]) + "]"
_LANGUAGE = f"CASE lower({sql_suffix('path')}) {LANGUAGE_CASES} END"
LANGUAGE_FILES = f"""
    SELECT repo_id, path, {_LANGUAGE} AS language FROM {_BOTH}
    WHERE {_LANGUAGE} IS NOT NULL AND NOT list_has_any(string_split(path, '/'), {_EXCLUDED})"""


def _paths(b: Bindings):
    return union_all([b.files.drop("text"), b.project_files.drop("text")])


@query(
    "a1_language_census",
    f"""
    SELECT repo_id, language, files, CAST(sum(files) OVER (PARTITION BY repo_id) AS BIGINT) AS total_files,
           round(files * 100.0 / sum(files) OVER (PARTITION BY repo_id), 6) AS percentage
    FROM (SELECT repo_id, language, count(*) AS files FROM ({LANGUAGE_FILES}) GROUP BY repo_id, language)""",
    ("files", "project_files"),
)
def language_census(b: Bindings):
    return metrics.language_census(_paths(b)).withColumn("percentage", rounded("percentage"))


@query(
    "a1_language_census_overall",
    f"""
    SELECT language, files, CAST(sum(files) OVER () AS BIGINT) AS total_files,
           round(files * 100.0 / sum(files) OVER (), 6) AS percentage
    FROM (SELECT language, count(*) AS files FROM ({LANGUAGE_FILES}) GROUP BY language)""",
    ("files", "project_files"),
)
def language_census_overall(b: Bindings):
    return metrics.language_census(_paths(b), by=()).withColumn("percentage", rounded("percentage"))


@query("a1_language_files", LANGUAGE_FILES, ("files", "project_files"))
def language_files(b: Bindings):
    return metrics.language_files(_paths(b))


@query(
    "a1_primary_language",
    f"""
    SELECT repo_id, CAST(sum(files) AS BIGINT) AS total_files, first(language ORDER BY files DESC, language) AS primary_language
    FROM (SELECT repo_id, language, count(*) AS files FROM ({LANGUAGE_FILES}) GROUP BY repo_id, language)
    GROUP BY repo_id""",
    ("files", "project_files"),
)
def primary_language(b: Bindings):
    return metrics.primary_language(_paths(b))


_BINS = ", ".join(f"('{letter}', '{label}')" for letter, label, _ in COMPLEXITY_BINS)


@query(
    "a2_complexity_distribution",
    f"""
    SELECT r.repo_id, bins.label AS bin, coalesce(n, 0) AS functions
    FROM (SELECT DISTINCT repo_id FROM function_metrics) r, (VALUES {_BINS}) AS bins(letter, label)
    LEFT JOIN (SELECT repo_id, {RANK_CASES} AS rank, count(*) AS n FROM function_metrics GROUP BY ALL) c
           ON c.repo_id = r.repo_id AND c.rank = bins.letter""",
    ("function_metrics",),
)
def complexity_distribution(b: Bindings):
    return metrics.complexity_distribution(b.function_metrics)


@query(
    "a3_complexity_summary",
    f"""
    SELECT repo_id, count(*) AS total_files, CAST(sum(total_complexity) AS BIGINT) AS total_complexity,
           CAST(coalesce(sum(loc), 0) AS BIGINT) AS total_loc,
           round(sum(total_complexity) / CAST(count(*) AS DOUBLE), 6) AS average_complexity
    FROM ({FILE_METRICS}) GROUP BY repo_id""",
    ("files", "source_docs"),
)
def complexity_summary(b: Bindings):
    return metrics.complexity_summary(joined_file_metrics(b)).withColumn("average_complexity", rounded("average_complexity"))


FILE_ROLLUP = """
    SELECT repo_id, path, count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total_complexity,
           round(avg(complexity), 6) AS average_complexity
    FROM function_metrics GROUP BY repo_id, path"""


@query("a3b_file_rollup", FILE_ROLLUP, ("function_metrics",))
def file_rollup(b: Bindings):
    return metrics.file_rollup(b.function_metrics).withColumn("average_complexity", rounded("average_complexity"))


# --- history --------------------------------------------------------------------------------------

RECENT = f"(SELECT * FROM commits WHERE ts >= TIMESTAMP '{AS_OF_COMMITS}' - INTERVAL 365 DAY)"
CATEGORY_COUNTS = (
    "SELECT repo_id, "
    + ", ".join(f"CAST(count_if({category_sql(n)}) AS BIGINT) AS {n}" for n in COMMIT_CATEGORY_WORDS)
    + f" FROM {RECENT} GROUP BY repo_id"
)


@query("a4_commit_category_counts", CATEGORY_COUNTS, ("commits",))
def commit_category_counts(b: Bindings):
    return history.commit_category_counts(history.recent_commits(b.commits, AS_OF_COMMITS))


@query(
    "a5_commits_per_month",
    f"SELECT repo_id, strftime(ts, '%Y-%m') AS month, count(*) AS commits FROM {RECENT} GROUP BY ALL",
    ("commits",),
)
def commits_per_month(b: Bindings):
    return history.commits_per_month(b.commits, AS_OF_COMMITS)


@query(
    "a5_commits_per_author",
    f"SELECT repo_id, author, count(*) AS commits FROM {RECENT} GROUP BY ALL",
    ("commits",),
)
def commits_per_author(b: Bindings):
    return history.commits_per_author(b.commits, AS_OF_COMMITS)


# Touched files have years of history: months have different sizes there.
@query(
    "a5_mean_commits_per_month",
    f"""
    SELECT repo_id, count(*) AS months, round(avg(n), 6) AS average_commits_per_month
    FROM (SELECT repo_id, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM commit_files
          WHERE ts >= TIMESTAMP '{AS_OF_FILES}' - INTERVAL 365 DAY GROUP BY ALL)
    GROUP BY repo_id""",
    ("commit_files",),
)
def mean_commits_per_month(b: Bindings):
    means = history.mean_commits_per_month(b.commit_files, AS_OF_FILES)
    return means.withColumn("average_commits_per_month", rounded("average_commits_per_month"))


_FEATURES = f"""
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, hash) AS rank FROM commits
    WHERE ts >= TIMESTAMP '{AS_OF_COMMITS}' - INTERVAL 1 YEAR AND regexp_matches(subject, '(?i)feat|add|implement')"""


@query(
    "a6_features_per_month",
    f"SELECT repo_id, strftime(ts, '%Y-%m') AS month, count(*) AS features FROM ({_FEATURES}) WHERE rank <= 50 GROUP BY ALL",
    ("commits",),
)
def features_per_month(b: Bindings):
    return history.features_per_month(b.commits, AS_OF_COMMITS, newest=50)


_YEAR = f"ts >= TIMESTAMP '{AS_OF_FILES}' - INTERVAL 1 YEAR"
_HALF_YEAR = f"ts >= TIMESTAMP '{AS_OF_FILES}' - INTERVAL 6 MONTH"
FILE_CHANGES = f"SELECT repo_id, path, count(*) AS changes FROM commit_files WHERE {_YEAR} AND path <> '' GROUP BY repo_id, path"
FILE_CHURN = (
    f"SELECT repo_id, path, count(*) AS changes FROM commit_files WHERE {_HALF_YEAR} AND path <> '' "
    "AND NOT starts_with(path, '.') GROUP BY repo_id, path"
)


@query("a7_file_changes", FILE_CHANGES, ("commit_files",))
def file_changes(b: Bindings):
    return history.file_changes(b.commit_files, AS_OF_FILES)


@query("a7_file_churn", FILE_CHURN, ("commit_files",))
def file_churn(b: Bindings):
    return history.file_churn(b.commit_files, AS_OF_FILES)


@query(
    "a7_files_changed",
    f"SELECT repo_id, count(*) AS total_files_changed FROM ({FILE_CHANGES}) GROUP BY repo_id",
    ("commit_files",),
)
def files_changed(b: Bindings):
    return history.files_changed(b.commit_files, AS_OF_FILES)


CONTRIBUTORS = f"""
    SELECT repo_id, author, CASE WHEN sum(recent) OVER (PARTITION BY repo_id) > 0 THEN recent ELSE ever END AS commits
    FROM (SELECT repo_id, author, CAST(count_if(late >= TIMESTAMP '2025-12-01') AS BIGINT) AS recent, count(*) AS ever
          FROM (SELECT *, CASE WHEN CAST(hash AS BIGINT) % 2 = 0 AND repo_id IN ('src0', 'src2', 'src4')
                               THEN ts + INTERVAL 2 YEAR ELSE ts END AS late FROM commits)
          GROUP BY repo_id, author)"""


def late_commits(b: Bindings):
    late = (F.col("hash").cast("bigint") % 2 == 0) & F.col("repo_id").isin("src0", "src2", "src4")
    moved = F.when(late, F.col("ts") + F.make_interval(years=F.lit(2))).otherwise(F.col("ts"))
    return b.commits.withColumn("ts", moved)


@query("a8_contributors", f"SELECT * FROM ({CONTRIBUTORS}) WHERE commits > 0", ("commits",))
def contributors(b: Bindings):
    """Some repositories have commits in the year before ``as_of``, the others fall back to all time."""
    return history.contributors(late_commits(b), "2026-12-01")


@query(
    "a8_top_contributors",
    f"""
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, author) AS INT) AS rank
                   FROM ({CONTRIBUTORS}) WHERE commits > 0) WHERE rank <= 20""",
    ("commits",),
)
def top_contributors(b: Bindings):
    return history.top_contributors(late_commits(b), "2026-12-01")


def _bus(authors: str, by: str) -> str:
    over = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {by + ',' if by else ''} count(*) AS total_contributors,
           CAST(count_if(commits / CAST(total AS DOUBLE) > 0.1) AS BIGINT) AS bus_factor
    FROM (SELECT *, sum(commits) OVER ({over}) AS total FROM ({authors})) {group}"""


@query("a9_bus_factor", _bus("SELECT repo_id, author, count(*) AS commits FROM commits GROUP BY ALL", "repo_id"), ("commits",))
def bus_factor(b: Bindings):
    return history.bus_factor(history.contributors(b.commits, AS_OF_COMMITS))


@query("a9_bus_factor_overall", _bus("SELECT author, count(*) AS commits FROM commits GROUP BY ALL", ""), ("commits",))
def bus_factor_overall(b: Bindings):
    return history.bus_factor(history.contributors(b.commits, AS_OF_COMMITS, by=()), by=())


@query(
    "a9_bus_factor_by_priority",
    _bus("SELECT o_orderpriority AS repo_id, o_custkey AS author, count(*) AS commits FROM orders GROUP BY ALL", "repo_id"),
)
def bus_factor_by_priority(b: Bindings):
    authors = b.orders.groupBy(F.col("o_orderpriority").alias("repo_id"), F.col("o_custkey").alias("author")).agg(
        F.count("*").alias("commits")
    )
    return history.bus_factor(authors)


REPOSITORY_INFO = """
    SELECT repo_id, CAST(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400) AS BIGINT) AS repo_age_days,
           strftime(min(ts), '%Y-%m-%dT%H:%M:%S+00:00') AS first_commit_date,
           strftime(max(ts), '%Y-%m-%dT%H:%M:%S+00:00') AS last_commit_date, count(*) AS total_commits
    FROM commits GROUP BY repo_id"""


@query("a10_repository_info", REPOSITORY_INFO, ("commits",))
def repository_info(b: Bindings):
    return history.repository_info(b.commits)


_VERSION_KEY = r"""
    array_to_string(list_transform(regexp_extract_all(tag, '[0-9]+|[^0-9]+'),
        lambda x: CASE WHEN regexp_matches(x, '^[0-9]')
                       THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\1')) AS VARCHAR), 4, '0')
                            || regexp_replace(x, '^0+([0-9])', '\1') ELSE x END), '')"""
VERSION_STATS = f"""
    SELECT repo_id, true AS has_versions, count(*) AS total_versions, arg_max(tag, {_VERSION_KEY}) AS latest_version,
           avg(CAST(regexp_matches(tag, '{SEMVER}') AS INT)) > 0.8 AS follows_semver
    FROM tags GROUP BY repo_id"""


@query("a11_version_stats", VERSION_STATS, ("tags",))
def version_stats(b: Bindings):
    return history.version_stats(b.tags)


# --- claims ---------------------------------------------------------------------------------------

JUDGED_CLAIMS = f"""
    SELECT c.*, coalesce(r.related, 0) AS related, {sql_method('c.claim_type')} AS verification_method,
           {sql_verifiable('c.claim_type', 'r.related')} AS verifiable
    FROM claims c LEFT JOIN ({RELATED}) r ON r.repo_id = c.repo_id AND r.claim_id = c.claim_id"""
_BENCHMARKS = """
    SELECT repo_id, coalesce(min(CASE WHEN contains(name, 'benchmark') THEN path END),
                             min(CASE WHEN contains(name, 'perf') THEN path END),
                             min(CASE WHEN contains(name, 'bench') THEN path END)) AS benchmark_file
    FROM (SELECT repo_id, path, regexp_extract(path, '[^/]*$') AS name FROM project_files) GROUP BY repo_id"""
VERDICTS = f"""
    SELECT j.repo_id, claim_id, claim_type, verifiable, related,
           CASE WHEN verification_method = 'unit_test' AND related > 0 THEN 'verified'
                WHEN verification_method = 'unit_test' THEN 'failed' ELSE 'inconclusive' END AS status,
           CAST(CASE verification_method WHEN 'unit_test' THEN CASE WHEN related > 0 THEN 0.8 ELSE 0.9 END
                WHEN 'benchmark' THEN CASE WHEN benchmark_file IS NOT NULL THEN 0.5 ELSE 0.3 END
                WHEN 'security_test' THEN 0.4 ELSE CASE WHEN related > 0 THEN 0.5 ELSE 0.2 END END AS DOUBLE) AS confidence,
           CASE verification_method
                WHEN 'unit_test' THEN CASE WHEN related > 0 THEN concat('Found implementation in ', related, ' files')
                                           ELSE 'No implementation found for claimed API' END
                WHEN 'benchmark' THEN CASE WHEN benchmark_file IS NOT NULL THEN concat('Found potential benchmark: ', benchmark_file)
                                           ELSE 'No benchmarks found to verify performance claim' END
                WHEN 'security_test' THEN 'Security verification requires dedicated security analysis'
                ELSE CASE WHEN related > 0 THEN concat('Found related code in ', related, ' files')
                          ELSE 'Unable to automatically verify this claim' END END AS evidence
    FROM ({JUDGED_CLAIMS}) j LEFT JOIN ({_BENCHMARKS}) b ON b.repo_id = j.repo_id"""
JUDGED_VIEWS = (*CORRELATED_VIEWS, "project_files")


def judged(b: Bindings):
    return verdicts.verdicts(verdicts.with_strategy(correlated(b)), b.project_files.drop("text"))


@query("a12_verdicts", VERDICTS, JUDGED_VIEWS)
def claim_verdicts(b: Bindings):
    return judged(b).select(
        "repo_id", "claim_id", "claim_type", "verifiable", "related", "status",
        F.col("verdict_confidence").alias("confidence"), "evidence",
    )


@query(
    "p15_gate_status",
    f"""
    SELECT r.repo_id, t.failed AS failed_tests, coalesce(c.failed, 0) AS failed_claims,
           CAST(CASE WHEN coalesce(t.failed, 0) > 0 THEN 1 WHEN coalesce(c.failed, 0) > 0 THEN 2 ELSE 0 END AS INT)
               AS gate_status
    FROM (SELECT DISTINCT repo_id FROM files) r
    LEFT JOIN (SELECT repo_id, CAST(sum(failed) AS BIGINT) AS failed FROM stdout_counts GROUP BY repo_id) t
           ON r.repo_id = t.repo_id
    LEFT JOIN (SELECT repo_id, count(*) AS failed FROM ({VERDICTS}) WHERE status = 'failed' GROUP BY repo_id) c
           ON r.repo_id = c.repo_id""",
    ("stdout_counts", *JUDGED_VIEWS),
)
def gate_status(b: Bindings):
    return verdicts.gate(b.files.select("repo_id").distinct(), findings.test_totals(test_summary(b.test_runs)), judged(b))


@query(
    "p15_gate_of_packages",
    """
    SELECT r.repo_id, t.failed AS failed_tests, coalesce(c.failed, 0) AS failed_claims,
           CAST(CASE WHEN coalesce(t.failed, 0) > 0 THEN 1 WHEN coalesce(c.failed, 0) > 0 THEN 2 ELSE 0 END AS INT)
               AS gate_status
    FROM (SELECT DISTINCT repo_id FROM package_docs) r
    LEFT JOIN (SELECT repo_id, CAST(sum(coalesce(TRY_CAST(regexp_extract(stdout, '([0-9]+) failed', 1) AS BIGINT), 0)) AS BIGINT)
                      AS failed FROM package_tests GROUP BY repo_id) t ON r.repo_id = t.repo_id
    LEFT JOIN (SELECT p.repo_id, count(*) AS failed FROM package_claims p
               WHERE p.claim_type = 'api' AND NOT EXISTS (
                   SELECT 1 FROM package_symbols s WHERE s.repo_id = p.repo_id
                     AND list_contains(regexp_extract_all(p.text, '[A-Za-z0-9_]+'), s.symbol))
               GROUP BY p.repo_id) c ON r.repo_id = c.repo_id""",
    ("package_docs", "package_tests", "package_claims", "package_symbols"),
)
def gate_of_packages(b: Bindings):
    """Packages of which some document functions that no code has: the gate's third status."""
    found = claims.extract_claims(b.package_docs.withColumnRenamed("claim_id", "line_id"))
    found = claims.with_claim_id(found, ["line_id", "claim_type", "pattern_no", "match_no"])
    related = correlate.correlate(found, b.package_code)
    verdict = verdicts.verdicts(verdicts.with_strategy(related), b.package_code.drop("text"))
    return verdicts.gate(b.package_docs.select("repo_id").distinct(), findings.test_totals(test_summary(b.package_tests)), verdict)


@query(
    "a13_verdict_summary",
    f"""
    SELECT repo_id, count(*) AS total_claims, CAST(count_if(status = 'verified') AS BIGINT) AS verified,
           CAST(count_if(status = 'failed') AS BIGINT) AS failed,
           CAST(count_if(status = 'inconclusive') AS BIGINT) AS inconclusive,
           round(count_if(status = 'verified') * 100.0 / count(*), 6) AS verification_rate
    FROM ({VERDICTS}) GROUP BY repo_id""",
    JUDGED_VIEWS,
)
def verdict_summary(b: Bindings):
    return verdicts.verdict_summary(judged(b)).withColumn("verification_rate", rounded("verification_rate"))


@query(
    "a14_claim_summary",
    f"""
    SELECT s.*, coalesce(d.n, 0) AS documentation_files, coalesce(f.n, 0) AS code_references_found
    FROM (SELECT repo_id, count(*) AS total_claims, CAST(count_if(verifiable) AS BIGINT) AS verifiable_claims,
                 round(count_if(verifiable) * 100.0 / count(*), 6) AS verification_rate,
                 CAST(count_if(confidence >= 0.7) AS BIGINT) AS high_confidence_claims
          FROM ({JUDGED_CLAIMS}) GROUP BY repo_id) s
    LEFT JOIN (SELECT repo_id, count(*) AS n FROM markdown_docs GROUP BY repo_id) d ON d.repo_id = s.repo_id
    LEFT JOIN (SELECT repo_id, 4 * count(*) AS n FROM markdown_docs GROUP BY repo_id) f ON f.repo_id = s.repo_id""",
    (*CORRELATED_VIEWS, "markdown_docs"),
)
def claim_summary(b: Bindings):
    summary = verdicts.documentation_summary(
        verdicts.with_strategy(correlated(b)),
        documentation_files(b.markdown_docs.drop("text")),
        claims.code_references(b.markdown_docs),
    )
    return summary.withColumn("verification_rate", rounded("verification_rate"))


def _claims_by(group: str) -> str:
    return f"""
    SELECT repo_id, {group}, count(*) AS claims, CAST(count_if(verifiable) AS BIGINT) AS verifiable_claims,
           round(avg(confidence), 6) AS average_confidence
    FROM ({JUDGED_CLAIMS}) GROUP BY repo_id, {group}"""


def _with_strategy(b: Bindings):
    return verdicts.with_strategy(correlated(b))


@query("a15_claims_by_type", _claims_by("claim_type"), CORRELATED_VIEWS)
def claims_by_type(b: Bindings):
    grouped = verdicts.claims_by(_with_strategy(b), "claim_type")
    return grouped.withColumn("average_confidence", rounded("average_confidence"))


@query("a15_claims_by_source", _claims_by("line_id"), CORRELATED_VIEWS)
def claims_by_source(b: Bindings):
    grouped = verdicts.claims_by(_with_strategy(b), "line_id")
    return grouped.withColumn("average_confidence", rounded("average_confidence"))


def _advice_sql() -> str:
    cases = {**VERIFICATION_ADVICE, "review": REVIEW_ADVICE}

    def pick(position: int) -> str:
        return "CASE advice " + " ".join(
            f"WHEN '{m}' THEN '{texts[position].replace(chr(39), chr(39) * 2)}'" for m, texts in cases.items()
        ) + " END"

    methods = ", ".join(f"'{m}'" for m in VERIFICATION_ADVICE)
    return f"""
    SELECT repo_id, {pick(0)} AS type, {pick(1)} AS priority, concat({pick(2)}, n, {pick(3)}) AS description,
           examples, {pick(4)} AS suggested_approach
    FROM (SELECT repo_id, advice, count(*) AS n, string_agg(text, ' | ' ORDER BY r) FILTER (r <= 3) AS examples
          FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, advice
                                             ORDER BY line_id, claim_type, pattern_no, match_no) AS r
                FROM (SELECT *, CASE WHEN NOT verifiable THEN 'review'
                                     WHEN verification_method IN ({methods}) THEN verification_method END AS advice
                      FROM ({JUDGED_CLAIMS})) WHERE advice IS NOT NULL)
          GROUP BY repo_id, advice)"""


@query("a16_verification_recommendations", _advice_sql(), CORRELATED_VIEWS)
def verification_recommendations(b: Bindings):
    order = ["line_id", "claim_type", "pattern_no", "match_no"]
    claims_of_lines = stage(verdicts.with_strategy(correlated(b)), "correlated")
    advised = verdicts.verification_recommendations(claims_of_lines, order)
    return advised.withColumn("examples", F.array_join("examples", " | "))


# --- tests and findings ---------------------------------------------------------------------------

TEST_TOTALS = """
    SELECT repo_id, CAST(sum(total) AS BIGINT) AS total_tests, CAST(sum(passed) AS BIGINT) AS passed,
           CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(skipped) AS BIGINT) AS skipped,
           coalesce(sum(passed) / CAST(nullif(sum(total), 0) AS DOUBLE), 0) * 100 AS success_rate,
           string_agg(DISTINCT language || '_' || framework, ',' ORDER BY language || '_' || framework) AS frameworks_used
    FROM stdout_counts GROUP BY repo_id"""


@query(
    "a17_test_totals",
    f"SELECT * REPLACE (round(success_rate, 6) AS success_rate) FROM ({TEST_TOTALS})",
    ("stdout_counts",),
)
def test_totals(b: Bindings):
    totals = findings.test_totals(test_summary(b.test_runs))
    return totals.withColumns(
        {"success_rate": rounded("success_rate"), "frameworks_used": F.array_join("frameworks_used", ",")}
    )


@query(
    "a18_junit_rollup",
    r"""
    SELECT repo_id, count(*) AS suites, CAST(sum(tests) AS BIGINT) AS total,
           CAST(sum(tests - failures - errors - skipped) AS BIGINT) AS passed, CAST(sum(failures) AS BIGINT) AS failed,
           CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(errors) AS BIGINT) AS errors, round(sum(time), 6) AS time
    FROM (SELECT repo_id, coalesce(TRY_CAST(regexp_extract(tag, ' tests="([0-9]+)"', 1) AS INT), 0) AS tests,
                 coalesce(TRY_CAST(regexp_extract(tag, ' failures="([0-9]+)"', 1) AS INT), 0) AS failures,
                 coalesce(TRY_CAST(regexp_extract(tag, ' errors="([0-9]+)"', 1) AS INT), 0) AS errors,
                 coalesce(TRY_CAST(regexp_extract(tag, ' skipped="([0-9]+)"', 1) AS INT), 0) AS skipped,
                 coalesce(TRY_CAST(regexp_extract(tag, ' time="([0-9.]+)"', 1) AS DOUBLE), 0) AS time
          FROM (SELECT repo_id, unnest(regexp_extract_all(xml, '<testsuite [^>]*>')) AS tag FROM junit_reports))
    GROUP BY repo_id""",
    ("junit_reports",),
)
def junit_rollup(b: Bindings):
    return findings.junit_rollup(junit_suites(b.junit_reports)).withColumn("time", rounded("time"))


@query(
    "a19_messages_by_type",
    """
    SELECT repo_id, type, count(*) AS issues
    FROM (SELECT repo_id, coalesce(json_extract_string(m, '$.type'), 'unknown') AS type
          FROM (SELECT repo_id, unnest(CAST(report AS JSON[])) AS m FROM lint_reports WHERE json_valid(report)))
    GROUP BY repo_id, type""",
    ("lint_reports",),
)
def messages_by_type(b: Bindings):
    return findings.messages_by_type(lint_messages(b.lint_reports))


STATIC_COUNTS = """
    SELECT repo_id, 'security' AS category, 'bandit' AS tool FROM function_findings
    UNION ALL
    SELECT repo_id, 'linting', 'pylint'
    FROM (SELECT repo_id, unnest(CAST(report AS JSON[])) AS m FROM lint_reports WHERE json_valid(report))
    UNION ALL
    SELECT repo_id, 'type_checking', 'mypy'
    FROM (SELECT repo_id, unnest(string_split(stdout, chr(10))) AS line FROM type_logs)
    WHERE regexp_matches(line, '^[^:]*:[^:]*:[^:]*:')"""
STATIC_VIEWS = ("function_findings", "lint_reports", "type_logs")


def static_findings(b: Bindings):
    return union_all([scanner_findings(b), lint_findings(b), type_findings(b)])


@query(
    "a20_static_issue_total",
    f"SELECT repo_id, count(*) AS total_issues FROM ({STATIC_COUNTS}) GROUP BY repo_id",
    STATIC_VIEWS,
)
def static_issue_total(b: Bindings):
    return findings.static_issue_total(static_findings(b))


@query(
    "a20_issues_per_tool",
    f"SELECT repo_id, category, tool, count(*) AS total_issues FROM ({STATIC_COUNTS}) GROUP BY ALL",
    STATIC_VIEWS,
)
def issues_per_tool(b: Bindings):
    return findings.issues_per_tool(static_findings(b))


@query(
    "a21_checks_per_language",
    """
    SELECT repo_id, language, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools_used,
           count(DISTINCT path) AS files_analyzed, count(*) AS checks
    FROM tool_logs GROUP BY repo_id, language""",
    ("tool_logs",),
)
def checks_per_language(b: Bindings):
    return findings.checks_per_language(b.tool_logs).withColumn("tools_used", F.array_join("tools_used", ","))


@query(
    "a22_coverage_artifacts",
    """
    SELECT repo_id, language, pattern, file, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, language, pattern ORDER BY file) AS INT) AS rank FROM (
            SELECT DISTINCT repo_id, 'python' AS language, 'coverage.xml' AS pattern, path AS file FROM project_files
            WHERE regexp_matches(path, '(^|/)coverage\\.xml$')
            UNION ALL
            SELECT DISTINCT repo_id, 'python', 'htmlcov/', regexp_extract(path, '^(.*htmlcov)/', 1) FROM project_files
            WHERE contains(path, '/htmlcov/')
            UNION ALL
            SELECT DISTINCT repo_id, 'csharp', 'TestResults/*/coverage.cobertura.xml', path FROM project_files
            WHERE regexp_matches(path, '(^|/)TestResults/[^/]*/coverage\\.cobertura\\.xml$')))
    WHERE rank <= 5""",
    ("project_files",),
)
def coverage_artifacts(b: Bindings):
    return discovery.coverage_artifacts(b.project_files.drop("text"))


@query(
    "a23_detailed_findings",
    f"""
    SELECT repo_id, 'complexity' AS category, path, lineno AS line, name AS kind, {RANK_CASES} AS severity,
           CAST(complexity AS VARCHAR) AS message
    FROM function_metrics WHERE complexity > 10
    UNION ALL
    SELECT repo_id, 'security', path, line, NULL, severity, message FROM function_findings""",
    ("function_metrics", "function_findings"),
)
def detailed_findings(b: Bindings):
    found = findings.detailed_findings(b.function_metrics, scanner_findings(b))
    return found.select("repo_id", "category", "path", "line", "kind", "severity", "message")


@query(
    "a29_has_ci",
    """
    SELECT repo_id, bool_or(starts_with(path, '.github/workflows/')) AS has_ci
    FROM (SELECT repo_id, path FROM project_files UNION ALL SELECT repo_id, path FROM files) GROUP BY repo_id""",
    ("project_files", "files"),
)
def has_ci(b: Bindings):
    return discovery.has_ci(_paths(b))
