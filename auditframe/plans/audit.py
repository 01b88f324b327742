"""A whole audit: tables in, result tables out."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.redact import redact_frame
from auditframe.operators import claims as claims_of
from auditframe.operators import correlate, discovery, findings, history, metrics, verdicts
from auditframe.operators.facts import CODE_FACTS, file_facts
from auditframe.operators.grouping import By
from auditframe.plans import report, scoring
from auditframe.schemas import named
from auditframe.session import deal, pin_utc, stage
from auditframe.sources.files import documentation_files
from auditframe.sources.reports import test_summary

REPO = ("repo_id",)


def correlated_claims(claims: DataFrame, files: DataFrame, by: By = REPO) -> DataFrame:
    """Claims with the number of their related files, for callers that have written neither claims nor facts.

    Both are written first, so the tables behind them are read once, whatever the correlation asks of them.
    """
    facts = stage(file_facts(files, CODE_FACTS), "code-facts")
    return correlate.correlate(stage(claims, "claims"), facts, files, by)


def claims_of_facts(facts: DataFrame, by: By = REPO) -> DataFrame:
    """Claims with their identifiers from a table of facts, made by as many tasks as a shuffle has.

    Documentation is a small part of the bytes of the facts but holds all claims, so splits by bytes leave these, and
    whatever explodes them later, to one or two tasks. Their files are dealt out before the claims become rows.
    """
    told = facts.select(*by, "path", "claims").filter(F.size("claims") > 0)
    return claims_of.with_claim_id(claims_of.all_claims(deal(told), by))


@dataclass
class AuditTables:
    """Input tables. ``tool_findings`` has the findings schema; it and ``test_runs`` may be missing."""

    files: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    tags: DataFrame
    function_metrics: DataFrame
    test_runs: DataFrame
    tool_findings: DataFrame | None = None


def audit(
    tables: AuditTables, as_of: str, level: str | None = "medium", by: By = REPO, files_as_of: str | None = None
) -> dict[str, DataFrame]:
    """All result tables, with texts redacted at ``level`` (``None`` leaves them as they are).

    The texts are read once, for all facts of a file, which are written to the checkpoint folder as everything else
    derives from them; only files that may hold a keyword of more than 32 characters are looked at again. Claims are
    written before they are correlated, and once more with their verdicts, since statistics and advice need those.
    ``files_as_of`` is the "now" of the touched files where it differs.
    """
    pin_utc(tables.files.sparkSession)
    given = {f.name: getattr(tables, f.name) for f in fields(tables)}
    tables = AuditTables(**{name: df if df is None else named(df) for name, df in given.items()})
    facts = stage(file_facts(tables.files), "file-facts")
    names = tables.files.drop("text")

    # Claims and what stands behind them.
    claims = stage(claims_of_facts(facts, by), "claims")
    related = correlate.correlate(claims, facts, tables.files, by)
    judged = stage(verdicts.verdicts(verdicts.with_strategy(related), names, by), "verdicts")
    references = claims_of.code_references(facts, by)
    claim_totals = verdicts.verdict_summary(judged, by)

    # Findings of our own scanners and of the tools.
    lint = findings.as_findings(
        findings.lint_lines(facts, by), "python", "line_lint", path="path", line="line", kind="kind", message="message"
    )
    found = [scoring.secrets_as_findings(findings.secret_findings(facts, by)), lint]
    if tables.tool_findings is not None:
        found.append(tables.tool_findings)
    all_findings = findings.union_all(found)

    # Metrics, tests, history.
    lines = metrics.line_metrics(facts, by)
    file_metrics = metrics.file_metrics(tables.function_metrics, lines, by)
    complexity = metrics.summary_with_lines(file_metrics, lines, by)
    distribution = metrics.complexity_distribution(tables.function_metrics, by)
    top_files = metrics.top_complex_files(file_metrics, by=by)
    runs = test_summary(tables.test_runs)
    git = history.history_summary(tables.commits, tables.commit_files, tables.tags, as_of, by, files_as_of)
    languages = metrics.report_languages(names, by)

    repositories = names.select(*by).distinct() if by else complexity
    summary = scoring.combine(
        repositories,
        [
            complexity if by else complexity.select(),
            scoring.high_complexity(tables.function_metrics, by),
            scoring.under_commented(lines, by),
            scoring.findings_summary(all_findings, by),
            findings.test_totals(runs, by).drop("frameworks_used"),
            discovery.detected_frameworks(tables.files, by)
            .groupBy(*by)
            .agg(F.count("*").alias("frameworks")),
            discovery.has_ci(names, by),
            claim_totals.select(*by, F.col("failed").alias("failed_claims")),
            git.select(
                *by, "repo_age_days", "bus_factor", "high_churn_files", "outdated_docs", "features", "fixes",
                "tests", "breaking_changes", "recent_features", "has_versions", "follows_semver",
                F.lit(True).alias("has_history"),
            ),
        ],
        by,
    )
    # An audit scans every repository for secrets, so a clean one counts as analysed too.
    summary = summary.withColumn("security_analyses", F.greatest(F.col("security_analyses"), F.lit(1)))
    scored = stage(scoring.scored(summary), "summary")
    issues = scoring.critical_issues(tables.function_metrics, all_findings, scored, by)
    advice = scoring.recommendations(scored, by)
    told = scoring.insights(scored.filter(F.col("has_history")), by)

    counts = issues.groupBy(*by).agg(
        F.count("*").alias("critical_issues"), F.count_if(F.col("severity") == "critical").alias("critical")
    )
    document = report.report_document(
        scored,
        report.complexity_report(complexity, distribution, top_files, by),
        report.git_report(git, history.top_contributors(tables.commits, as_of, by=by), told, by),
        languages,
        counts,
        by,
        [report.verification_report(findings.issues_per_tool(all_findings, by), by)],
        claim_totals,
        report.finding_counts(findings.detailed_findings(tables.function_metrics, all_findings), by),
        report.advice_list(advice, by),
    )

    results = {
        "summary": scored,
        "document": document,
        "claims": judged,
        "claim_summary": verdicts.documentation_summary(judged, documentation_files(names), references, by),
        "verdict_summary": claim_totals,
        "verification_recommendations": verdicts.verification_recommendations(judged, claims_of.CLAIM_ORDER, by=by),
        "code_references": references,
        "language_census": metrics.language_census(names, by),
        "file_metrics": file_metrics,
        "complexity_distribution": distribution,
        "findings": all_findings,
        "history": git,
        "insights": told,
        "verification_issues": scoring.verification_issues(git, by),
        "issues": issues,
        "recommendations": advice,
        "test_frameworks": discovery.test_frameworks(tables.files, by=by),
        "coverage": discovery.coverage_artifacts(names, by=by),
        "console": report.console_summary(scored, distribution, by),
        "markdown": report.markdown_report(scored, languages, distribution, top_files, told, issues, advice, by),
    }
    return {name: redact_frame(df, level, keys=by) for name, df in results.items()} if level else results
