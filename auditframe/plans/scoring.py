"""Summary row, health score, issues, recommendations and insights.

Rules are rows: each is a condition that yields a struct or NULL, and one explode turns them into a
table. All of them read the one summary row of a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import classify
from auditframe.functions import fixed_values as fixed
from auditframe.operators.findings import as_findings, issues_per_tool, union_all
from auditframe.operators.grouping import By, join_groups
from auditframe.schemas import ISSUES

REPO = ("repo_id",)

# What a repository without the analysis counts as.
DEFAULTS = {
    "total_files": 0,
    "total_loc": 0,
    "average_complexity": 0.0,
    "high_complexity_functions": 0,
    "total_tests": 0,
    "passed": 0,
    "failed": 0,
    "skipped": 0,
    "success_rate": 0.0,
    "security_issues": 0,
    "secrets_found": 0,
    "type_errors": 0,
    "security_analyses": 0,
    "frameworks": 0,
    "under_commented_files": 0,
    "failed_claims": 0,
    "features": 0,
    "fixes": 0,
    "tests": 0,
    "breaking_changes": 0,
    "high_churn_files": 0,
    "outdated_docs": 0,
    "recent_features": 0,
    "repo_age_days": 365,
    "bus_factor": 3,
    "has_history": False,
    "has_ci": False,
    "has_versions": False,
    "follows_semver": False,
}


def combine(base: DataFrame, parts: list[DataFrame], by: By = REPO) -> DataFrame:
    """One row per repository from frames with at most one row each; gaps take their defaults."""
    for part in parts:
        base = join_groups(base, part, by)
    missing = {name: F.lit(value) for name, value in DEFAULTS.items() if name not in base.columns}
    return base.fillna({k: v for k, v in DEFAULTS.items() if k in base.columns}).withColumns(missing)


def high_complexity(functions: DataFrame, by: By = REPO) -> DataFrame:
    """Functions in the two worst bins."""
    rank = classify.complexity_rank(F.col("complexity"))
    return functions.groupBy(*by).agg(F.count_if(rank.isin("E", "F")).alias("high_complexity_functions"))


def findings_summary(findings: DataFrame, by: By = REPO) -> DataFrame:
    category, tool = F.col("category"), F.col("tool")
    return findings.groupBy(*by).agg(
        F.count_if((category == "security") & (tool != "secrets")).alias("security_issues"),
        F.count_if((category == "security") & (tool == "secrets")).alias("secrets_found"),
        F.count_if(category == "type_checking").alias("type_errors"),
        F.count_if(category == "security").alias("security_analyses"),
    )


def under_commented(lines: DataFrame, by: By = REPO) -> DataFrame:
    return lines.groupBy(*by).agg(F.count_if(F.col("under_commented")).alias("under_commented_files"))


# --- score and gate -------------------------------------------------------------------------------


def health_score(no_tests_penalty: float | None = None) -> Column:
    """0 to 100 from a summary row, in one fixed order of subtractions.

    Repositories without tests lose the full 30 points of the success rate; ``no_tests_penalty`` sets
    another price.
    """

    def capped(condition: Column, cap: float, points: Column) -> Column:
        return F.when(condition, F.least(F.lit(float(cap)), points.cast("double"))).otherwise(0.0)

    complexity, hard = F.col("average_complexity"), F.col("high_complexity_functions")
    security, bus = F.col("security_issues"), F.col("bus_factor")
    churn, age, history = F.col("high_churn_files"), F.col("repo_age_days"), F.col("has_history")
    tests = (F.lit(100.0) - F.col("success_rate")) * 0.3
    if no_tests_penalty is not None:
        tests = F.when(F.col("total_tests") == 0, F.lit(float(no_tests_penalty))).otherwise(tests)
    score = (
        F.lit(100.0)
        - capped(complexity > 10, 20, (complexity - 10) * 2)
        - capped(hard > 0, 15, hard * 3)
        - tests
        - capped(security > 0, 25, security * 2)
        - F.when(history & (age < 90), 5.0).otherwise(0.0)
        - capped(history & (bus < 3), 10, (3 - bus) * 5)
        - capped(history & (churn > 5), 10, churn)
    )
    return F.greatest(F.lit(0.0), score)


def scored(summary: DataFrame, no_tests_penalty: float | None = None) -> DataFrame:
    return summary.withColumns(
        {
            "health_score": health_score(no_tests_penalty),
            "gate_status": classify.gate_status(F.col("failed"), F.col("failed_claims")),
        }
    )


# --- rules ----------------------------------------------------------------------------------------


def _rules(summary: DataFrame, rules: list[tuple[Column, dict[str, Column]]], by: By) -> DataFrame:
    """One row per rule that holds."""
    structs = [
        F.when(condition, F.struct(*[value.alias(name) for name, value in values.items()]))
        for condition, values in rules
    ]
    return summary.select(*by, F.inline(F.array_compact(F.array(*structs))))


def _filled(text: str, number: Column | None = None) -> Column:
    if "{n}" not in text:
        return F.lit(text)
    before, after = text.split("{n}")
    return F.concat(F.lit(before), number.cast("string"), F.lit(after))


def _texts(names: tuple[str, ...], texts: tuple[str, ...], number: Column | None = None) -> dict[str, Column]:
    return {name: _filled(text, number) for name, text in zip(names, texts, strict=True)}


def recommendations(summary: DataFrame, by: By = REPO) -> DataFrame:
    history, frameworks, tests = F.col("has_history"), F.col("frameworks"), F.col("total_tests")
    age, bus, docs = F.col("repo_age_days"), F.col("bus_factor"), F.col("outdated_docs")
    conditions: dict[str, tuple[Column, Column | None]] = {
        "no_framework": (frameworks == 0, None),
        "few_tests": ((frameworks > 0) & (tests < 10), None),
        "complex_code": (F.col("average_complexity") > 15, None),
        "no_security": (F.col("security_analyses") == 0, None),
        "few_comments": (F.col("under_commented_files") > 5, None),
        "no_ci": (~F.col("has_ci"), None),
        "young": (history & (age < 90), age),
        "bus_factor": (history & (bus < 3), bus),
        "outdated_docs": (history & (docs > 3), docs),
    }
    names = ("category", "priority", "recommendation", "action")
    rules = [
        (condition, {"rule": F.lit(rule), **_texts(names, fixed.REPORT_ADVICE[rule], number)})
        for rule, (condition, number) in conditions.items()
    ]
    return _rules(summary, rules, by)


def insights(history: DataFrame, by: By = REPO) -> DataFrame:
    bus = F.col("bus_factor")
    conditions: dict[str, tuple[Column, Column | None]] = {
        "young": (F.col("repo_age_days") < 90, None),
        "fixes": (F.col("fixes") > F.col("features") * 2, None),
        "breaking": (F.col("breaking_changes") > 5, None),
        "outdated_docs": (F.col("outdated_docs") > 0, None),
        "bus_factor": (bus < 3, bus),
        "churn": (F.col("high_churn_files") > 5, None),
    }
    names = ("type", "category", "message")
    rules = [
        (condition, {"ord": F.lit(i), **_texts(names, fixed.INSIGHTS[rule], number)})
        for i, (rule, (condition, number)) in enumerate(conditions.items())
    ]
    return _rules(history, rules, by)


def verification_issues(history: DataFrame, by: By = REPO) -> DataFrame:
    """Issues the history alone shows. The ratio of features to tests is taken over at least one test."""
    features, tests = F.col("features"), F.col("tests")
    counts = F.concat(
        F.lit("Feature commits: "), features.cast("string"), F.lit(", Test commits: "), tests.cast("string")
    )
    names = ("severity", "type", "description")
    rules = [
        (
            features / F.greatest(tests, F.lit(1)) > 3,
            {
                **_texts(names, ("medium", "missing_tests", "Many features added without corresponding tests")),
                "evidence": counts,
            },
        ),
        (
            (F.col("recent_features") > 0) & (F.col("outdated_docs") > 0),
            _texts(
                (*names, "evidence"),
                (
                    "medium",
                    "outdated_documentation",
                    "Recent features may not be properly documented",
                    "Documentation hasn't been updated recently despite new features",
                ),
            ),
        ),
        (
            F.col("has_versions") & ~F.col("follows_semver"),
            _texts(
                (*names, "evidence"),
                (
                    "low",
                    "versioning_inconsistency",
                    "Version tags don't follow semantic versioning",
                    "Inconsistent version tag format detected",
                ),
            ),
        ),
    ]
    return _rules(history, rules, by)


# --- critical issues ------------------------------------------------------------------------------


def _issue(kind: str, severity: Column | str, location: Column, description: Column) -> dict[str, Column]:
    return {
        "type": F.lit(kind),
        "severity": F.lit(severity) if isinstance(severity, str) else severity,
        "location": location,
        "description": description,
        "recommendation": F.lit(fixed.ISSUE_ADVICE[kind]),
    }


def _issues(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    repo = F.col("repo_id") if "repo_id" in df.columns else F.lit(None)
    values = {"repo_id": repo, **values}
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in ISSUES.fields])


def _place(path: str, line: str) -> Column:
    return F.concat(F.col(path), F.lit(":"), F.coalesce(F.col(line).cast("string"), F.lit("unknown")))


def complexity_issues(functions: DataFrame, above: int = 20) -> DataFrame:
    complexity = F.col("complexity")
    description = F.concat(
        F.lit("Function '"), F.col("name"), F.lit("' has complexity "), complexity.cast("string"),
        F.lit(f" (threshold: {above})"),
    )
    return _issues(
        functions.filter(complexity > above),
        _issue("high_complexity", "high", _place("path", "lineno"), description),
    )


def security_issues(findings: DataFrame) -> DataFrame:
    severe = findings.filter(
        (F.col("category") == "security") & (F.col("tool") != "secrets") & classify.is_severe(F.col("severity"))
    )
    description = F.coalesce(F.col("message"), F.lit("Security issue detected"))
    return _issues(
        severe,
        _issue("security_vulnerability", F.lower("severity"), _place("path", "line"), description),
    )


def secret_issues(findings: DataFrame) -> DataFrame:
    secrets = findings.filter((F.col("category") == "security") & (F.col("tool") == "secrets"))
    description = F.concat(F.lit("Potential "), F.coalesce(F.col("kind"), F.lit("secret")), F.lit(" found"))
    return _issues(
        secrets,
        _issue("hardcoded_secret", "critical", F.coalesce(F.col("path"), F.lit("unknown")), description),
    )


def type_issues(findings: DataFrame, by: By = REPO) -> DataFrame:
    """One per type checker with errors."""
    per_tool = issues_per_tool(findings.filter(F.col("category") == "type_checking"), by)
    return _issues(
        per_tool,
        _issue(
            "type_errors",
            "medium",
            F.concat(F.col("tool"), F.lit(" type checking")),
            F.concat(F.col("total_issues").cast("string"), F.lit(" type errors found")),
        ),
    )


def summary_issues(summary: DataFrame, by: By = REPO) -> DataFrame:
    """Failing tests, a bus factor below two and outdated documentation."""
    failed, bus, docs, history = (F.col(c) for c in ("failed", "bus_factor", "outdated_docs", "has_history"))
    rules = [
        (
            failed > 0,
            _issue(
                "test_failures", "high", F.lit("test suite"), F.concat(failed.cast("string"), F.lit(" tests are failing"))
            ),
        ),
        (
            history & (bus < 2),
            _issue(
                "low_bus_factor",
                "high",
                F.lit("repository"),
                F.concat(F.lit("Low bus factor ("), bus.cast("string"), F.lit(") - over-reliance on few contributors")),
            ),
        ),
        (
            history & (docs > 0),
            _issue(
                "outdated_documentation",
                "medium",
                F.lit("documentation"),
                F.concat(docs.cast("string"), F.lit(" documentation files may be outdated")),
            ),
        ),
    ]
    found = _rules(summary, rules, by)
    return _issues(found, {f.name: F.col(f.name) for f in ISSUES.fields if f.name != "repo_id"})


def critical_issues(functions: DataFrame, findings: DataFrame, summary: DataFrame, by: By = REPO) -> DataFrame:
    """Everything that needs attention at once, in one schema. A bag union: nothing is shuffled for it."""
    return union_all(
        [
            complexity_issues(functions),
            security_issues(findings),
            secret_issues(findings),
            type_issues(findings, by),
            summary_issues(summary, by),
        ]
    )


def secrets_as_findings(secrets: DataFrame) -> DataFrame:
    return as_findings(secrets, "security", "secrets", path="path", kind="kind", message=F.col("matches").cast("string"))
