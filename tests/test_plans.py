"""Scores, rules, reports, plans, streams and whole audits."""

from __future__ import annotations

import json
import uuid

import pytest
from samples import PYTHON_MAIN, README
from pyspark.sql import functions as F

from auditframe.functions import classify
from auditframe.operators import correlate, findings, history, metrics
from auditframe.operators.facts import file_facts
from auditframe.operators.grouping import top_k, with_total
from auditframe.plans import report, scoring
from auditframe.plans.audit import AuditTables, audit
from auditframe.schemas import COMMITS, FINDINGS, FUNCTION_METRICS, TAGS, TEST_RUNS
from auditframe.session import checkpoint_folder, stage
from auditframe.streaming import continuous


def summary(spark, **values):
    base = spark.createDataFrame([("r",)], "repo_id string")
    return scoring.combine(base.select("repo_id", *[F.lit(v).alias(k) for k, v in values.items()]), [])


def score(spark, **values):
    penalty = values.pop("no_tests_penalty", None)
    return scoring.scored(summary(spark, **values), penalty).first()["health_score"]


def test_health_score(spark):
    assert score(spark, success_rate=100.0) == 100.0
    assert score(spark) == 70.0
    assert score(spark, total_tests=0, no_tests_penalty=20) == 80.0
    reference = dict(average_complexity=8.5, total_tests=20, success_rate=90.0, security_issues=1)
    assert score(spark, **reference) == pytest.approx(95.0)
    worst = dict(
        average_complexity=99.0, high_complexity_functions=9, security_issues=50, has_history=True, repo_age_days=1,
        bus_factor=0, high_churn_files=30,
    )
    assert score(spark, **worst) == 0.0
    assert score(spark, success_rate=100.0, average_complexity=12.5) == 95.0
    assert score(spark, success_rate=100.0, has_history=True, bus_factor=2, repo_age_days=89, high_churn_files=6) == 84.0


def test_gate(spark):
    df = spark.createDataFrame([(1, 5), (0, 2), (0, 0), (None, None)], "t int, c int")
    got = [r["g"] for r in df.select(classify.gate_status(F.col("t"), F.col("c")).alias("g")).collect()]
    assert got == [1, 2, 0, 0]


@pytest.fixture
def issue_input(spark):
    functions = spark.createDataFrame([("r", "main.py", "f", 10, 21), ("r", "main.py", "g", 20, 20)], FUNCTION_METRICS)
    rows = [
        ("r", "security", "bandit", "test.py", 5, None, None, "HIGH", "HIGH", "Hardcoded password", "B105"),
        ("r", "security", "bandit", "test.py", 6, None, None, "LOW", "HIGH", "x", "B1"),
        ("r", "security", "secrets", "config.py", None, None, "api_key", None, None, "1", None),
        ("r", "type_checking", "mypy", "a.py", 1, None, "error", None, None, "m", None),
        ("r", "type_checking", "mypy", "a.py", 2, None, "error", None, None, "m", None),
    ]
    return functions, spark.createDataFrame(rows, FINDINGS)


def test_critical_issues(spark, issue_input):
    functions, found = issue_input
    rows = summary(spark, failed=2, has_history=True, bus_factor=1, outdated_docs=1)
    issues = {(r["type"], r["severity"], r["location"], r["description"]) for r in scoring.critical_issues(functions, found, rows).collect()}
    assert issues == {
        ("high_complexity", "high", "main.py:10", "Function 'f' has complexity 21 (threshold: 20)"),
        ("security_vulnerability", "high", "test.py:5", "Hardcoded password"),
        ("hardcoded_secret", "critical", "config.py", "Potential api_key found"),
        ("type_errors", "medium", "mypy type checking", "2 type errors found"),
        ("test_failures", "high", "test suite", "2 tests are failing"),
        ("low_bus_factor", "high", "repository", "Low bus factor (1) - over-reliance on few contributors"),
        ("outdated_documentation", "medium", "documentation", "1 documentation files may be outdated"),
    }


def test_detailed_findings(issue_input):
    functions, found = issue_input
    assert findings.detailed_findings(functions, found).groupBy("category").count().count() == 2
    assert findings.severe_findings(found).select("severity").first()["severity"] == "high"


def test_recommendations(spark):
    def rules(**values):
        return {r["rule"] for r in scoring.recommendations(summary(spark, **values)).collect()}

    assert rules() == {"no_framework", "no_security", "no_ci"}
    assert rules(frameworks=1, total_tests=9, security_analyses=1, has_ci=True) == {"few_tests"}
    assert rules(frameworks=1, total_tests=10, security_analyses=1, has_ci=True, average_complexity=15.5) == {"complex_code"}
    history_rules = dict(frameworks=1, total_tests=10, security_analyses=1, has_ci=True, has_history=True)
    assert rules(**history_rules, repo_age_days=30, bus_factor=1, outdated_docs=4, under_commented_files=6) == {
        "young", "bus_factor", "outdated_docs", "few_comments",
    }


def test_insights_and_verification_issues(spark):
    rows = summary(spark, repo_age_days=30, features=5, fixes=20, breaking_changes=10, bus_factor=1, high_churn_files=10)
    told = [(r["category"], r["message"]) for r in scoring.insights(rows).orderBy("ord").collect()]
    assert [c for c, _ in told] == ["maturity", "quality", "stability", "sustainability", "stability"]
    assert told[3][1].startswith("Low bus factor (1).")
    issues = summary(spark, features=4, tests=0, recent_features=1, outdated_docs=1, has_versions=True)
    found = {r["type"]: r["evidence"] for r in scoring.verification_issues(issues).collect()}
    assert found.keys() == {"missing_tests", "outdated_documentation", "versioning_inconsistency"}
    assert found["missing_tests"] == "Feature commits: 4, Test commits: 0"
    assert scoring.verification_issues(summary(spark, features=3, tests=1)).count() == 0


# --- reports --------------------------------------------------------------------------------------


def test_numbers_round_like_their_binary_value(spark):
    values = [0.0, 92.125, 92.375, 2.675, 1.005, 0.125, 0.005, 99.995, 99.999, 0.1, 1e6 + 0.345, 12.5, 0.05, 0.25, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2):
        got = [r["t"] for r in df.select(report.number(F.col("v"), digits).alias("t")).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_console_and_markdown(spark, issue_input, tmp_path):
    functions, found = issue_input
    rows = scoring.scored(summary(spark, total_tests=20, passed=18, failed=2, success_rate=90.0, total_files=5))
    distribution = metrics.complexity_distribution(functions)
    console = {r["metric"]: r["value"] for r in report.console_summary(rows, distribution).collect()}
    assert console["Success rate"] == "90.0%"
    assert console["C (11-20)"] == "1 functions"
    assert "A (1-5)" not in console
    assert "Potential secrets found" not in console
    rollup = metrics.file_rollup(functions)
    lines = report.markdown_report(
        rows,
        spark.createDataFrame([("r", ["Go", "Python"])], "repo_id string, languages array<string>"),
        distribution,
        metrics.top_complex_files(rollup),
        scoring.insights(rows.filter("has_history")),
        scoring.critical_issues(functions, found, rows),
        scoring.recommendations(rows),
    )
    texts = [r["line"] for r in report.sorted_report(lines).collect()]
    assert texts[0] == "# Code Analysis Report"
    assert "- **Languages**: Go, Python" in texts
    assert "1. `main.py` - Complexity: 41" in texts
    assert texts.index("### Hardcoded Secret") < texts.index("### Security (Priority: high)")
    report.write_markdown(lines, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() == len(texts)
    report.write_report({"findings": found}, str(tmp_path / "json"), ("repo_id",))
    assert spark.read.json(str(tmp_path / "json" / "findings")).count() == found.count()


# --- physical plans -------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_never_compare_all_pairs(spark, files):
    code = files({"a.py": "def f(x): encrypt", "b.py": "x"})
    claims = spark.createDataFrame([("r", "c", "api", "f")], "repo_id string, claim_id string, claim_type string, text string")
    for df in (
        correlate.api_related(claims, correlate.symbols(code)),
        correlate.feature_related(claims, code),
        correlate.security_related(claims, code),
        correlate.correlate(claims, code),
    ):
        text = plan(df)
        assert "NestedLoop" not in text
        assert "Cartesian" not in text


def test_rankings_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("cast(id % 3 as string) as repo_id", "id as n")
    text = plan(top_k(df, 5, [F.desc("n")], ("repo_id",)))
    assert text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")
    assert "TakeOrderedAndProject" in plan(df.orderBy(F.desc("n")).limit(5))


def test_totals_without_groups_are_scalar(spark):
    df = spark.range(10).selectExpr("id as n")
    assert "NestedLoop" not in plan(with_total(df, "n"))


def test_censuses_do_not_read_texts(spark, tmp_path, files):
    files({"a.py": "x", "b.md": "y"}).write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    text = plan(metrics.language_census(stored))
    assert "path" in text
    assert "text" not in text.split("ReadSchema: ")[1].splitlines()[0]


def test_time_windows_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("r", "h", None, "a", "e", "s")], COMMITS).write.parquet(str(tmp_path / "c"))
    text = plan(history.commits_per_author(spark.read.parquet(str(tmp_path / "c")), "2024-06-30"))
    assert "GreaterThanOrEqual(ts" in text


def test_hot_keys_are_split(spark):
    """Adaptive execution splits a hot word of the claims; the result does not change."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        claims = spark.range(0, 20000, 1, 16).selectExpr(
            "'r' as repo_id", "cast(id as string) as claim_id", "'api' as claim_type",
            "if(id % 3 = 0, 'hot', concat('w', id)) as text",
        )
        symbols = spark.range(3000).selectExpr("'r' as repo_id", "concat('p', id) as path", "if(id % 2 = 0, 'hot', concat('w', id)) as symbol")
        related = correlate.api_related(claims, symbols)
        hot = related.filter("related = 1500").count()
        assert hot == 6667
        rows = related.collect()
        assert "skew=true" in plan(related)
        assert len(rows) == 6667 + 1000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# --- sessions, streams, audits --------------------------------------------------------------------


def test_stage_uses_the_session_folder(spark):
    folder = checkpoint_folder(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None) or folder)
    staged = stage(spark.range(10).filter("id > 3"), "ids")
    assert staged.count() == 6
    assert f"{folder}/ids-" in staged.inputFiles()[0]
    assert "Range" not in plan(staged)


def test_stream_equals_batch(spark, tmp_path, project):
    source = str(tmp_path / "in")
    project.repartition(4).write.parquet(source)
    stream = continuous.read_stream(spark, source, project.schema, files_per_batch=1)
    for name in continuous.OPERATORS:
        out = str(tmp_path / f"out-{name}")
        query = continuous.write_stream(continuous.apply_stream(stream, name), out, f"{name}-{uuid.uuid4().hex}")
        assert query.awaitTermination(120)
        batch = continuous.OPERATORS[name](project)
        got = spark.read.schema(batch.schema).parquet(out)
        assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())), name
    redacted = continuous.apply_stream(stream, "secrets", "high")
    assert redacted.isStreaming


def test_facts_replace_texts(project):
    facts = file_facts(project)
    assert "text" not in facts.columns
    for operator in (findings.lint_lines, findings.secret_findings, correlate.symbols, metrics.line_metrics):
        assert sorted(map(str, operator(facts).collect())) == sorted(map(str, operator(project).collect()))


def test_audit(spark, project):
    functions = spark.createDataFrame([("r", "main.py", "total", 3, 1), ("r", "main.py", "many", 10, 35)], FUNCTION_METRICS)
    commits = spark.range(20).selectExpr(
        "'r' as repo_id", "concat('h', id) as hash", "timestamp_seconds(1719700000 - id * 86400) as ts",
        "concat('a', id % 2) as author", "'john.doe@example.com' as email", "'feat: add x' as subject",
    )
    touched = commits.selectExpr("repo_id", "hash", "ts", "author", "'main.py' as path", "'M' as change")
    tags = spark.createDataFrame([("r", "v1.0.0", None, "first")], TAGS)
    runs = spark.createDataFrame([("r", "python", "pytest", 1, "4 passed, 1 failed", "", None)], TEST_RUNS)
    results = audit(AuditTables(project, commits, touched, tags, functions, runs), "2024-06-30", level="high")
    row = results["summary"].first()
    assert (row["total_files"], row["high_complexity_functions"], row["failed"], row["gate_status"]) == (1, 1, 1, 1)
    assert row["has_ci"] and row["has_history"]
    assert 0 <= row["health_score"] <= 100
    assert results["claim_summary"].first()["documentation_files"] == 1
    assert results["verdict_summary"].first()["verified"] >= 1
    assert {r["type"] for r in results["issues"].collect()} == {"high_complexity", "test_failures"}
    for name, df in results.items():
        assert "john.doe" not in json.dumps([str(r) for r in df.collect()]), name


def test_fixture_texts_are_whole():
    assert README.count("```") == 2
    assert PYTHON_MAIN.startswith('"""')
