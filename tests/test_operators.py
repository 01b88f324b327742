from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditframe.operators import claims, correlate, discovery, findings, history, metrics, verdicts
from auditframe.operators.grouping import top_k
from auditframe.schemas import FUNCTION_METRICS, named

AS_OF = "2024-06-30"
NOW = datetime(2024, 6, 30, tzinfo=UTC)


def ago(days):
    return NOW - timedelta(days=days)


# --- metrics --------------------------------------------------------------------------------------


def test_distribution_has_all_bins(spark):
    df = spark.createDataFrame([("r", "a.py", f"f{i}", i, c) for i, c in enumerate([1, 5, 6, 10, 11, 20, 30, 40, 41])], FUNCTION_METRICS)
    counts = {r["bin"]: r["functions"] for r in metrics.complexity_distribution(df).collect()}
    assert counts == {"A (1-5)": 2, "B (6-10)": 2, "C (11-20)": 2, "D (21-30)": 1, "E (31-40)": 1, "F (41+)": 1}
    empty = metrics.complexity_distribution(df.limit(0), by=())
    assert [r["functions"] for r in empty.collect()] == [0] * 6


def test_complexity_summary_is_per_file(spark):
    df = spark.createDataFrame([("r", "a", 10, 5), ("r", "b", 20, None)], "repo_id string, path string, total_complexity int, loc int")
    row = metrics.complexity_summary(df).first()
    assert (row["total_files"], row["total_complexity"], row["total_loc"], row["average_complexity"]) == (2, 30, 5, 15.0)
    row = metrics.complexity_summary(df.limit(0), by=()).first()
    assert (row["total_files"], row["average_complexity"]) == (0, 0.0)


def test_language_census(files):
    df = files({"a.py": "", "b.py": "", "c.js": "", "venv/d.py": "", "x.md": ""})
    census = {r["language"]: (r["files"], round(r["percentage"], 2)) for r in metrics.language_census(df).collect()}
    assert census == {"Python": (2, 66.67), "JavaScript": (1, 33.33)}
    assert metrics.primary_language(df, by=()).first()["primary_language"] == "Python"
    assert metrics.report_languages(df).first()["languages"] == ["JavaScript", "Python"]


def test_file_metrics_keep_unreadable_files(spark, files):
    functions = spark.createDataFrame([("r", "a.py", "f", 1, 3), ("r", "gone.py", "g", 1, 4)], FUNCTION_METRICS)
    lines = metrics.line_metrics(files({"a.py": "x\ny\n"}))
    rows = {r["path"]: (r["total_complexity"], r["loc"]) for r in metrics.file_metrics(functions, lines).collect()}
    assert rows == {"a.py": (3, 2), "gone.py": (4, None)}


def test_repositories_without_an_id_are_kept(spark, files):
    df = named(files({"a.py": "", "b.py": ""}, repo=None))
    assert metrics.language_census(df).first()["total_files"] == 2


# --- history --------------------------------------------------------------------------------------


@pytest.fixture
def commits(spark):
    rows = [("r", f"h{i}", ago(i), "alice" if i < 100 else "bob" if i < 150 else "carol", f"feat: {i}") for i in range(175)]
    return spark.createDataFrame(rows, "repo_id string, hash string, ts timestamp, author string, subject string")


def test_bus_factor(spark, commits):
    authors = history.contributors(commits, AS_OF)
    row = history.bus_factor(authors).first()
    assert (row["total_contributors"], row["bus_factor"]) == (3, 3)
    top = history.top_contributors(commits, AS_OF, k=1).first()
    assert (top["author"], top["commits"]) == ("alice", 100)
    even = spark.createDataFrame([(f"a{i}", 1) for i in range(10)], "author string, commits bigint")
    assert history.bus_factor(even, by=()).first()["bus_factor"] == 0


def test_contributors_fall_back_to_all_time(commits):
    assert history.contributors(commits, "2030-01-01").count() == 3
    assert {r["author"] for r in history.contributors(commits, "2025-03-01").collect()} == {"alice", "bob"}


def test_repository_age(spark):
    df = spark.createDataFrame([(1609459200,), (1672531200,)], "t bigint").select(F.timestamp_seconds("t").alias("ts"))
    assert history.repository_info(df, by=()).first()["repo_age_days"] == 730


def test_merges_are_left_out(spark):
    df = spark.createDataFrame([(ago(1), "a", True), (ago(1), "a", False)], "ts timestamp, author string, is_merge boolean")
    assert history.commits_per_author(df, AS_OF, by=()).first()["commits"] == 1


@pytest.mark.parametrize(
    ("tags", "compliant"),
    [
        (["v1.0.0", "v1.1.0", "v1.1.1", "v2.0.0-alpha", "v2.0.0"], True),
        (["v1.0.0", "release-2", "1.1", "v1.2.0", "latest"], False),
        (["v1.0.0", "v1.1.0", "v1.1.1", "v2.0.0", "x"], False),
    ],
)
def test_semver(spark, tags, compliant):
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    assert history.version_stats(df, by=()).first()["follows_semver"] is compliant


def test_version_order(spark):
    tags = ["v1.9.0", "v1.10.0", "v1.2.10", "v10.0.0", "v2.0.0"]
    df = spark.createDataFrame([(t, NOW, "m") for t in tags], "tag string, ts timestamp, message string")
    ordered = [r["tag"] for r in history.recent_versions(df, by=()).orderBy("rank").collect()]
    assert ordered == ["v10.0.0", "v2.0.0", "v1.10.0", "v1.9.0", "v1.2.10"]
    assert history.version_stats(df, by=()).first()["latest_version"] == "v10.0.0"


def touched(spark, rows):
    return spark.createDataFrame(
        [("r", h, ts, a, p, c) for h, ts, a, p, c in rows],
        "repo_id string, hash string, ts timestamp, author string, path string, change string",
    )


def test_outdated_docs(spark):
    docs = [("d", ago(60), "a", "README.md", "M"), ("e", ago(90), "a", "docs/api.md", "M")]
    code = [(f"h{i}", ago(i), "a", f"f{i}.py", "M") for i in range(5)]
    row = history.outdated_docs(touched(spark, docs + code), AS_OF).first()
    assert (row["path"], row["days_since_update"]) == ("README.md", 60)
    # Eleven lines are needed: three commits of one file make eight.
    assert history.outdated_docs(touched(spark, docs + code[:3]), AS_OF).count() == 0
    fresh = [("d", ago(30), "a", "README.md", "M")]
    assert history.outdated_docs(touched(spark, fresh + code), AS_OF).count() == 0


def test_churn_and_abandoned(spark):
    rows = [(f"h{i}", ago(i), "a", "hot.py", "M") for i in range(6)]
    rows += [(f"g{i}", ago(i), "a", ".hidden", "M") for i in range(9)] + [("o", ago(400), "a", "old.py", "A")]
    rows += [("p", ago(365), "a", "edge.py", "A"), ("q", ago(900), "a", "old.md", "A"), ("z", ago(10), "a", "new.py", "A")]
    df = touched(spark, rows)
    assert [(r["path"], r["changes"]) for r in history.high_churn_files(df, AS_OF).collect()] == [("hot.py", 6)]
    assert [(r["path"], r["days_since_change"]) for r in history.abandoned_files(df, AS_OF).collect()] == [("old.py", 400)]
    assert history.abandoned_files(df, AS_OF, sample_first=1).count() == 0
    assert [r["path"] for r in history.recently_added_files(df, AS_OF).collect()] == ["new.py"]


def test_ownership(spark):
    rows = [("1", ago(1), "bob", "setup.py", "M"), ("2", ago(2), "amy", "setup.py", "M"), ("2", ago(2), "amy", "x/README.rst", "M")]
    rows += [("3", ago(3), "amy", "src/x.py", "M"), ("4", ago(3), "zoe", "src/main.go", "M")]
    owners = {r["path"]: (r["primary_maintainer"], r["commits"]) for r in history.file_ownership(touched(spark, rows)).collect()}
    assert owners == {"setup.py": ("amy", 1), "x/README.rst": ("amy", 1), "src/main.go": ("zoe", 1)}


def test_top_k_is_total_and_partition_independent(spark):
    rows = [(f"r{i % 3}", i % 5, f"p{i:03}") for i in range(300)]
    results = set()
    for partitions in (1, 7):
        df = spark.createDataFrame(rows, "repo_id string, n int, path string").repartition(partitions)
        top = top_k(df, 4, [F.desc("n"), F.asc("path")], ("repo_id",))
        results.add(tuple(sorted(tuple(r) for r in top.collect())))
    assert len(results) == 1
    assert top_k(spark.createDataFrame(rows, "repo_id string, n int, path string"), 4, [F.desc("n"), F.asc("path")]).count() == 4


# --- claims and code ------------------------------------------------------------------------------


def claim_rows(spark, rows):
    return spark.createDataFrame(
        [("r", f"c{i}", kind, text) for i, (kind, text) in enumerate(rows)],
        "repo_id string, claim_id string, claim_type string, text string",
    )


def test_api_related_counts_repeated_words(spark, files):
    code = files({"a.py": "def run(x):\nclass Job:", "b.py": "def run(y):", "c.md": "def run("})
    df = claim_rows(spark, [("api", "run the run of Job"), ("api", "nothing here"), ("feature", "run")])
    symbols = correlate.symbols(code)
    assert {r["claim_id"]: r["related"] for r in correlate.api_related(df, symbols).collect()} == {"c0": 5}
    pairs = {(r["symbol"], r["path"], r["times"]) for r in correlate.api_related_files(df, symbols).collect()}
    assert pairs == {("run", "a.py", 2), ("run", "b.py", 2), ("Job", "a.py", 1)}


def brute_keyword_files(texts, keywords):
    code = {p: t.lower() for p, t in texts.items() if p.rsplit(".", 1)[-1] in ("py", "js", "java", "cpp", "go")}
    return {k: min(p for p, t in code.items() if k in t) for k in keywords if any(k in t for t in code.values())}


def test_keyword_files_against_brute_force(spark, files):
    long_word = "x".join(f"{i:02}ab" for i in range(60))
    texts = {
        "b.py": f"Señalización {long_word} tail", "a.go": "grüße EXPORTER_x1", "c.js": f"{long_word[:120]}q", "z.md": "only_in_docs",
        "d.py": "é" * 100 + "needle" + "é" * 100,
    }
    keywords = [
        "export", "porter", "señal", "xxxx", "only", "er_x", long_word[5:37], long_word[5:38], long_word[60:200].lower(),
        long_word[:121], "éneedleé", "é" * 40, "é" * 120, "needle", long_word[:30] + "zz" * 5,
    ]
    df = spark.createDataFrame([("r", k) for k in keywords], "repo_id string, keyword string")
    got = {r["keyword"]: r["path"] for r in correlate.keyword_files(files(texts), df).collect()}
    assert got == brute_keyword_files(texts, keywords)


def test_feature_and_security_related(spark, files):
    code = files({"b.py": "Encrypts the TOKEN", "a.js": "exports all", "c.go": "encrypt"})
    df = claim_rows(spark, [("feature", "with exports and encryption now"), ("security", "token is encrypted"), ("security", "none")])
    features = {r["claim_id"]: r["related_code"] for r in correlate.feature_related(df, code).collect()}
    assert features == {"c0": ["a.js"]}
    security = {r["claim_id"]: r["related_code"] for r in correlate.security_related(df, code).collect()}
    assert security == {"c1": ["b.py", "b.py"]}
    counts = {r["claim_id"]: r["related"] for r in correlate.correlate(df, code).collect()}
    assert counts == {"c0": 1, "c1": 2, "c2": 0}
    unrelated = correlate.unrelated_claims(df, correlate.correlate(df, code).filter("related > 0"))
    assert [r["claim_id"] for r in unrelated.collect()] == ["c2"]


def test_verdicts(spark, files, project):
    found = claims.with_claim_id(claims.all_claims(project))
    judged = verdicts.verdicts(verdicts.with_strategy(correlate.correlate(found, project)), project)
    by_text = {(r["claim_type"], r["text"]): r for r in judged.collect()}
    verified = by_text[("api", "Function 'total' exists and can be called")]
    assert (verified["status"], verified["verdict_confidence"], verified["evidence"]) == (
        "verified", 0.8, "Found implementation in 1 files",
    )
    failed = by_text[("api", "Object 'obj' has method 'process'")]
    assert (failed["status"], failed["verdict_confidence"]) == ("failed", 0.9)
    performance = by_text[("performance", "calculations: Can handle up to 1000 operations per second")]
    assert (performance["status"], performance["evidence"]) == ("inconclusive", "Found potential benchmark: bench/perf_x.py")
    summary = verdicts.verdict_summary(judged).first()
    assert summary["verified"] + summary["failed"] + summary["inconclusive"] == summary["total_claims"] == judged.count()


def test_no_claims(spark):
    none = spark.createDataFrame([], "status string, verifiable boolean, confidence double")
    assert verdicts.verdict_summary(none, by=()).first()["verification_rate"] == 0.0
    row = verdicts.claim_summary(none, by=()).first()
    assert (row["total_claims"], row["verification_rate"]) == (0, 0.0)


def test_recommendations_by_method(spark):
    rows = [("api", f"t{i}", i, True, "unit_test") for i in range(5)] + [("behavior", "b", 9, False, "property_test")]
    rows += [("behavior", "c", 10, True, "property_test")]
    df = spark.createDataFrame(rows, "claim_type string, text string, n int, verifiable boolean, verification_method string")
    found = {r["type"]: r for r in verdicts.verification_recommendations(df, ["n"], by=()).collect()}
    assert found.keys() == {"unit_testing", "documentation_review"}
    assert found["unit_testing"]["description"] == "Write unit tests for 5 API claims"
    assert found["unit_testing"]["examples"] == ["t0", "t1", "t2"]
    assert found["documentation_review"]["examples"] == ["b"]


def test_flatten_claims(spark):
    df = spark.createDataFrame([(1, {"api": [("x", 0.5)], "feature": [("y", 0.6), ("z", 0.7)]})], "id int, claims_by_type map<string,array<struct<text:string,confidence:double>>>")
    flat = {(r["claim_type"], r["text"]) for r in claims.flatten_claims_by_type(df).collect()}
    assert flat == {("api", "x"), ("feature", "y"), ("feature", "z")}


# --- discovery ------------------------------------------------------------------------------------


def test_frameworks(project):
    found = {(r["language"], r["framework"]): r["files"] for r in discovery.test_frameworks(project).collect()}
    assert found[("python", "pytest")] == ["pytest.ini", "test_main.py"]
    assert found[("python", "doctest")] == ["bench/perf_x.py", "main.py", "test_main.py"]
    assert found[("javascript", "jest")] == ["package.json", "package.json"]
    assert found[("ruby", "rspec")] == ["spec/"]
    assert ("go", "gotest") not in found
    detected = {(r["language"], r["framework"]) for r in discovery.detected_frameworks(project).collect()}
    assert detected == set(found)


def test_examples_are_limited_per_indicator(files):
    df = files({f"test_{i}.py": "" for i in range(9)})
    found = {r["framework"]: r["files"] for r in discovery.test_frameworks(df).collect()}
    assert found["pytest"] == [f"test_{i}.py" for i in range(5)]


def test_coverage_benchmarks_ci(project, files):
    found = {(r["language"], r["file"]) for r in discovery.coverage_artifacts(project).collect()}
    assert found == {("python", "coverage.xml"), ("python", "app/htmlcov")}
    assert discovery.benchmark_files(project).first()["benchmark_file"] == "bench/perf_x.py"
    assert discovery.has_ci(project).first()["has_ci"] is True
    assert discovery.has_ci(files({"a.py": ""})).first()["has_ci"] is False


def test_checks_per_language(spark):
    df = spark.createDataFrame([("r", "c", "t2", "a"), ("r", "c", "t1", "a"), ("r", "c", "t1", "b")], "repo_id string, language string, tool string, path string")
    row = findings.checks_per_language(df).first()
    assert (row["tools_used"], row["files_analyzed"], row["checks"]) == (["t1", "t2"], 2, 3)


def test_recent_features_and_months_are_whole(spark):
    rows = [("r", f"h{i:03d}", "u", f"feat: number {i}", f"2024-01-{1 + i % 28:02d} 00:00:00") for i in range(200)]
    commits = spark.createDataFrame(rows, "repo_id string, hash string, author string, subject string, ts string")
    commits = commits.withColumn("ts", F.to_timestamp("ts"))
    assert history.recent_features(commits, "2024-01-31", 100).count() == 100
    assert [r["features"] for r in history.features_per_month(commits, "2024-01-31").collect()] == [200]
    assert [r["features"] for r in history.features_per_month(commits, "2024-01-31", newest=50).collect()] == [50]
    assert history.commit_overview(commits, "2024-01-31").first()["recent_features"] == 200
