from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.functions import classify
from auditframe.operators import findings
from auditframe.operators.grouping import forward_fill
from auditframe.sources import files as file_source
from auditframe.sources import logs, reports


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("o")).first()["o"]


def test_commit_log(spark):
    df = spark.createDataFrame([("h|1609459200|A|a@b.c|s | x",), ("bad|1",), ("h2|x|A|b|c",)], "line string")
    rows = logs.commit_log(df).collect()
    assert [(r["hash"], r["subject"], r["ts"] is None) for r in rows] == [("h", "s | x", False), ("h2", "c", True)]


def test_commit_file_log(spark):
    lines = "10|,,a.py,b.py,20|,,a.py,c d.py".split(",")
    df = spark.createDataFrame([("l", i, s) for i, s in enumerate(["early.py", *lines])], "log_id string, line_no int, line string")
    rows = logs.commit_file_log(df).orderBy("line_no").select(F.unix_seconds("ts").alias("t"), "path").collect()
    assert [tuple(r) for r in rows] == [(10, "a.py"), (10, "b.py"), (20, "a.py"), (20, "c d.py")]


def test_forward_fill_over_blocks(spark):
    """Small blocks give what one pass over the whole group gives, whatever the number of partitions."""
    rows = [(k, i, i if (i * 7 + k) % 11 == 0 else None) for k in range(3) for i in range(200)]
    expected, last = {}, None
    for k, i, v in rows:
        last = v if v is not None else (last if i else None)
        expected[(k, i)] = last
    for partitions, block in ((1, 7), (5, 13), (3, 1000)):
        df = spark.createDataFrame(rows, "k int, i int, v int").repartition(partitions)
        got = forward_fill(df, "v", "i", ("k",), "filled", block).collect()
        assert {(r["k"], r["i"]): r["filled"] for r in got} == expected


def test_line_logs(spark):
    log = spark.createDataFrame([(1, "a.py:10: error: Bad: x\nfoo\nb:2\n")], "id int, stdout string")
    assert [tuple(r) for r in logs.type_check_lines(log).collect()] == [(1, 1, "a.py", "10", "error", "Bad: x")]
    log = spark.createDataFrame([(1, "  a.ts(1,2): error  \nnone\n)(")], "id int, stdout string")
    assert [r["message"] for r in logs.compiler_lines(log).collect()] == ["a.ts(1,2): error", ")("]
    log = spark.createDataFrame([(1, "7 main f a.go:1:1\nx main f a.go:1:1\n3 a\n 9  p (T).g  b/c.go:2:3 ")], "id int, stdout string")
    assert [(r["complexity"], r["name"], r["path"]) for r in logs.complexity_lines(log).collect()] == [
        (7, "f", "a.go"), (9, "(T).g", "b/c.go"),
    ]
    log = spark.createDataFrame([(1, '{"a":1}\nbad\n\n{"b":2}'), (2, None)], "id int, stdout string")
    assert [r["line_no"] for r in logs.json_lines(log).collect()] == [1, 4]


def test_assertion_failures(spark):
    out = "\nCBMC version 5.12\nParsing main.c\nVERIFICATION FAILED\nassertion at line 10: FAILURE\ndivision by zero\n"
    found = value(spark, logs.assertion_failures(F.col("t")), out)
    assert [(f["line_no"], f["line"]) for f in found] == [(4, "VERIFICATION FAILED"), (5, "assertion at line 10: FAILURE")]
    assert found[0]["context"] == out.split("\n")[1:6]
    assert found[1]["context"] == out.split("\n")[2:7]
    assert value(spark, logs.assertion_failures(F.col("t")), "assertion")[0]["context"] == ["assertion"]


def test_assertion_failures_of_a_long_log(spark):
    found = value(spark, logs.assertion_failures(F.col("t")), "assertion\n" * 50_000)
    assert len(found) == 50_000 and found[-1]["line_no"] == 50_000


def test_proof_goals(spark):
    out = "[wp] Proved: 5\n[wp] Failed: 2\n[wp] Total: 7"
    assert value(spark, logs.proof_goals(F.col("t"), numeric=True), out).asDict() == {"proved": 5, "total": 7, "percentage": 71.43}
    assert tuple(value(spark, logs.proof_goals(F.col("t")), "Goal Proved Goal Proved Goal")) == (2, 3, 66)
    assert tuple(value(spark, logs.proof_goals(F.col("t")), "")) == (0, 0, 0)


def test_counterexamples(spark):
    out = "x\nCounterexample found for f\n  inputs: x=0\n\n  actual: bad\n\nCounterexample found for g\n"
    found = value(spark, logs.counterexamples(F.col("t")), out)
    assert [(f["description"], f["inputs"]) for f in found] == [
        ("Counterexample found for f", ["inputs: x=0", "actual: bad"]), ("Counterexample found for g", []),
    ]
    assert value(spark, logs.counterexamples(F.col("t")), "nothing") == []


def test_warning_lines_and_log_end(spark):
    assert value(spark, classify.warning_lines(F.col("t")), " a warning: b \nok\nerror: c") == ["a warning: b", "error: c"]
    assert value(spark, classify.kept_log(F.col("t")), "x" + "é" * 5000) == "é" * 5000


def test_stdout_summaries(spark):
    runs = [
        ("pytest", "==== 2 passed, 1 failed in 0.5s ====", (3, 2, 1, 0)),
        ("pytest", "1 passed, 2 errors", (3, 1, 2, 0)),
        ("jest", "Test Suites: 2 passed, 2 total\nTests:       5 passed, 5 total", (5, 5, 0, 0)),
        ("jest", "Tests: 4 total\n", (4, 0, 0, 0)),
        ("gotest", "--- PASS: A (0.00s)\n--- PASS: B\n--- FAIL: C\nFAIL\nFAIL\tx\t0.1s", (3, 2, 1, 0)),
        ("mocha", "3 passing\n1 failing\n2 pending", (6, 3, 1, 2)),
        ("cargo", "test result: ok. 7 passed; 0 failed; 1 ignored", (8, 7, 0, 1)),
        ("other", "3 passed", (0, 0, 0, 0)),
    ]
    df = spark.createDataFrame([r[:2] for r in runs], "framework string, stdout string")
    got = [tuple(r["s"]) for r in df.select(logs.stdout_summary(F.col("stdout"), F.col("framework")).alias("s")).collect()]
    assert got == [r[2] for r in runs]


def test_json_summaries_fall_back_to_output(spark):
    runs = [
        ("pytest", "1 passed", '{"summary": {"total": 10, "passed": 8, "failed": 1, "skipped": 1}}', (10, 8, 1, 1)),
        ("jest", "", '{"numTotalTests": 20, "numPassedTests": 18, "numFailedTests": 2, "numPendingTests": 0}', (20, 18, 2, 0)),
        ("jest", "", '{"numPassedTests": 18}', (0, 0, 0, 0)),
        ("gotest", "", '[{"Action": "pass"}, {"Action": "fail"}, {"Action": "run"}]', (2, 1, 1, 0)),
        ("pytest", "1 passed", "broken", (1, 1, 0, 0)),
        ("pytest", "2 passed", "", (2, 2, 0, 0)),
        ("pytest", "2 passed", None, (2, 2, 0, 0)),
    ]
    df = spark.createDataFrame([r[:3] for r in runs], "framework string, stdout string, report string")
    got = [(r["total"], r["passed"], r["failed"], r["skipped"]) for r in reports.test_summary(df).collect()]
    assert got == [r[3] for r in runs]


SUITE = '<?xml version="1.0"?><testsuite name="S" tests="4" failures="1" errors="0" skipped="1" time="2.5"><testcase name="a"/></testsuite>'


def test_junit(spark, tmp_path):
    both = '<testsuites tests="9"><testsuite name="A" tests="4" failures="1"/><testsuite tests="2" time="0.5"/></testsuites>'
    df = spark.createDataFrame([("r", SUITE), ("r", both), ("r", "<bad")], "repo_id string, xml string")
    suites = reports.junit_suites(df)
    assert suites.count() == 3
    total = findings.junit_rollup(suites.filter("name = 'S'")).first()
    assert (total["total"], total["passed"], total["failed"], total["skipped"], total["time"]) == (4, 2, 1, 1, 2.5)
    (tmp_path / "TEST-a.xml").write_text(both)
    read = reports.read_junit(spark, str(tmp_path)).select("name", "tests").collect()
    assert sorted(tuple(r) for r in read) == [("A", 4), ("Unknown", 2)]


def test_lint_reports(spark):
    report = '[{"type": "convention", "line": 1, "column": 0, "path": "t.py", "symbol": "s", "message": "m"}, {"line": 3}]'
    df = spark.createDataFrame([(1, report), (2, "nope"), (3, ""), (4, None)], "id int, report string")
    assert [(r["id"], r["type"]) for r in reports.lint_messages(df).collect()] == [(1, "convention"), (1, "unknown")]
    totals = {r["id"]: (r["status"], r["total_issues"]) for r in reports.report_totals(df, "messages").collect()}
    assert totals == {1: ("completed", 2), 2: ("failed", None), 3: ("completed", 0), 4: ("completed", 0)}
    assert reports.object_reports(df).count() == 1


def test_manifest(spark):
    text = '{"devDependencies": {"@types/jest": "1", "a": "2"}, "dependencies": {"a": "3"}}'
    deps = reports.manifest_dependencies(F.col("t"))
    assert value(spark, deps, text) == {"@types/jest": "1", "a": "3"}
    assert value(spark, reports.uses_framework(deps, F.lit("jest")), text) is True
    assert value(spark, deps, "{}") == {}
    assert value(spark, deps, "broken") == {}


def test_process_status(spark):
    rows = [
        ("cbmc", 1, "VERIFICATION SUCCESSFUL", "", True, None), ("prusti", 0, "", "", True, None),
        ("miri", 1, "", "error: Undefined Behavior: x", None, True),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "tool string, exit_code int, stdout string, stderr string")
    status = classify.process_status(*[F.col(c) for c in df.columns])
    assert [tuple(r["s"]) for r in df.select(status.alias("s")).collect()] == [r[4:] for r in rows]


def test_read_files(spark, tmp_path):
    for name, text in {"r1/a b+c/x%é.py": "a\r\nb\rc", "r1/env/y.py": "y", "r2/z.py": "z", "r2/q.txt": "q"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    found = file_source.read_files(spark, str(tmp_path), glob="*.py", repositories=True)
    assert {(r["repo_id"], r["path"], r["text"]) for r in found.collect()} == {
        ("r1", "a b+c/x%é.py", "a\nb\nc"), ("r1", "env/y.py", "y"), ("r2", "z.py", "z"),
    }
    kept = file_source.source_files(found, "python")
    assert {r["path"] for r in kept.collect()} == {"a b+c/x%é.py", "z.py"}
    (tmp_path / "log.txt").write_text("a\nb")
    assert logs.read_lines(spark, str(tmp_path / "log.txt")).count() == 2
