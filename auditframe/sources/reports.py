"""JSON and XML reports of tools and test runners as tables.

Reports that do not parse give a row with status ``failed``; they never fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.text import first_match
from auditframe.sources.logs import stdout_summary

LINT_MESSAGES = "array<struct<type:string,path:string,line:int,column:int,message:string,symbol:string>>"
SECURITY_REPORT = (
    "struct<metrics:string,results:array<struct<filename:string,line_number:int,issue_severity:string,"
    "issue_confidence:string,issue_text:string,test_id:string>>>"
)
LINT_FILES = (
    "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,"
    "line:int,column:int>>>>"
)
MANIFEST = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
PYTEST_REPORT = "struct<summary:struct<total:bigint,passed:bigint,failed:bigint,skipped:bigint>>"
JEST_REPORT = (
    "struct<numTotalTests:bigint,numPassedTests:bigint,numFailedTests:bigint,numPendingTests:bigint>"
)
GO_EVENTS = "array<struct<Action:string>>"
JUNIT_SUITE = "_name string, _tests int, _failures int, _errors int, _skipped int, _time double"
JUNIT = f"{JUNIT_SUITE}, testsuite array<struct<{JUNIT_SUITE}>>, _corrupt_record string"


def is_json(report: Column) -> Column:
    return F.coalesce(F.try_parse_json(report).isNotNull(), F.lit(False))


def report_status(report: Column) -> Column:
    """``completed`` for empty or readable reports, else ``failed``."""
    empty = F.coalesce(report, F.lit("")) == ""
    return F.when(empty | is_json(report), "completed").otherwise("failed")


def _parsed(report: Column, schema: str) -> Column:
    return F.from_json(report, schema, {"mode": "PERMISSIVE"})


def _keep(df: DataFrame, report: str) -> list[str]:
    return [c for c in df.columns if c != report]


def lint_messages(reports: DataFrame, report: str = "report") -> DataFrame:
    """Messages of a linter that reports one array of messages."""
    return reports.select(*_keep(reports, report), F.inline(_parsed(F.col(report), LINT_MESSAGES))).withColumn(
        "type", F.coalesce("type", F.lit("unknown"))
    )


def security_results(reports: DataFrame, report: str = "report") -> DataFrame:
    """Results of a security scanner that reports ``metrics`` and ``results``."""
    return reports.select(*_keep(reports, report), F.inline(_parsed(F.col(report), SECURITY_REPORT)["results"]))


def lint_file_messages(reports: DataFrame, report: str = "report") -> DataFrame:
    """Messages of a linter that reports an array of files with messages each."""
    kept = _keep(reports, report)
    files = reports.select(*kept, F.inline(_parsed(F.col(report), LINT_FILES)))
    return files.select(*kept, F.col("filePath").alias("path"), F.inline("messages"))


def report_totals(reports: DataFrame, kind: str, report: str = "report") -> DataFrame:
    """Status and number of issues per report; ``kind`` is ``messages``, ``files`` or ``results``."""
    text = F.col(report)
    if kind == "messages":
        issues = F.size(_parsed(text, LINT_MESSAGES))
    elif kind == "results":
        issues = F.size(_parsed(text, SECURITY_REPORT)["results"])
    elif kind == "files":
        sizes = F.transform(_parsed(text, LINT_FILES), lambda f: F.greatest(F.size(f["messages"]), F.lit(0)))
        issues = F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    else:
        raise ValueError(f"unknown kind of report: {kind!r}")
    status = report_status(text)
    return reports.select(
        *_keep(reports, report),
        status.alias("status"),
        F.when(status == "completed", F.greatest(F.coalesce(issues, F.lit(0)), F.lit(0))).alias("total_issues"),
    )


def object_reports(reports: DataFrame, report: str = "report") -> DataFrame:
    """Reports kept whole as VARIANT (dependency audits, contract checkers); unreadable ones are dropped."""
    return reports.withColumn(report, F.try_parse_json(report)).filter(F.col(report).isNotNull())


def complexity_messages(reports: DataFrame, report: str = "report") -> DataFrame:
    """Complexities that a linter states in its messages, one row per message."""
    messages = lint_file_messages(reports, report)
    return messages.filter(F.coalesce(F.col("ruleId"), F.lit("")).contains("complexity")).select(
        *_keep(reports, report),
        "path",
        "line",
        first_match(F.col("message"), "complexity of ([0-9]+)").try_cast("int").alias("complexity"),
    ).filter(F.col("complexity").isNotNull())


def manifest_dependencies(manifest: Column) -> Column:
    """All dependencies of a package manifest; the runtime version wins over the development one."""
    parsed = _parsed(manifest, MANIFEST)
    none = F.create_map().cast("map<string,string>")
    runtime = F.coalesce(parsed["dependencies"], none)
    development = F.coalesce(parsed["devDependencies"], none)
    return merge_maps(development, runtime)


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def uses_framework(dependencies: Column, framework: Column) -> Column:
    return F.map_contains_key(dependencies, framework) | F.map_contains_key(
        dependencies, F.concat(F.lit("@types/"), framework)
    )


def json_summary(report: Column, framework: Column) -> Column:
    """Test counts from a runner's JSON report; NULL if the report does not parse."""
    pytest = _parsed(report, PYTEST_REPORT)["summary"]
    jest = _parsed(report, JEST_REPORT)
    events = _parsed(report, GO_EVENTS)

    def actions(name: str) -> Column:
        return F.size(F.filter(F.coalesce(events, F.array()), lambda e: e["Action"] == name)).cast("bigint")

    def pick(of_pytest: Column, of_jest: Column, of_go: Column) -> Column:
        by_runner = (
            F.when(framework == "pytest", of_pytest)
            .when(framework == "jest", of_jest)
            .when(framework == "gotest", of_go)
        )
        return F.coalesce(by_runner, F.lit(0).cast("bigint"))

    # A jest report without a total counts nothing.
    stated = jest["numTotalTests"].isNotNull()
    passed, failed = actions("pass"), actions("fail")
    none = F.lit(None).cast("bigint")
    summary = F.struct(
        pick(pytest["total"], jest["numTotalTests"], passed + failed).alias("total"),
        pick(pytest["passed"], F.when(stated, jest["numPassedTests"]), passed).alias("passed"),
        pick(pytest["failed"], F.when(stated, jest["numFailedTests"]), failed).alias("failed"),
        pick(pytest["skipped"], F.when(stated, jest["numPendingTests"]), none).alias("skipped"),
    )
    return F.when(is_json(report), summary)


def test_summary(runs: DataFrame) -> DataFrame:
    """Add total, passed, failed and skipped to test runs: from the report, else from the output."""
    framework = F.col("framework")
    counts = stdout_summary(F.col("stdout"), framework)
    if "report" in runs.columns:
        counts = F.coalesce(json_summary(F.col("report"), framework), counts)
    return runs.withColumn("s", counts).select(*runs.columns, "s.*")


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """JUnit suites from XML files, one row per suite, read and split by Spark's XML source."""
    rows = spark.read.format("xml").option("rowTag", "testsuite").schema(JUNIT_SUITE).load(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), *_suite_columns())


def _suite_columns(prefix: str = "") -> list[Column]:
    def number(name: str) -> Column:
        return F.coalesce(F.col(f"{prefix}_{name}"), F.lit(0))

    return [
        F.coalesce(F.col(f"{prefix}_name"), F.lit("Unknown")).alias("name"),
        *[number(n).alias(n) for n in ("tests", "failures", "errors", "skipped", "time")],
    ]


def junit_suites(reports: DataFrame, xml: str = "xml") -> DataFrame:
    """JUnit suites from XML texts; a report is one suite or a collection; unreadable texts give none."""
    kept = _keep(reports, xml)
    root = F.from_xml(xml, F.lit(JUNIT))
    is_collection = F.col(xml).rlike("<testsuites[\\s>]")
    own = F.struct(*[F.col(f"r._{n}") for n in ("name", "tests", "failures", "errors", "skipped", "time")])
    readable = reports.withColumn("r", root).filter(F.col("r._corrupt_record").isNull())
    suites = readable.withColumn(
        "suite", F.explode(F.when(is_collection, F.col("r.testsuite")).otherwise(F.array(own)))
    )
    return suites.select(*kept, *_suite_columns("suite."))
