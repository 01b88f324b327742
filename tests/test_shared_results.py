"""Results that several others need are made once, and distinct values are cut before they are shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators import claims, correlate, discovery
from auditframe.operators.grouping import top_k_distinct
from auditframe.plans.audit import correlated_claims
from auditframe.sources.bindings import Bindings

LONG = "reconciles_" * 6 + "everything"

TEXTS = {
    "src/app.py": "def run_all(x):\n    return widget_loader(x)\n",
    "src/long.py": f"def other():\n    pass\nvalue = '{LONG}'\n",
    "src/empty.py": "",
    "src/none.py": None,
    "README.md": "widget everywhere",
}
CLAIMS = [
    "Supports widget exports",
    f"Supports {LONG} too",
    "Returns the run_all value",
    "Prevents token reuse",
    "Supports nothingness",
    None,
]


def executed(df):
    """The executed plan; an adaptive one also names the plan that it began with."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_correlation_reads_texts_once(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [(f"r{i}", p, t) for i in range(2) for p, t in TEXTS.items()]
    spark.createDataFrame(rows, "repo_id string, path string, text string").write.parquet(path)
    files = spark.read.parquet(path)
    units = spark.createDataFrame([("r0", i, t) for i, t in enumerate(CLAIMS)], "repo_id string, line_id int, text string")
    found = claims.with_claim_id(claims.extract_claims(units), ["line_id", "claim_type", "pattern_no", "match_no"])

    got = correlated_claims(found, files)
    plain = correlate.correlate(found, files)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    related = {(r["line_id"], r["claim_type"]): r["related"] for r in got.collect()}
    assert related[(0, "feature")] == 1 and related[(1, "feature")] == 1 and related[(4, "feature")] == 0

    # Only the files that may hold a keyword of more than 32 characters are looked at again.
    texts = "ReadSchema: struct<repo_id:string,path:string,text:string>"
    assert executed(got).count(texts) == 1
    assert executed(plain).count(texts) > 1


def test_first_distinct_values(spark):
    rows = [("a", f"f{i % 9}") for i in range(90)] + [("b", "z"), ("b", "z"), ("c", None), ("c", "y"), ("c", None)]
    df = spark.createDataFrame(rows, "repo_id string, file string")
    first = top_k_distinct(df, 3, "file", ["repo_id"])
    assert sorted(map(str, first.collect())) == sorted(
        f"Row(repo_id={g!r}, file={v!r}, rank={n})"
        for g, v, n in [("a", "f0", 1), ("a", "f1", 2), ("a", "f2", 3), ("b", "z", 1), ("c", None, 1), ("c", "y", 2)]
    )
    plan = executed(first)
    assert plan.count("dense_rank") and plan.count("WindowGroupLimit") >= 1
    assert top_k_distinct(df.limit(0), 3, "file", ["repo_id"]).collect() == []


def test_examples_are_cut_before_the_shuffle(spark):
    paths = [f"tests/unit/test_{i:04}.py" for i in range(300)] + [f"htmlcov/{i}.html" for i in range(300)]
    files = spark.createDataFrame([("r", p, "") for p in paths * 2], "repo_id string, path string, text string").repartition(4)
    for listed in (discovery.test_frameworks(files), discovery.coverage_artifacts(files)):
        assert "WindowGroupLimit" in executed(listed)
    found = discovery.framework_files(files).unionByName(discovery.manifest_frameworks(files))
    expected = {}
    for r in found.distinct().collect():
        expected.setdefault((r["language"], r["framework"]), {}).setdefault(r["indicator"], []).append(r["file"])
    expected = {k: [f for _, fs in sorted(v.items()) for f in sorted(fs)[:5]] for k, v in expected.items()}
    assert expected
    assert {(r["language"], r["framework"]): r["files"] for r in discovery.test_frameworks(files).collect()} == expected
    covered = discovery.coverage_artifacts(files)
    assert covered.groupBy("language", "pattern").agg(F.max("rank").alias("n")).filter("n > 5").collect() == []
    assert covered.filter("pattern = 'htmlcov/'").select("file", "rank").collect() in ([], [("htmlcov", 1)])


def test_short_rows_that_become_texts_are_dealt_out(spark, tmp_path):
    """A table in one file of one row group still keeps all tasks of a shuffle busy with the texts made of it."""
    source = spark.range(1000).selectExpr(
        "id AS p_partkey", "'red widget' AS p_name", "'Brand#1' AS p_brand", "'STEEL' AS p_type", "1 AS p_size"
    )
    source.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    docs = Bindings(spark, str(tmp_path)).guide_docs.select(F.spark_partition_id().alias("p"), "path")
    sizes = [r["n"] for r in docs.groupBy("p").agg(F.count("path").alias("n")).collect()]
    assert sum(sizes) == 1000 and len(sizes) == 8 and max(sizes) < 200


def test_no_side_that_grows_passes_the_driver(spark, files, tmp_path):
    """Joins of claims with code shuffle both sides, however small the files behind them look."""
    code = files({"a.py": "def alpha(x):\n    return token", "b.js": "function alpha (a) { }"})
    rows = [("r", "1", "api", "calls alpha"), ("r", "2", "feature", "exports token"), ("r", "3", "security", "a token")]
    found = spark.createDataFrame(rows, "repo_id string, claim_id string, claim_type string, text string")
    code.write.parquet(str(tmp_path / "code"))
    found.write.parquet(str(tmp_path / "claims"))
    related = correlate.correlate(spark.read.parquet(str(tmp_path / "claims")), spark.read.parquet(str(tmp_path / "code")))
    plan = related._jdf.queryExecution().executedPlan().toString()
    # Only the one row of keyword files per repository may be broadcast.
    assert plan.count("BroadcastExchange") <= 1
    assert plan.count("SortMergeJoin") >= 6
    assert {r["claim_id"]: r["related"] for r in related.collect()} == {"1": 2, "2": 1, "3": 1}
