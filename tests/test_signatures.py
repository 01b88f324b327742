"""Signatures over several lines: arguments, docstrings and line numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditframe.functions.signatures import sections
from auditframe.functions.text import number_lines
from auditframe.operators import claims, correlate, findings

FIVE_LINES = 'def f(\n    a,  # first (of many\n    b="x, (y",\n    *, c=(1,\n          2),\n) -> int:\n    """Does f."""\n'


def joined(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(F.array_join(sections(number_lines(F.col("text"))), "")).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", "1:"),
        ("x = (1,\n  2)", "1:x = (1,\n2:  2)"),
        ("def f(a): # (\n  return (", "1:def f(a): # (\n2:  return ("),
        ("def f(a,\n  b): return 1\ny = 2", "1:def f(a, b): return 1\n3:y = 2"),
        ("def f(a, \\\n  b='\\'('):\n  pass", "1:def f(a,  b='__'):\n3:  pass".replace("'__'", "'\\'('")),
        ("def f(a=')',\n  b=1):\n  pass", "1:def f(a=')', b=1):\n3:  pass"),
        ('def f(a="""x\ny)""", b=1):\n  pass', '1:def f(a="""x y)""", b=1):\n3:  pass'),
        ("class C(\n  A, # a\n  B\n):\n  pass", "1:class C( A,  B ):\n5:  pass"),
        ("def f(a,\n  b\nx = 1\ndef g(): pass", "1:def f(a,\n2:  b\n3:x = 1\n4:def g(): pass"),
    ],
)
def test_signatures_on_one_line(spark, text, expected):
    assert joined(spark, text) == expected


def test_no_text(spark):
    assert joined(spark, None) is None


def test_long_texts(spark):
    """A signature of ten thousand lines, one that never closes, and a long body."""
    many = "def f(\n" + "".join(f"    a{i}=(1, '('),\n" for i in range(10_000)) + "):\n    pass\n"
    assert joined(spark, many).split("\n")[1:] == ["10003:    pass", "10004:"]
    never = "def f(\n" + "x = [1, 2]\n" * 50_000
    assert joined(spark, never).count("\n") == 50_001
    body = "def f(a,\n  b):\n" + "    x = '#' # '\n" * 50_000
    assert joined(spark, body).count("\n") == 50_001


def test_lint_and_docstrings(files):
    text = FIVE_LINES + "class C(\n    A,\n):\n    def h(self,\n          a, b, c, d, e\n    ):\n        try:\n            pass\n        except:\n            pass\n"
    df = files({"x.py": text})
    assert [(r["line"], r["kind"]) for r in findings.lint_lines(df).collect()] == [
        (8, "missing_docstring"), (11, "too_many_arguments"), (11, "missing_docstring"), (16, "bare_except"),
    ]
    assert [(r["line_number"], r["text"]) for r in claims.docstrings(df).collect()] == [(1, "Does f.")]


def test_classes_of_related_files_hold_every_pair(spark):
    said = spark.createDataFrame(
        [("r", "1", "api", "call f and f or g"), ("r", "2", "api", "call f"), ("s", "1", "api", "g"), ("r", "3", "api", "none")],
        "repo_id string, claim_id string, claim_type string, text string",
    )
    symbols = spark.createDataFrame(
        [("r", "a.py", "f"), ("r", "b.py", "f"), ("r", "b.py", "g"), ("r", "c.py", "unused"), ("s", "a.py", "f")],
        "repo_id string, path string, symbol string",
    )
    classes = correlate.api_claim_classes(said, symbols)
    members = correlate.api_class_files(said, symbols)
    assert sorted(map(tuple, members.collect())) == [("r", "f", "a.py"), ("r", "f", "b.py"), ("r", "g", "b.py")]
    pairs = classes.join(members, ["repo_id", "symbol"]).select("repo_id", "claim_id", "symbol", "path", "times")
    listed = correlate.api_related_files(said, symbols).select("repo_id", "claim_id", "symbol", "path", "times")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, listed.collect()))
    links = {(r["repo_id"], r["claim_id"]): r["n"] for r in classes.groupBy("repo_id", "claim_id").agg(F.sum("links").alias("n")).collect()}
    related = correlate.api_related(said, symbols).collect()
    assert links == {(r["repo_id"], r["claim_id"]): r["related"] for r in related} == {("r", "1"): 5, ("r", "2"): 2}


def test_versions_of_many_digits(spark):
    from auditframe.operators.history import recent_versions

    tags = ["v" + "9" * 10_001, "v1" + "0" * 10_001, "v2", "v10"]
    rows = [("r", t, None, "") for t in tags]
    df = spark.createDataFrame(rows, "repo_id string, tag string, ts timestamp, message string")
    found = recent_versions(df, 10)
    assert [r["tag"] for r in found.orderBy("rank").collect()] == [tags[1], tags[0], "v10", "v2"]
