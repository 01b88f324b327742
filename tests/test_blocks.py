"""Blocks of Markdown, raw text of HTML, and logs read by blocks of files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from auditframe.functions import documents
from auditframe.sources import logs


def units(spark, function, text):
    df = spark.createDataFrame([(text,)], "text string").select(F.inline(function(F.col("text"))))
    return [(u.text, u.context) for u in df.collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("It supports\nall of\n  them.\n\nNext", [("It supports\nall of\nthem.", "General"), ("Next", "General")]),
        ("Title\n=====\nbody\nSub\n---\nmore", [("body", "Title"), ("more", "Sub")]),
        ("a\nb\n---\nc", [("a", "General"), ("c", "b")]),
        ("- one\n  wrapped\n  - nested\n    on\n* two", [("one\nwrapped", "General"), ("nested\non", "General"), ("two", "General")]),
        ("- item\n---\nx", [("item", "General"), ("x", "General")]),
        ("***\n- - -\n\n---\nx", [("x", "General")]),
        ("p\n```py\n# no\n\n- `x`\n```\n# Yes\nq", [("p", "General"), ("# no\n\n- `x`", "General"), ("q", "Yes")]),
        ("```\nopen\n# end", [("open\n# end", "General")]),
        ("```\na\n```\n```\nb\n```", [("a", "General"), ("b", "General")]),
        ("use ```x``` here\n# T\n```y```", [("use x here", "General"), ("y", "T")]),
        ("# A ##\n#### deep\ntext\n\n   \n## B\nlast", [("text", "A"), ("last", "B")]),
        ("", []),
        ("\n \n\t\n", []),
        ("===\n===\nx", [("===\n===\nx", "General")]),
    ],
)
def test_markdown_blocks(spark, text, expected):
    assert units(spark, documents.markdown_units, text) == expected


def test_a_long_markdown_text(spark):
    """Neither many blocks nor one very long block."""
    found = units(spark, documents.markdown_units, "- item\n" * 20_000 + "\n" + "word\n" * 50_000)
    assert len(found) == 20_001 and found[-1][0].count("\n") == 49_999


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>a</p><script>var s='<p>always fails</p>'</script><p>b</p>", ["a", "b"]),
        ("<STYLE>p{content:'<li>x</li>'}</STYLE ><li>y</li>", ["y"]),
        ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no</p>", ["yes"]),
        ("<!-- <script> --><p>a</p><script>1 <!-- 2</script><p>b</p>", ["a", "b"]),
        ("<p>a <script>x</script>b</p>", ["a b"]),
        ("<p>a</p><script>never closed <p>b</p>", ["a"]),
        ('<p title="x > y" data=\'</p>\'>a</p>', ["a"]),
        ("<p>don't <b>stop</b></p><li>a<ul><li>b</li></ul>c</li>", ["don't stop", "abc"]),
        ("", []),
    ],
)
def test_html_raw_text(spark, html, expected):
    assert [text for text, _ in units(spark, documents.html_units, html)] == expected


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_lines_of_logs_read_by_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(4)
    texts = {
        "long.log": "\n".join("é" * rng.randrange(60) + str(i) for i in range(3000)),
        "ended.log": "".join(f"{i}|x\r\n\n" for i in range(2000)),
        "wide.log": "a" * 20_000 + "\n" + "b" * 9_000 + "\nc\n",
        "feed.log": "\n",
        "one.log": "no line feed",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "mark.log").write_bytes(b"\xef\xbb\xbfx\ny\n")
    read = logs.read_lines(spark, str(tmp_path))
    tasks = spark.read.format("text").option("lineSep", "\n").load(str(tmp_path)).rdd.getNumPartitions()
    assert tasks > 20
    got = {}
    for row in read.collect():
        lines = got.setdefault(row.log_id.rsplit("/", 1)[1], {})
        assert row.line_no not in lines
        lines[row.line_no] = row.line
    expected = {name: dict(enumerate(text.split("\n"))) for name, text in texts.items()}
    assert got == {**expected, "mark.log": {0: "x", 1: "y", 2: ""}}


def test_touched_files_across_blocks(spark, tmp_path, small_blocks):
    """A header holds for the files after it, in whatever block they lie."""
    text = "".join(f"{1000 + i}|\n\n" + "".join(f"src/{i}/{k}.py\n" for k in range(300)) for i in range(5))
    (tmp_path / "files.log").write_text(text)
    found = logs.commit_file_log(logs.read_lines(spark, str(tmp_path))).select(F.unix_seconds("ts").alias("at"), "path").collect()
    assert sorted((r.at, r.path) for r in found) == sorted((1000 + i, f"src/{i}/{k}.py") for i in range(5) for k in range(300))
