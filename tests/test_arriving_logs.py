"""Logs in parts give the rows of the batch operator, whatever the parts and whenever the stream is restarted."""

from __future__ import annotations

import random
import time
import uuid
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from auditframe.sources import logs
from auditframe.streaming import arriving_logs, continuous


def drain(spark, folder, out, name, parts_per_batch=1000):
    rows = arriving_logs.commit_files_of_parts(arriving_logs.read_parts(spark, str(folder), parts_per_batch))
    continuous.write_stream(rows, str(out), name).awaitTermination()


def of_batch(spark, texts):
    rows = [(log, i, line) for log, text in texts.items() for i, line in enumerate(text.split("\n"))]
    touched = logs.commit_file_log(spark.createDataFrame(rows, "log_id string, line_no bigint, line string"))
    return sorted((r["log_id"], r["ts"], r["path"]) for r in touched.collect())


def of_stream(spark, out):
    return sorted((r["log_id"], r["ts"], r["path"]) for r in spark.read.schema(arriving_logs.ROWS).parquet(str(out)).collect())


def put(folder: Path, log: str, part: str, lines: list[str]):
    (folder / log).mkdir(parents=True, exist_ok=True)
    (folder / log / part).write_text("\n".join(lines))


def test_header_in_an_earlier_part_and_a_restart(spark, tmp_path):
    name, given, out = uuid.uuid4().hex, tmp_path / "in", tmp_path / "out"
    parts = [["lost.py", "100|", "a.py", ""], ["b.py", "c.py"], ["d.py", "x|bad", "e.py", "200|", "f.py"], [""], ["g.py"]]
    for i, lines in enumerate(parts):
        put(given, "one", f"{i:03d}", lines)
        if i == 1:
            put(given, "two", "000", ["never.py", "300|", "z.py"])
        drain(spark, given, out, name)  # a new query each time, from the state of the one before
    whole = {"one": "\n".join("\n".join(p) for p in parts), "two": "never.py\n300|\nz.py"}
    got = of_stream(spark, out)
    assert got == of_batch(spark, whole)
    assert [p for log, _, p in got if log == "one"] == ["a.py", "b.py", "c.py", "d.py", "e.py", "f.py", "g.py"]
    drain(spark, given, out, name)
    assert of_stream(spark, out) == got  # nothing new, nothing twice


def test_random_logs_in_random_parts(spark, tmp_path):
    rng = random.Random(5)
    whole = {}
    for log in ("a", "b", "hot"):
        lines = []
        for i in range(400 if log == "hot" else 40):
            lines.append(rng.choice([f"{i}|", "bad|", "", f"p{i}.py", f"p{i}.py", "same.py"]))
        cuts = sorted(rng.sample(range(1, len(lines)), 5))
        for k, (start, end) in enumerate(zip([0, *cuts], [*cuts, len(lines)], strict=True)):
            put(tmp_path / "in", log, f"{k:03d}", lines[start:end])
        whole[log] = "\n".join(lines)
    drain(spark, tmp_path / "in", tmp_path / "out", uuid.uuid4().hex)
    assert of_stream(spark, tmp_path / "out") == of_batch(spark, whole)


def test_line_numbers_are_those_of_the_part(spark, tmp_path):
    put(tmp_path / "in", "a", "0", ["1|", "", "x", "2|", "y"])
    put(tmp_path / "in", "a", "1", ["", "z"])
    drain(spark, tmp_path / "in", tmp_path / "out", uuid.uuid4().hex)
    rows = spark.read.schema(arriving_logs.ROWS).parquet(str(tmp_path / "out")).orderBy("part", "line_no")
    assert [tuple(r) for r in rows.select("part", "line_no", F.unix_seconds("ts"), "path").collect()] == [
        ("0", 2, 1, "x"), ("0", 4, 2, "y"), ("1", 1, 2, "z")
    ]


def test_a_part_out_of_order_ends_the_stream(spark, tmp_path):
    name = uuid.uuid4().hex
    put(tmp_path / "in", "a", "2", ["1|", "x"])
    drain(spark, tmp_path / "in", tmp_path / "out", name)
    put(tmp_path / "in", "a", "1", ["y"])
    with pytest.raises(StreamingQueryException):
        drain(spark, tmp_path / "in", tmp_path / "out", name)


def test_rows_hold_the_lines_of_one_header(spark, tmp_path):
    """A part of many headers is taken apart once: work and rows are linear in its lines, not headers times lines."""
    lines = ["lost.py", *[line for i in range(90_000) for line in (f"{i}|", f"p{i}.py")], "x|bad", "last.py"]
    put(tmp_path / "in", "a", "0", lines)
    started = time.monotonic()
    drain(spark, tmp_path / "in", tmp_path / "out", uuid.uuid4().hex)
    seconds = time.monotonic() - started
    rows = spark.read.schema(arriving_logs.ROWS).parquet(str(tmp_path / "out"))
    expected = [(2 * i + 2, i, f"p{i}.py") for i in range(90_000)] + [(180_002, 89_999, "last.py")]
    got = rows.select("line_no", F.unix_seconds("ts"), "path").orderBy("line_no")
    assert [tuple(r) for r in got.collect()] == expected
    assert seconds < 50
