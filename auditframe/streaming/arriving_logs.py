"""Commit-file logs that arrive in parts: a header may lie in an earlier part than the files below it.

Each file is a part of a log, the folder it lies in names the log, and the parts of a log are written in the order
of their names. Parts end at line ends and fit a cell; a log as a whole may grow for ever. What follows a part's own
first header is resolved inside its row, without state. Only the lines before it and the part's last header go
through the state, which keeps one epoch and one part name per log; so even a log with a third of all lines brings
one short row per part, not its lines, to the task that keeps its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditframe.functions.text import line_no_of, line_text_of

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# In numbered lines, the only bars are those of headers.
_BEFORE_HEADER = r"(?dm)(?=^[0-9]+:[^|\n]*\|)"
ROWS = "log_id string, part string, line_no bigint, ts timestamp, path string"


def read_parts(spark: SparkSession, folder: str, parts_per_batch: int | None = 1000) -> DataFrame:
    """``(log_id, part, text)`` of new files at ``folder``/log/part; ``None`` takes all that are there as one batch.

    Batches take files by their times, so times have to follow the names within a log. Sets the session's
    state store to the one that such state needs.
    """
    spark.conf.set(STATE_STORE, ROCKSDB)
    texts = spark.readStream.schema("value string").format("text").option("wholetext", True)
    if parts_per_batch is not None:
        texts = texts.option("maxFilesPerTrigger", parts_per_batch)
    texts = texts.load(f"{folder.rstrip('/')}/*/*")
    names = F.split(F.col("_metadata.file_path"), "/")
    return texts.select(
        F.element_at(names, -2).alias("log_id"), F.element_at(names, -1).alias("part"), F.col("value").alias("text")
    )


def _files(df: DataFrame, first: Column, epoch: Column, below: Column) -> DataFrame:
    """A row per file named in the lines ``below``; the first of them has the number ``first``."""
    rows = df.select("log_id", "part", first.alias("first"), epoch.alias("epoch"), F.posexplode(below).alias("at", "path"))
    named = rows.filter(F.col("epoch").isNotNull() & (F.col("path") != "") & ~F.col("path").contains("|"))
    number = (F.col("first") + F.col("at")).cast("bigint").alias("line_no")
    return named.select("log_id", "part", number, F.timestamp_seconds("epoch").alias("ts"), "path")


class LastHeader(StatefulProcessor):
    """Gives the lines that begin a part the last epoch of the log's earlier parts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "part string, epoch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One short row per part of a micro-batch, whose number ``parts_per_batch`` bounds.
        parts = pd.concat(list(rows)).sort_values("part", kind="stable")
        before, epoch = self._last.get() if self._last.exists() else (None, None)
        carried = []
        for part, last in zip(parts["part"], parts["last"], strict=True):
            if before is not None and part <= before:
                raise ValueError(f"part {part} of log {key[0]} arrived after part {before}")
            carried.append(epoch)
            before, epoch = part, int(last) if last else epoch
        self._last.update((before, epoch))
        yield pd.DataFrame(
            {"log_id": key[0], "part": parts["part"], "epoch": pd.array(carried, "Int64"), "leading": parts["leading"]}
        )

    def close(self) -> None:
        pass


def commit_files_of_parts(parts: DataFrame) -> DataFrame:
    """Touched files of arriving parts, with the time of the last header at or before them.

    The rows are those of ``logs.commit_file_log`` on the whole log: files before any header are left out, a header
    without a number leaves the one before it in force, empty lines are skipped. ``line_no`` counts from 0 within the
    part. A null text is an empty part. A part whose name is not after all earlier ones of its log ends the stream, as
    rows already given out could have needed its header.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    epoch_of = lambda line: F.when(line.contains("|"), F.substring_index(line, "|", 1).try_cast("bigint"))
    places = F.transform("lines", lambda line, i: F.struct(i.alias("at"), epoch_of(line).alias("epoch")))
    split = parts.select("log_id", "part", lines.alias("lines"))
    split = split.withColumn("heads", F.filter(places, lambda x: x["epoch"].isNotNull()))
    n = F.size("heads")

    # Below each header of the part: the lines up to the next one. A part's text is cut before its headers, so that a
    # row holds the lines of one header only; lines that have a bar but no number are empty there, and all are numbered.
    held = F.transform("lines", lambda line: F.when(line.contains("|") & epoch_of(line).isNull(), "").otherwise(line))
    numbered = F.array_join(F.transform(held, lambda line, i: F.concat(i.cast("string"), F.lit(":"), line)), "\n")
    cut = split.filter(n > 0).select("log_id", "part", F.explode(F.split(numbered, _BEFORE_HEADER)).alias("block"))
    # The block before the first header, if any, holds no bar.
    own = cut.filter(F.col("block").contains("|")).withColumn("rows", F.split("block", "\n"))
    head = F.element_at("rows", 1)
    epoch = F.substring_index(line_text_of(head), "|", 1).try_cast("bigint")
    below = F.transform(F.slice("rows", F.lit(2), F.size("rows")), line_text_of)
    resolved = _files(own, line_no_of(head) + 1, epoch, below)

    # Before its first header: the state knows. Epochs pass as texts, which Python keeps exact next to nulls.
    leading = F.slice("lines", F.lit(1), F.when(n > 0, F.get("heads.at", F.lit(0))).otherwise(F.size("lines")))
    waiting = split.select("log_id", "part", F.get("heads.epoch", n - 1).cast("string").alias("last"), leading.alias("leading"))
    carried = waiting.groupBy("log_id").transformWithStateInPandas(
        LastHeader(), "log_id string, part string, epoch bigint, leading array<string>", "append", "none"
    )
    return resolved.unionByName(_files(carried, F.lit(0), F.col("epoch"), F.col("leading")))
