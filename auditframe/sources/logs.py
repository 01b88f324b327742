"""Text logs as tables.

A log that fits a cell is taken apart inside its row, by patterns over the whole text or over the array
of its lines: no shuffle, and a lost task repeats only its own rows. Logs given as files are read by blocks, and
logs given as lines are joined and filled by blocks of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditframe.functions import fixed_values as fixed
from auditframe.functions.text import ANY_CASE, SPACE, find_all, first_match, is_blank, let, lines, strip, whole_number
from auditframe.operators.grouping import By, forward_fill

# --- commit logs ----------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(log_id, line_no, line)`` of text logs, one log per file, lines numbered from 0.

    Files are read in blocks by many tasks, a line that crosses a border by the task that it begins in. Each task
    counts its lines; sums over the blocks before give the number of a block's first line, so only one row per
    block is shuffled and a log of any size has its lines numbered as if it were read in one go. Lines end at line feeds
    alone; a log that ends with one has an empty last line. An empty log has no lines.
    """
    texts = spark.read.format("text").option("lineSep", "\n").load(path)
    block = {"log_id": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start")}
    # Rows of a block follow one another; two scans of the same files deal them out alike.
    rows = texts.select(*[c.alias(name) for name, c in block.items()], F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blocks = rows.groupBy("log_id", "start").agg(
        F.min("at").alias("first"), F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes")
    )
    earlier = Window.partitionBy("log_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first"))
    numbered = rows.join(places.select("log_id", "start", "before"), ["log_id", "start"])
    numbered = numbered.select("log_id", (F.col("before") + F.col("at")).alias("line_no"), "line")
    totals = blocks.groupBy("log_id").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("log_id"), "length")
    # Counted with a line feed each, lines add up to the file's length, or to one more where the last has none. Three
    # bytes are missing where the reader has dropped a byte order mark.
    ended = sizes.join(totals, "log_id", "left").fillna(0, ["lines", "bytes"]).filter((F.col("bytes") - F.col("length")) % 3 == 0)
    return numbered.unionByName(ended.select("log_id", F.col("lines").alias("line_no"), F.lit("").alias("line")))


def commit_log(logs: DataFrame, line: str = "line") -> DataFrame:
    """Commits from lines ``hash|epoch|author|email|subject``.

    At most four splits, so the subject may hold bars; shorter lines are dropped.
    """
    parts = F.split(line, r"\|", 5)
    kept = [c for c in logs.columns if c != line]
    return logs.select(*kept, parts.alias("p")).filter(F.size("p") >= 5).select(
        *kept,
        F.get("p", F.lit(0)).alias("hash"),
        F.timestamp_seconds(F.get("p", F.lit(1)).try_cast("bigint")).alias("ts"),
        F.get("p", F.lit(2)).alias("author"),
        F.get("p", F.lit(3)).alias("email"),
        F.get("p", F.lit(4)).alias("subject"),
    )


def commit_file_log(
    logs: DataFrame, by: By = ("log_id",), line_no: str = "line_no", line: str = "line"
) -> DataFrame:
    """Touched files from blocks: an ``epoch|`` header, then one file per line until the next header."""
    text = F.col(line)
    is_header = text.contains("|")
    epoch = F.substring_index(text, "|", 1).try_cast("bigint")
    marked = logs.filter(text != "").withColumn("epoch", F.when(is_header, epoch))
    filled = forward_fill(marked, "epoch", line_no, by, filled="header")
    return filled.filter(~is_header & F.col("header").isNotNull()).select(
        *by, F.col(line_no), F.timestamp_seconds("header").alias("ts"), text.alias("path")
    )


# --- checker logs, one log per row ----------------------------------------------------------------


def explode_lines(logs: DataFrame, column: str = "stdout") -> DataFrame:
    """One row per line; line numbers start at 1."""
    kept = [c for c in logs.columns if c != column]
    return logs.select(*kept, F.posexplode(lines(F.col(column))).alias("pos", "line")).select(
        *kept, (F.col("pos") + 1).alias("line_no"), "line"
    )


def json_lines(logs: DataFrame, column: str = "stdout") -> DataFrame:
    """Lines that hold one JSON value each; all others are skipped."""
    return explode_lines(logs, column).filter((F.col("line") != "") & F.try_parse_json("line").isNotNull())


def type_check_lines(logs: DataFrame, column: str = "stdout") -> DataFrame:
    """Findings from ``file:line: kind: message``; the message may hold colons."""
    kept = [c for c in logs.columns if c != column]
    exploded = explode_lines(logs, column).withColumn("p", F.split("line", ":", 4)).filter(F.size("p") >= 4)
    return exploded.select(
        *kept,
        "line_no",
        F.col("p")[0].alias("path"),
        F.col("p")[1].alias("line"),
        strip(F.col("p")[2]).alias("kind"),
        strip(F.col("p")[3]).alias("message"),
    )


def compiler_lines(logs: DataFrame, column: str = "stdout") -> DataFrame:
    """Trimmed lines that hold a position in parentheses."""
    kept = [c for c in logs.columns if c != column]
    hits = explode_lines(logs, column).filter(F.col("line").contains("(") & F.col("line").contains(")"))
    return hits.select(*kept, "line_no", strip(F.col("line")).alias("message"))


def complexity_lines(logs: DataFrame, column: str = "stdout") -> DataFrame:
    """Function complexities from ``complexity package function file:line:column``."""
    kept = [c for c in logs.columns if c != column]
    words = F.split(strip(F.col("line")), f"{SPACE}+")
    exploded = explode_lines(logs, column).withColumn("p", words).filter(F.size("p") >= 4)
    return exploded.select(
        *kept,
        "line_no",
        whole_number(F.col("p")[0], "int").alias("complexity"),
        F.col("p")[1].alias("package"),
        F.col("p")[2].alias("name"),
        F.substring_index(F.element_at("p", -1), ":", 1).alias("path"),
    ).filter(F.col("complexity").isNotNull())


def assertion_failures(stdout: Column, before: int = 2, after: int = 2) -> Column:
    """Failed assertions with the lines around them, as an array of structs in line order."""

    def found(every: Column) -> Column:
        def around(line: Column, i: Column) -> Column:
            start = F.greatest(i - before, F.lit(0))
            context = F.slice(every, start + 1, i + after + 1 - start)
            hit = line.contains("VERIFICATION FAILED") | line.contains("assertion")
            return F.when(hit, F.struct((i + 1).alias("line_no"), strip(line).alias("line"), context.alias("context")))

        return F.array_compact(F.transform(every, around))

    # The log is split once, not for every hit.
    return let(lines(stdout), found)


def proof_goals(stdout: Column, numeric: bool = False) -> Column:
    """Proved goals, all goals, whole percent.

    Counts the two words; with ``numeric`` reads the numbers behind ``Proved:`` and ``Total:`` instead.
    """
    if numeric:
        proved = F.coalesce(first_match(stdout, r"Proved:\s*([0-9]+)").try_cast("bigint"), F.lit(0))
        total = F.coalesce(first_match(stdout, r"Total:\s*([0-9]+)").try_cast("bigint"), F.lit(0))
        percentage = F.round(F.coalesce(F.try_divide(proved * 100, total), F.lit(0.0)), 2)
    else:
        proved = F.regexp_count(stdout, F.lit("Proved")).cast("bigint")
        total = F.regexp_count(stdout, F.lit("Goal")).cast("bigint")
        percentage = F.floor(F.coalesce(F.try_divide(proved, total) * 100, F.lit(0.0)))
    return F.struct(proved.alias("proved"), total.alias("total"), percentage.alias("percentage"))


def counterexamples(stdout: Column) -> Column:
    """Blocks that a ``Counterexample found`` line opens; their further non-blank lines are the inputs."""
    blocks = F.split(stdout, r"(?dm)(?=^.*Counterexample found)")

    def parsed(block: Column) -> Column:
        rows = lines(block)
        rest = F.filter(F.slice(rows, F.lit(2), F.size(rows)), lambda line: ~is_blank(line))
        return F.struct(F.element_at(rows, 1).alias("description"), F.transform(rest, strip).alias("inputs"))

    # Whatever stands before the first block has no header and is dropped.
    return F.transform(
        F.filter(blocks, lambda b: F.substring_index(b, "\n", 1).contains("Counterexample found")), parsed
    )


# --- test logs ------------------------------------------------------------------------------------


def stdout_summary(stdout: Column, framework: Column) -> Column:
    """Test counts read from a runner's output; the first match of each pattern counts.

    Errors count as failures; the total is the sum of the others unless the output states it. Unknown
    frameworks yield zeros.
    """
    zero = F.lit(0).cast("bigint")

    def number(runner: str, name: str) -> Column:
        pattern = fixed.STDOUT_COUNTS[runner].get(name)
        if pattern is None:
            return zero
        # No match reads as 0. A cast that fails, as of an empty text, costs more than all patterns together.
        digits = F.concat(F.lit("0"), F.regexp_extract(stdout, ANY_CASE + pattern, 1))
        return F.coalesce(digits.try_cast("bigint"), zero)

    def matches(pattern: str) -> Column:
        return F.coalesce(F.regexp_count(stdout, F.lit(pattern)).cast("bigint"), zero)

    def counts(passed: Column, failed: Column, skipped: Column, stated: Column) -> Column:
        return F.struct(
            passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"), stated.alias("stated")
        )

    read = F.when(framework == "gotest", counts(matches(fixed.GO_PASS_LINE), matches(fixed.GO_FAIL_LINE), zero, zero))
    for runner in fixed.STDOUT_COUNTS:
        failed = number(runner, "failed") + number(runner, "errors")
        found = counts(number(runner, "passed"), failed, number(runner, "skipped"), number(runner, "total"))
        read = read.when(framework == runner, found)

    def summed(n: Column) -> Column:
        total = F.when(n["stated"] == 0, n["passed"] + n["failed"] + n["skipped"]).otherwise(n["stated"])
        return F.struct(total.alias("total"), *[n[c].alias(c) for c in ("passed", "failed", "skipped")])

    # A row goes through its own runner's patterns, each once.
    return let(read.otherwise(counts(zero, zero, zero, zero)), summed)


