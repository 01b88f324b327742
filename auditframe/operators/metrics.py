"""Language census, line counts and complexity statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import classify
from auditframe.functions.fixed_values import COMPLEXITY_BINS
from auditframe.operators.facts import fact
from auditframe.operators.grouping import By, join_groups, share, top_k, with_total
from auditframe.sources.files import without_excluded

REPO = ("repo_id",)


# --- languages ------------------------------------------------------------------------------------


def language_files(files: DataFrame) -> DataFrame:
    """Files of a known language, outside excluded directories; texts are not read."""
    known = without_excluded(files, "census").withColumn("language", classify.language(F.col("path")))
    return known.filter(F.col("language").isNotNull()).drop("text")


def language_census(files: DataFrame, by: By = REPO) -> DataFrame:
    """Files and percentage per language. The files of a language stay rows of ``language_files``."""
    counts = language_files(files).groupBy(*by, "language").agg(F.count("*").alias("files"))
    totals = with_total(counts, "files", by, "total_files")
    return totals.withColumn("percentage", share(F.col("files"), F.col("total_files")))


def primary_language(files: DataFrame, by: By = REPO) -> DataFrame:
    """Number of files and the most frequent language; ties go to the first name."""
    counts = language_files(files).groupBy(*by, "language").agg(F.count("*").alias("files"))
    order = F.struct(-F.col("files"), F.col("language"))
    return counts.groupBy(*by).agg(
        F.sum("files").alias("total_files"), F.min_by("language", order).alias("primary_language")
    )


def report_languages(files: DataFrame, by: By = REPO) -> DataFrame:
    """Sorted names of the coarse language groups, at most eight."""
    named = files.select(*by, classify.report_language(F.col("path")).alias("language"))
    return named.groupBy(*by).agg(F.array_sort(F.collect_set("language")).alias("languages"))


# --- lines ----------------------------------------------------------------------------------------


def line_metrics(files: DataFrame, by: By = REPO) -> DataFrame:
    """Line counts per source file, and whether the file has too few comments."""
    counted = files.select(*by, "path", fact(files, "lines").alias("n")).filter(F.col("n").isNotNull())
    counted = counted.select(*by, "path", "n.*")
    sloc = F.col("loc") - F.col("comments") - F.col("blank")
    return counted.withColumn("sloc", sloc).withColumn(
        "under_commented", classify.is_under_commented(F.col("comments"), F.col("sloc"))
    )


# --- complexity -----------------------------------------------------------------------------------


def ranked_functions(functions: DataFrame) -> DataFrame:
    return functions.withColumn("rank", classify.complexity_rank(F.col("complexity")))


def _bins(complexity: Column) -> list[Column]:
    rank = classify.complexity_rank(complexity)
    return [F.count_if(rank == letter).alias(label) for letter, label, _ in COMPLEXITY_BINS]


def complexity_distribution(functions: DataFrame, by: By = REPO) -> DataFrame:
    """Functions per bin; empty bins count 0, and without groups an empty table has all six."""
    wide = functions.groupBy(*by).agg(*_bins(F.col("complexity")))
    labels = [label for _, label, _ in COMPLEXITY_BINS]
    return wide.unpivot(list(by), labels, "bin", "functions")


def file_rollup(functions: DataFrame, by: By = REPO) -> DataFrame:
    """Functions, total and mean complexity per file. Functions themselves stay rows."""
    return functions.groupBy(*by, "path").agg(
        F.count("complexity").alias("functions"),
        F.sum("complexity").alias("total_complexity"),
        F.avg("complexity").alias("average_complexity"),
    )


def file_metrics(functions: DataFrame, lines: DataFrame, by: By = REPO) -> DataFrame:
    """Complexity per file with the file's line count where the file could be read."""
    loc = lines.groupBy(*by, "path").agg(F.max("loc").alias("loc"))
    return join_groups(file_rollup(functions, by), loc, [*by, "path"])


def complexity_summary(metrics: DataFrame, by: By = REPO) -> DataFrame:
    """Totals per repository; the average is per file, not per function."""
    total = F.coalesce(F.sum("total_complexity"), F.lit(0))
    files = F.count("*")
    return metrics.groupBy(*by).agg(
        files.alias("total_files"),
        total.alias("total_complexity"),
        F.coalesce(F.sum("loc"), F.lit(0)).cast("bigint").alias("total_loc"),
        F.coalesce(F.try_divide(total, files), F.lit(0.0)).alias("average_complexity"),
    )


def total_lines(lines: DataFrame, by: By = REPO) -> DataFrame:
    """Lines of all source files, also of those without a function."""
    return lines.groupBy(*by).agg(F.sum("loc").cast("bigint").alias("total_loc"))


def summary_with_lines(file_metrics: DataFrame, lines: DataFrame, by: By = REPO) -> DataFrame:
    """Complexities of the files with functions, and the lines of all source files."""
    summary = complexity_summary(file_metrics, by).drop("total_loc")
    return join_groups(summary, total_lines(lines, by), by).fillna(0, ["total_loc"])


def top_complex_files(metrics: DataFrame, k: int = 10, by: By = REPO) -> DataFrame:
    return top_k(metrics, k, [F.desc("total_complexity"), F.asc("path")], by)


def share_of_total(df: DataFrame, group: str, by: By = REPO) -> DataFrame:
    """Rows and percentage per value of ``group``."""
    counts = df.groupBy(*by, group).agg(F.count("*").alias("n"))
    return with_total(counts, "n", by).withColumn("percentage", share(F.col("n"), F.col("total")))
