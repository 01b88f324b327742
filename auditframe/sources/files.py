"""Source trees as tables of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.classify import in_excluded_directory, is_documentation
from auditframe.functions.fixed_values import SOURCE_SUFFIXES
from auditframe.functions.text import has_suffix, replace_matches


def read_files(
    spark: SparkSession, root: str, glob: str | None = None, repositories: bool = False
) -> DataFrame:
    """``files(repo_id, path, text)`` of every file below ``root``, one row per file.

    ``glob`` restricts names before anything is read. With ``repositories`` the first directory below
    ``root`` names the repository and paths are relative to it. Line ends become line feeds.
    """
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # The metadata column holds an encoded URI; a plus sign in it stands for itself.
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    marker = "/" + root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    below = F.substr(uri, F.locate(marker, uri) + len(marker))
    text = replace_matches(F.col("value"), "\r\n?", "\n", needs=("\r",))
    files = reader.load(root).select(below.alias("path"), text.alias("text"))
    if not repositories:
        return files.select(F.lit("").alias("repo_id"), "path", "text")
    return files.select(
        F.substring_index("path", "/", 1).alias("repo_id"),
        F.regexp_replace("path", "^[^/]*/", "").alias("path"),
        "text",
    )


def without_excluded(files: DataFrame, caller: str) -> DataFrame:
    """Drop files below (or named like) a directory the caller skips; whole parts count, not substrings."""
    return files.filter(~in_excluded_directory(F.col("path"), caller))


def source_files(files: DataFrame, caller: str) -> DataFrame:
    """The files one language's analysis looks at."""
    return without_excluded(files.filter(has_suffix(F.col("path"), SOURCE_SUFFIXES[caller])), caller)


def documentation_files(files: DataFrame) -> DataFrame:
    """Documentation files, each path once. Only names are looked at, so texts need not be read."""
    return files.filter(is_documentation(F.col("path")))
