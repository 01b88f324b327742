"""Test frameworks, coverage artefacts, benchmarks and CI, all found by file names alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import fixed_values as fixed
from auditframe.functions.classify import any_of, glob_matches
from auditframe.functions.text import basename
from auditframe.operators.grouping import By, join_groups, top_k_distinct
from auditframe.sources.reports import manifest_dependencies, uses_framework

REPO = ("repo_id",)


def _indicated(path: Column, indicator: str) -> Column:
    """The path that an indicator reports, else NULL: globs at any depth, plain names in the root only."""
    if "*" in indicator:
        return F.when(glob_matches(path, indicator), path)
    if indicator.endswith("/"):
        return F.when(path.startswith(indicator), F.lit(indicator))
    return F.when(path == indicator, path)


Entry = tuple[tuple[str, ...], Column]


def _exploded(files: DataFrame, entries: list[Entry], names: list[str], by: By) -> DataFrame:
    """One row per file and entry that matches it, from one pass over the names."""
    structs = [
        F.when(
            found.isNotNull(),
            F.struct(*[F.lit(v).alias(n) for n, v in zip(names, key, strict=True)], found.alias("file")),
        )
        for key, found in entries
    ]
    return files.select(*by, F.inline(F.array_compact(F.array(*structs))))


def _by_directories(files: DataFrame, entries: list[Entry], names: list[str], by: By) -> DataFrame:
    """As ``_exploded``, but a directory, which each file below it reports, comes once and not once per file.

    Only entries of directories, whose name ends in a slash, are made distinct; a task sends each of them at most once.
    """
    directories = [e for e in entries if e[0][-1].endswith("/")]
    single = _exploded(files, [e for e in entries if not e[0][-1].endswith("/")], names, by)
    return single.unionByName(_exploded(files, directories, names, by).distinct()) if directories else single


def _framework_entries() -> list[Entry]:
    path = F.col("path")
    return [
        ((language, framework, indicator), _indicated(path, indicator))
        for (language, framework), indicators in fixed.TEST_INDICATORS.items()
        for indicator in indicators
    ]


def framework_files(files: DataFrame, by: By = REPO) -> DataFrame:
    """Files that indicate a test framework."""
    return _exploded(files, _framework_entries(), ["language", "framework", "indicator"], by)


def manifest_frameworks(files: DataFrame, by: By = REPO) -> DataFrame:
    """Frameworks that the package manifest in the root depends on."""
    dependencies = manifest_dependencies(F.col("text"))
    entries = [
        ((language, framework, "dependency"), F.when(uses_framework(F.col("deps"), F.lit(framework)), F.col("path")))
        for language, framework in fixed.TEST_INDICATORS
        if language in fixed.MANIFEST_LANGUAGES
    ]
    manifests = files.filter(F.col("path") == "package.json").withColumn("deps", dependencies)
    return _exploded(manifests, entries, ["language", "framework", "indicator"], by)


def test_frameworks(files: DataFrame, examples: int = 5, by: By = REPO) -> DataFrame:
    """Detected frameworks with up to ``examples`` files per indicator."""
    names = ["language", "framework", "indicator"]
    found = _by_directories(files, _framework_entries(), names, by).unionByName(manifest_frameworks(files, by))
    listed = top_k_distinct(found, examples, "file", [*by, *names])
    in_order = F.array_sort(F.collect_list(F.struct("indicator", "rank", "file")))
    return listed.groupBy(*by, "language", "framework").agg(F.transform(in_order, lambda x: x["file"]).alias("files"))


def detected_frameworks(files: DataFrame, by: By = REPO) -> DataFrame:
    """Presence only: at most one row per repository and framework."""
    found = framework_files(files, by).unionByName(manifest_frameworks(files, by))
    return found.select(*by, "language", "framework").distinct()


def _artefact(path: Column, pattern: str) -> Column:
    """The file or directory that a coverage pattern finds, at any depth."""
    if pattern.endswith("/"):
        directory = pattern.rstrip("/")
        found = F.regexp_extract(path, f"^((?:.*?/)?\\Q{directory}\\E)/", 1)
        return F.nullif(found, F.lit(""))
    return F.when(glob_matches(path, pattern), path)


def coverage_artifacts(files: DataFrame, examples: int = 5, by: By = REPO) -> DataFrame:
    """Coverage reports per language, up to ``examples`` per pattern."""
    path = F.col("path")
    entries = [
        ((language, pattern), _artefact(path, pattern))
        for language, patterns in fixed.COVERAGE_ARTIFACTS.items()
        for pattern in patterns
    ]
    found = _by_directories(files, entries, ["language", "pattern"], by)
    return top_k_distinct(found, examples, "file", [*by, "language", "pattern"])


def benchmark_files(files: DataFrame, by: By = REPO) -> DataFrame:
    """The first file with a benchmark in its name, by the order of the name parts; NULL if none."""
    name = basename(F.col("path"))
    firsts = [F.min(F.when(name.contains(part), F.col("path"))) for part in fixed.BENCHMARK_NAME_PARTS]
    return files.groupBy(*by).agg(F.coalesce(*firsts).alias("benchmark_file"))


def has_ci(files: DataFrame, by: By = REPO) -> DataFrame:
    """Whether a CI configuration exists, as a file or as a directory with files."""
    path = F.col("path")
    present = any_of([(path == ci) | path.startswith(ci + "/") for ci in fixed.CI_PATHS])
    return files.groupBy(*by).agg(F.coalesce(F.bool_or(present), F.lit(False)).alias("has_ci"))


def frameworks_summary(files: DataFrame, by: By = REPO) -> DataFrame:
    """Number and sorted names of the frameworks in a repository, at most one per table entry."""
    found = detected_frameworks(files, by)
    names = F.array_sort(F.collect_set(F.concat_ws("_", "language", "framework")))
    summary = found.groupBy(*by).agg(F.count("*").alias("frameworks"), names.alias("frameworks_used"))
    repositories = files.select(*by).distinct() if by else None
    return join_groups(repositories, summary, by).fillna(0, ["frameworks"]) if by else summary
