"""W and U: top-k, time windows, shares, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.catalog.aggregates import (
    FILE_CHANGES, FILE_CHURN, FILE_ROLLUP, JUDGED_CLAIMS, STATIC_COUNTS, STATIC_VIEWS, static_findings,
)
from auditframe.catalog.joins import CORRELATED_VIEWS, correlated
from auditframe.catalog.registry import AS_OF_COMMITS, AS_OF_FILES, query, rounded, seconds
from auditframe.functions.fixed_values import ABANDONED_SUFFIXES, EXCLUDED_PARTS, HISTORY_CODE_SUFFIXES
from auditframe.operators import history, metrics, verdicts
from auditframe.session import stage
from auditframe.operators.findings import union_all
from auditframe.sources.bindings import Bindings
from auditframe.sources.files import without_excluded
from auditframe.sources.reports import manifest_dependencies, merge_maps

_AS_OF = f"TIMESTAMP '{AS_OF_FILES}'"


def _top(rows: str, order: str, k: int, by: str = "repo_id") -> str:
    over = f"PARTITION BY {by} " if by else ""
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER ({over}ORDER BY {order}) AS INT) AS rank FROM ({rows})) WHERE rank <= {k}"


@query("w1_most_changed_files", _top(FILE_CHANGES, "changes DESC, path", 20), ("commit_files",))
def most_changed_files(b: Bindings):
    return history.most_changed_files(b.commit_files, AS_OF_FILES)


@query(
    "w1_most_changed_files_overall",
    _top(FILE_CHANGES.replace("repo_id, path", "path"), "changes DESC, path", 20, ""),
    ("commit_files",),
)
def most_changed_files_overall(b: Bindings):
    return history.most_changed_files(b.commit_files, AS_OF_FILES, by=())


@query(
    "w2_high_churn_files",
    _top(f"SELECT * FROM ({FILE_CHURN}) WHERE changes > 2", "changes DESC, path", 10),
    ("commit_files",),
)
def high_churn_files(b: Bindings):
    return history.high_churn_files(b.commit_files, AS_OF_FILES, more_than=2)


@query("w2_stable_files", f"SELECT * FROM ({FILE_CHURN}) WHERE changes <= 2", ("commit_files",))
def stable_files(b: Bindings):
    return history.stable_files(b.commit_files, AS_OF_FILES, more_than=2)


_ADDED = f"""
    SELECT repo_id, path, min(ts) AS added FROM commit_files
    WHERE ts >= {_AS_OF} - INTERVAL 3 MONTH AND change = 'A' AND path <> '' GROUP BY repo_id, path"""


@query(
    "w3_recently_added_files",
    f"SELECT repo_id, path, strftime(added, '%Y-%m-%d %H:%M:%S') AS added_at, rank FROM ({_top(_ADDED, 'added DESC, path', 10)})",
    ("commit_files",),
)
def recently_added_files(b: Bindings):
    added = history.recently_added_files(b.commit_files, AS_OF_FILES)
    return added.withColumn("added_at", seconds("added_at"))


def _abandoned(rows: str) -> str:
    suffixes = "|".join(s[1:] for s in ABANDONED_SUFFIXES)
    return _top(
        f"""SELECT repo_id, path, CAST(floor((epoch({_AS_OF}) - epoch(ts)) / 86400) AS BIGINT) AS days_since_change
            FROM ({rows}) WHERE regexp_matches(path, '\\.({suffixes})$') AND epoch({_AS_OF}) - epoch(ts) > 365 * 86400""",
        "days_since_change DESC, path",
        10,
    )


_LAST_CHANGE = "SELECT repo_id, path, max(ts) AS ts FROM commit_files GROUP BY repo_id, path"


@query("w4_abandoned_files", _abandoned(_LAST_CHANGE), ("commit_files",))
def abandoned_files(b: Bindings):
    return history.abandoned_files(b.commit_files, AS_OF_FILES)


@query(
    "w5_file_ownership",
    _top(
        """SELECT repo_id, path, first(author ORDER BY n DESC, author) AS primary_maintainer, max(n) AS commits
           FROM (SELECT repo_id, path, author, count(DISTINCT hash) AS n FROM commit_files
                 WHERE regexp_matches(path, '(^|/)(README[^/]*|setup\\.py|pyproject\\.toml|package\\.json|Makefile|CMakeLists\\.txt|[^/]*\\.config\\.[^/]*|src/main\\.[^/]*)$')
                 GROUP BY ALL) GROUP BY repo_id, path""",
        "path",
        10,
    ),
    ("commit_files",),
)
def file_ownership(b: Bindings):
    return history.file_ownership(b.commit_files)


_IS_DOC = r"""(regexp_matches(path, '\.(md|rst|txt)$') OR regexp_matches(path, '(^|/)(README|CHANGELOG)[^/]*$')
               OR regexp_matches(path, '(^|/)docs/[^/]+$'))"""
_DOC_UPDATES = f"SELECT repo_id, path, max(ts) AS ts FROM commit_files WHERE {_IS_DOC} GROUP BY repo_id, path"


@query(
    "w6_latest_doc_updates",
    f"SELECT repo_id, path, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, rank FROM ({_top(_DOC_UPDATES, 'ts DESC, path', 10)})",
    ("commit_files",),
)
def latest_doc_updates(b: Bindings):
    return history.latest_doc_updates(b.commit_files).withColumn("ts", seconds("ts"))


_CODE = "|".join(s[1:] for s in HISTORY_CODE_SUFFIXES)
OUTDATED = f"""
    SELECT r.repo_id, r.path, CAST(floor((epoch({_AS_OF}) - epoch(r.ts)) / 86400) AS BIGINT) AS days_since_update
    FROM (SELECT repo_id, min(path) AS path, max(ts) AS ts FROM ({_DOC_UPDATES}) WHERE contains(lower(path), 'readme')
          GROUP BY repo_id) r
    JOIN (SELECT repo_id, count(*) + 2 * count(DISTINCT hash) - 1 AS lines FROM commit_files
          WHERE ts >= {_AS_OF} - INTERVAL 6 MONTH AND regexp_matches(path, '\\.({_CODE})$') GROUP BY repo_id) c
      ON c.repo_id = r.repo_id
    WHERE c.lines > 10 AND floor((epoch({_AS_OF}) - epoch(r.ts)) / 86400) > 30"""


@query("w7_outdated_docs", OUTDATED, ("commit_files",))
def outdated_docs(b: Bindings):
    return history.outdated_docs(b.commit_files, AS_OF_FILES)


FEATURE_COMMITS = f"""
    SELECT * FROM commits WHERE ts >= TIMESTAMP '{AS_OF_COMMITS}' - INTERVAL 1 YEAR
    AND regexp_matches(subject, '(?i)feat|feature|add|implement')"""


@query(
    "w8_recent_features",
    f"""
    SELECT repo_id, hash, author, subject, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, rank
    FROM ({_top(FEATURE_COMMITS, 'ts DESC, hash', 20)})""",
    ("commits",),
)
def recent_features(b: Bindings):
    return history.recent_features(b.commits, AS_OF_COMMITS).withColumn("ts", seconds("ts"))


_VERSIONS = r"""
    SELECT *, array_to_string(list_transform(regexp_extract_all(tag, '[0-9]+|[^0-9]+'),
        lambda x: CASE WHEN regexp_matches(x, '^[0-9]')
                       THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\1')) AS VARCHAR), 4, '0')
                            || regexp_replace(x, '^0+([0-9])', '\1') ELSE x END), '') AS version_key FROM tags"""


@query(
    "w9_recent_versions",
    f"""
    SELECT repo_id, tag, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, message, rank
    FROM ({_top(_VERSIONS, 'version_key DESC, ts DESC, message', 10)})""",
    ("tags",),
)
def recent_versions(b: Bindings):
    return history.recent_versions(b.tags).withColumn("ts", seconds("ts"))


@query("w10_top_complex_files", _top(FILE_ROLLUP, "total_complexity DESC, path", 10), ("function_metrics",))
def top_complex_files(b: Bindings):
    rollup = metrics.file_rollup(b.function_metrics).withColumn("average_complexity", rounded("average_complexity"))
    return metrics.top_complex_files(rollup)


@query(
    "w11_relative_windows",
    f"""
    SELECT span, repo_id, count(*) AS commits, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM (
        SELECT '1 year' AS span, * FROM commit_files WHERE ts >= {_AS_OF} - INTERVAL 1 YEAR
        UNION ALL SELECT '365 days', * FROM commit_files WHERE ts >= {_AS_OF} - INTERVAL 365 DAY
        UNION ALL SELECT '6 months', * FROM commit_files WHERE ts >= {_AS_OF} - INTERVAL 6 MONTH
        UNION ALL SELECT '3 months', * FROM commit_files WHERE ts >= {_AS_OF} - INTERVAL 3 MONTH)
    GROUP BY span, repo_id""",
    ("commit_files",),
)
def relative_windows(b: Bindings):
    spans = {"1 year": {"years": 1}, "365 days": {"days": 365}, "6 months": {"months": 6}, "3 months": {"months": 3}}
    windows = [history.since(b.commit_files, AS_OF_FILES, **s).withColumn("span", F.lit(n)) for n, s in spans.items()]
    grouped = union_all(windows).groupBy("span", "repo_id").agg(F.count("*").alias("commits"), F.min("ts").alias("first_ts"))
    return grouped.withColumn("first_ts", seconds("first_ts"))


@query(
    "w12_share_of_total",
    """
    SELECT source AS repo_id, lang, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS total,
           round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS percentage
    FROM documents GROUP BY source, lang""",
)
def share_of_total(b: Bindings):
    docs = b.documents.withColumnRenamed("source", "repo_id")
    return metrics.share_of_total(docs, "lang").withColumn("percentage", rounded("percentage"))


@query(
    "w12_author_share",
    """
    SELECT o_orderpriority AS author, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
           round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage
    FROM orders GROUP BY o_orderpriority""",
)
def author_share(b: Bindings):
    authors = b.orders.withColumnRenamed("o_orderpriority", "author")
    return metrics.share_of_total(authors, "author", by=()).withColumn("percentage", rounded("percentage"))


# --- set operations -------------------------------------------------------------------------------


@query(
    "u1_union_of_findings",
    f"SELECT repo_id, category, tool, count(*) AS n FROM ({STATIC_COUNTS} UNION ALL {STATIC_COUNTS}) GROUP BY ALL",
    STATIC_VIEWS,
)
def union_of_findings(b: Bindings):
    """A bag union keeps duplicates."""
    found = static_findings(b)
    return union_all([found, found]).groupBy("repo_id", "category", "tool").agg(F.count("*").alias("n"))


@query("u2_distinct_paths", "SELECT DISTINCT repo_id, path FROM commit_files", ("commit_files",))
def distinct_paths(b: Bindings):
    return b.commit_files.select("repo_id", "path").distinct()


@query(
    "u3_map_union",
    """
    SELECT manifest_id, CASE WHEN json_valid(manifest) THEN concat('left=1,shared=', json_extract_string(manifest,
           '$.dependencies.shared')) ELSE 'left=1,shared=0' END AS merged
    FROM manifests""",
    ("manifests",),
)
def map_union(b: Bindings):
    """The right map wins."""
    left = F.create_map(F.lit("left"), F.lit("1"), F.lit("shared"), F.lit("0"))
    shared = F.map_filter(manifest_dependencies(F.col("manifest")), lambda k, _: k == "shared")
    entries = F.array_sort(F.map_entries(merge_maps(left, shared)))
    merged = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return b.manifests.select("manifest_id", merged.alias("merged"))


_PYTHON = "[" + ", ".join(f"'{p}'" for p in EXCLUDED_PARTS["census"]) + "]"


@query(
    "u4_without_excluded",
    f"SELECT repo_id, path FROM project_files WHERE NOT list_has_any(string_split(path, '/'), {_PYTHON})",
    ("project_files",),
)
def without_excluded_paths(b: Bindings):
    return without_excluded(b.project_files.drop("text"), "census")


@query(
    "u4_unverifiable_claims",
    f"SELECT repo_id, claim_id FROM ({JUDGED_CLAIMS}) WHERE NOT verifiable",
    CORRELATED_VIEWS,
)
def unverifiable_claims(b: Bindings):
    """All claims less the verifiable ones, as whole rows."""
    claims = stage(verdicts.with_strategy(correlated(b)).select("repo_id", "claim_id", "verifiable"), "correlated")
    return claims.exceptAll(claims.filter("verifiable")).drop("verifiable")
