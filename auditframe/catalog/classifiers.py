"""P: projections, filters, classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.catalog.registry import (
    line_claims,
    query,
    rounded,
    sql_confidence,
    sql_lines,
    sql_method,
    sql_strip,
    sql_suffix,
    sql_verifiable,
    scanner_findings,
)
from auditframe.functions import classify
from auditframe.functions.fixed_values import (
    BREAKING_MARK,
    COMMIT_CATEGORY_WORDS,
    COMPLEXITY_BINS,
    LANGUAGE_BY_SUFFIX,
    REPORT_LANGUAGE_SUFFIXES,
    SEMVER,
)
from auditframe.operators import findings, history, metrics, verdicts
from auditframe.operators.findings import union_all
from auditframe.sources.bindings import Bindings

_BOTH = "(SELECT repo_id, path FROM files UNION ALL SELECT repo_id, path FROM project_files)"


def _paths(b: Bindings):
    return union_all([b.files.drop("text"), b.project_files.drop("text")])


LANGUAGE_CASES = " ".join(f"WHEN '{s}' THEN '{name}'" for s, name in LANGUAGE_BY_SUFFIX.items())


@query(
    "p1_language",
    f"""
    SELECT repo_id, path, CASE lower({sql_suffix('path')}) {LANGUAGE_CASES} END AS language
    FROM {_BOTH} WHERE CASE lower({sql_suffix('path')}) {LANGUAGE_CASES} END IS NOT NULL""",
    ("files", "project_files"),
)
def language(b: Bindings):
    named = _paths(b).withColumn("language", classify.language(F.col("path")))
    return named.filter(F.col("language").isNotNull())


_GROUPS = " ".join(f"WHEN '{s}' THEN '{g}'" for g, suffixes in REPORT_LANGUAGE_SUFFIXES.items() for s in suffixes)


@query(
    "p2_report_languages",
    f"""
    SELECT repo_id, string_agg(language, ',' ORDER BY language) AS languages
    FROM (SELECT DISTINCT repo_id, CASE {sql_suffix('path')} {_GROUPS} END AS language FROM {_BOTH})
    WHERE language IS NOT NULL GROUP BY repo_id""",
    ("files", "project_files"),
)
def report_languages(b: Bindings):
    named = metrics.report_languages(_paths(b))
    return named.select("repo_id", F.array_join("languages", ",").alias("languages"))


RANK_CASES = (
    "CASE "
    + " ".join(f"WHEN complexity <= {upper} THEN '{letter}'" for letter, _, upper in COMPLEXITY_BINS if upper)
    + f" ELSE '{COMPLEXITY_BINS[-1][0]}' END"
)


@query(
    "p3_complexity_rank",
    f"SELECT repo_id, path, name, lineno, complexity, {RANK_CASES} AS rank FROM function_metrics",
    ("function_metrics",),
)
def complexity_rank(b: Bindings):
    return metrics.ranked_functions(b.function_metrics)


def category_sql(name: str) -> str:
    words = rf"\b({'|'.join(COMMIT_CATEGORY_WORDS[name])})\b"
    if name == "breaking_changes":
        words += f"|{BREAKING_MARK}"
    return f"regexp_matches(lower(subject), '{words}')"


@query(
    "p4_commit_categories",
    "SELECT hash, " + ", ".join(f"{category_sql(n)} AS {n}" for n in COMMIT_CATEGORY_WORDS) + " FROM commits",
    ("commits",),
)
def commit_categories(b: Bindings):
    flags = classify.commit_categories(F.col("subject"))
    return b.commits.select("hash", *[flag.alias(name) for name, flag in flags.items()])


@query(
    "p5_feature_commits",
    "SELECT repo_id, hash, subject FROM commits WHERE regexp_matches(subject, '(?i)feat|feature|add|implement')",
    ("commits",),
)
def feature_commits(b: Bindings):
    return b.commits.filter(classify.is_feature_commit(F.col("subject"))).select("repo_id", "hash", "subject")


@query(
    "p6_semver",
    f"SELECT repo_id, tag, regexp_matches(tag, '{SEMVER}') AS is_semver, count(*) AS n FROM tags GROUP BY repo_id, tag",
    ("tags",),
)
def semver(b: Bindings):
    return (
        b.tags.groupBy("repo_id", "tag")
        .agg(F.count("*").alias("n"))
        .withColumn("is_semver", classify.is_semver(F.col("tag")))
    )


# A final line feed opens no further line.
_LINES = f"CASE WHEN text = '' THEN [] ELSE {sql_lines('CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END')} END"
_BARE = f"list_transform({_LINES}, lambda l: {sql_strip('l')})"
LINE_METRICS = f"""
    SELECT repo_id, path, language, loc, comments, blank, loc - comments - blank AS sloc,
           coalesce(comments, 0) < coalesce(loc - comments - blank, 1) * CAST(0.1 AS DOUBLE) AS under_commented
    FROM (
        SELECT repo_id, path, language,
               CAST(CASE WHEN language = 'Python' THEN len(bare)
                         WHEN language = 'JavaScript' THEN len(list_filter(bare, lambda l: l <> ''))
                         ELSE len(list_filter(bare, lambda l: l <> '' AND NOT starts_with(l, '//'))) END AS INT) AS loc,
               CASE WHEN language = 'Python' THEN CAST(len(list_filter(bare, lambda l: starts_with(l, '#'))) AS INT) END
                   AS comments,
               CASE WHEN language = 'Python' THEN CAST(len(list_filter(bare, lambda l: l = '')) AS INT) END AS blank
        FROM (SELECT repo_id, path, {_BARE} AS bare,
                     CASE {sql_suffix('path')} WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript'
                          WHEN '.go' THEN 'Go' WHEN '.java' THEN 'Java' END AS language
              FROM (SELECT * FROM files UNION ALL SELECT * FROM source_docs))
        WHERE language IS NOT NULL)"""


@query("p7_line_metrics", LINE_METRICS, ("files", "source_docs"))
def line_metrics(b: Bindings):
    return metrics.line_metrics(union_all([b.files, b.source_docs]))


@query(
    "p8_under_commented",
    f"SELECT repo_id, count(*) AS files, CAST(count_if(under_commented) AS BIGINT) AS under_commented FROM ({LINE_METRICS}) GROUP BY repo_id",
    ("files", "source_docs"),
)
def under_commented(b: Bindings):
    lines = metrics.line_metrics(union_all([b.files, b.source_docs]))
    return lines.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.count_if("under_commented").cast("bigint").alias("under_commented")
    )


@query(
    "p9_verification_method",
    f"""
    SELECT claim_id, claim_type, line_id % 2 AS related, {sql_method('claim_type')} AS verification_method,
           {sql_verifiable('claim_type', 'line_id % 2')} AS verifiable
    FROM claims""",
    ("claims",),
)
def verification_method(b: Bindings):
    claims = line_claims(b).withColumn("related", F.col("line_id") % 2)
    return verdicts.with_strategy(claims).select(
        "claim_id", "claim_type", "related", "verification_method", "verifiable"
    )


@query(
    "p10_claim_confidence",
    f"""
    SELECT doc_id, kind, round({sql_confidence('text', 'kind')}, 6) AS confidence
    FROM documents, (VALUES ('api'), ('performance'), ('feature')) AS kinds(kind)""",
)
def claim_confidence(b: Bindings):
    kinds = F.explode(F.array(F.lit("api"), F.lit("performance"), F.lit("feature"))).alias("kind")
    return b.documents.select("doc_id", "text", kinds).select(
        "doc_id", "kind", rounded(classify.claim_confidence(F.col("text"), F.col("kind"))).alias("confidence")
    )


@query(
    "p11_severe_findings",
    """
    SELECT repo_id, path, line, lower(severity) AS severity, message FROM function_findings
    WHERE upper(severity) IN ('HIGH', 'MEDIUM')""",
    ("function_findings",),
)
def severe_findings(b: Bindings):
    return findings.severe_findings(scanner_findings(b)).select("repo_id", "path", "line", "severity", "message")


@query(
    "p12_kept_log",
    "SELECT doc_id, CAST(length(right(text, 5000)) AS INT) AS kept, md5(right(text, 5000)) AS digest FROM documents",
)
def kept_log(b: Bindings):
    kept = b.documents.select("doc_id", classify.kept_log(F.col("text")).alias("log"))
    return kept.select("doc_id", F.length("log").alias("kept"), F.md5("log").alias("digest"))


@query(
    "p13_process_status",
    """
    SELECT repo_id, tool, path,
           CASE tool WHEN 'cbmc' THEN contains(stdout, 'VERIFICATION SUCCESSFUL') WHEN 'miri' THEN NULL
                ELSE exit_code = 0 END AS verified,
           CASE WHEN tool = 'miri' THEN contains(lower(stderr), 'undefined behavior') END AS ub_detected
    FROM tool_logs""",
    ("tool_logs",),
)
def process_status(b: Bindings):
    status = classify.process_status(*[F.col(c) for c in ("tool", "exit_code", "stdout", "stderr")])
    return b.tool_logs.select("repo_id", "tool", "path", status.alias("s")).select("repo_id", "tool", "path", "s.*")


@query(
    "p14_warning_lines",
    f"""
    SELECT repo_id, path, {sql_strip('line')} AS warning
    FROM (SELECT repo_id, path, unnest({sql_lines('stdout')}) AS line FROM tool_logs)
    WHERE contains(line, 'warning:') OR contains(line, 'error:')""",
    ("tool_logs",),
)
def warning_lines(b: Bindings):
    return b.tool_logs.select("repo_id", "path", F.explode(classify.warning_lines(F.col("stdout"))).alias("warning"))


@query(
    "w9_version_key",
    r"""
    SELECT DISTINCT tag, array_to_string(list_transform(regexp_extract_all(tag, '[0-9]+|[^0-9]+'),
        lambda x: CASE WHEN regexp_matches(x, '^[0-9]')
                       THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\1')) AS VARCHAR), 4, '0')
                            || regexp_replace(x, '^0+([0-9])', '\1') ELSE x END), '') AS version_key
    FROM tags""",
    ("tags",),
)
def version_key(b: Bindings):
    return b.tags.select("tag", history.version_key(F.col("tag")).alias("version_key")).distinct()
