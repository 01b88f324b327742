"""J: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.catalog.classifiers import LINE_METRICS
from auditframe.catalog.registry import line_claims, query, rounded
from auditframe.functions.documents import feature_keywords
from auditframe.functions.fixed_values import (
    FEATURE_STOP_WORDS,
    MANIFEST_LANGUAGES,
    SECURITY_KEYWORDS,
    TEST_INDICATORS,
)
from auditframe.functions.text import WORD
from auditframe.operators import claims, correlate, discovery, metrics
from auditframe.operators.findings import union_all
from auditframe.plans import audit
from auditframe.session import stage
from auditframe.sources.bindings import Bindings

_API_WORDS = (
    f"SELECT repo_id, claim_id, unnest(regexp_extract_all(text, '{WORD}+')) AS symbol FROM claims WHERE claim_type = 'api'"
)
API_RELATED = f"""
    SELECT w.repo_id, w.claim_id, CAST(count(*) AS BIGINT) AS related, min(s.path) AS first_file
    FROM ({_API_WORDS}) w JOIN symbols s ON w.repo_id = s.repo_id AND w.symbol = s.symbol
    GROUP BY w.repo_id, w.claim_id"""


@query("j1_api_related", API_RELATED, ("claims", "symbols"))
def api_related(b: Bindings):
    return correlate.api_related(line_claims(b), correlate.symbols(b.code_files))


@query(
    "j1_api_related_files",
    f"""
    SELECT w.repo_id, w.claim_id, w.symbol, s.path, count(*) AS times
    FROM ({_API_WORDS}) w JOIN symbols s ON w.repo_id = s.repo_id AND w.symbol = s.symbol
    GROUP BY w.repo_id, w.claim_id, w.symbol, s.path""",
    ("claims", "symbols"),
)
def api_related_files(b: Bindings):
    return correlate.api_related_files(line_claims(b), correlate.symbols(b.code_files))


@query(
    "j1_api_claim_classes",
    f"""
    SELECT w.repo_id, w.claim_id, w.symbol, w.times, s.files, w.times * s.files AS links
    FROM (SELECT repo_id, claim_id, symbol, count(*) AS times FROM ({_API_WORDS}) GROUP BY ALL) w
    JOIN (SELECT repo_id, symbol, count(*) AS files FROM symbols GROUP BY ALL) s
      ON w.repo_id = s.repo_id AND w.symbol = s.symbol""",
    ("claims", "symbols"),
)
def api_claim_classes(b: Bindings):
    return correlate.api_claim_classes(line_claims(b), correlate.symbols(b.code_files))


@query(
    "j1_api_class_files",
    f"""
    SELECT s.repo_id, s.symbol, s.path FROM symbols s
    WHERE EXISTS (SELECT 1 FROM ({_API_WORDS}) w WHERE w.repo_id = s.repo_id AND w.symbol = s.symbol)""",
    ("claims", "symbols"),
)
def api_class_files(b: Bindings):
    return correlate.api_class_files(line_claims(b), correlate.symbols(b.code_files))


_CODE = "(SELECT * FROM (SELECT * FROM files UNION ALL SELECT * FROM code_files) WHERE regexp_matches(path, '\\.(py|js|java|cpp|go)$'))"
_STOP = ", ".join(f"'{w}'" for w in FEATURE_STOP_WORDS)
_TOKENS = (
    f"list_slice(list_filter(list_transform(list_filter(regexp_extract_all(text, '{WORD}+'), lambda w: length(w) >= 4), "
    f"lambda w: lower(w)), lambda w: w NOT IN ({_STOP})), 1, 3)"
)
_FEATURES = f"SELECT repo_id, claim_id, unnest({_TOKENS}) AS keyword FROM claims WHERE claim_type = 'feature'"
_HITS = f"""
    SELECT k.repo_id, k.keyword, min(f.path) AS path
    FROM (SELECT DISTINCT repo_id, keyword FROM ({_FEATURES})) k
    JOIN {_CODE} f ON k.repo_id = f.repo_id AND contains(lower(f.text), k.keyword)
    GROUP BY k.repo_id, k.keyword"""
FEATURE_RELATED = f"""
    SELECT t.repo_id, t.claim_id, count(*) AS related
    FROM ({_FEATURES}) t JOIN ({_HITS}) h ON t.repo_id = h.repo_id AND t.keyword = h.keyword
    GROUP BY t.repo_id, t.claim_id"""


def _code(b: Bindings):
    return union_all([b.files, b.code_files])


@query("j2_keyword_files", _HITS, ("claims", "files", "code_files"))
def keyword_files(b: Bindings):
    features = line_claims(b).filter(F.col("claim_type") == "feature")
    keywords = features.select("repo_id", F.explode(feature_keywords(F.col("text"))).alias("keyword"))
    return correlate.keyword_files(_code(b), keywords)


# Word starts of the documents as keywords: parts of words, and some that are longer than 32 characters.
_PARTS = f"""
    SELECT DISTINCT repo_id, keyword FROM (
        SELECT repo_id, lower(substr(w, 2, 5)) AS keyword
        FROM (SELECT repo_id, unnest(regexp_extract_all(text, '{WORD}+')) AS w FROM files) WHERE length(w) >= 12
        UNION ALL
        SELECT repo_id, lower(substr(w, 1, 36))
        FROM (SELECT repo_id, unnest(regexp_extract_all(text, '{WORD}+')) AS w FROM files) WHERE length(w) >= 36)"""


@query(
    "j2_word_part_files",
    f"""
    SELECT k.repo_id, k.keyword, min(f.path) AS path
    FROM ({_PARTS}) k JOIN (SELECT * FROM files WHERE regexp_matches(path, '\\.(py|js|java|cpp|go)$')) f
      ON k.repo_id = f.repo_id AND contains(lower(f.text), k.keyword)
    GROUP BY k.repo_id, k.keyword""",
    ("files",),
)
def word_part_files(b: Bindings):
    """Keywords cut out of the middle of the texts' own words: containment, not word equality."""
    words = b.files.select("repo_id", F.explode(F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0))).alias("w"))
    length = F.length("w")
    parts = F.array_compact(
        F.array(F.when(length >= 12, F.lower(F.substring("w", 2, 5))), F.when(length >= 36, F.lower(F.left("w", F.lit(36)))))
    )
    return correlate.keyword_files(b.files, words.select("repo_id", F.explode(parts).alias("keyword")))


@query("j2_feature_related", FEATURE_RELATED, ("claims", "files", "code_files"))
def feature_related(b: Bindings):
    return correlate.feature_related(line_claims(b), _code(b)).drop("related_code")


_SECURITY_KEYWORDS = "(VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(SECURITY_KEYWORDS)) + ") AS k(ord, keyword)"
_SECURITY = f"""
    SELECT c.repo_id, c.claim_id, count(*) AS related, string_agg(h.path, ',' ORDER BY k.ord) AS related_code
    FROM claims c JOIN {_SECURITY_KEYWORDS} ON contains(lower(c.text), k.keyword)
    JOIN (SELECT f.repo_id, k.keyword, min(f.path) AS path
          FROM {_CODE} f JOIN {_SECURITY_KEYWORDS} ON contains(lower(f.text), k.keyword)
          GROUP BY f.repo_id, k.keyword) h ON h.repo_id = c.repo_id AND h.keyword = k.keyword
    WHERE c.claim_type = 'security' GROUP BY c.repo_id, c.claim_id"""


@query("j3_security_related", _SECURITY, ("claims", "files", "code_files"))
def security_related(b: Bindings):
    related = correlate.security_related(line_claims(b), _code(b))
    return related.withColumn("related_code", F.array_join("related_code", ","))


@query(
    "j4_flatten_claims",
    "SELECT repo_id, line_id, claim_type, text, round(confidence, 6) AS confidence FROM claims",
    ("claims",),
)
def flatten_claims(b: Bindings):
    """Claims grouped by type within each line, and flattened again."""
    found = line_claims(b)
    lists = found.groupBy("repo_id", "line_id", "claim_type").agg(
        F.collect_list(F.struct("text", rounded("confidence").alias("confidence"))).alias("claims")
    )
    grouped = lists.groupBy("repo_id", "line_id").agg(
        F.map_from_entries(F.collect_list(F.struct("claim_type", "claims"))).alias("claims_by_type")
    )
    return claims.flatten_claims_by_type(grouped)


# Complexities for the files of the ``files`` view, so that the line counts find partners. Order keys go on beyond
# document ids and are wound round them, so that every line item is a function of some file.
_OF_FILES = """
    SELECT CASE WHEN doc_id % 5 = 0 THEN 'gone/' ELSE '' END || f.path AS path, f.repo_id, l_linenumber AS lineno,
           CAST(l_quantity AS INT) AS complexity
    FROM (SELECT *, CAST(regexp_extract(path, '([0-9]+)\\.', 1) AS BIGINT) AS doc_id FROM files) f
    JOIN lineitem ON doc_id = l_orderkey % (SELECT 1 + max(doc_id) FROM documents)"""
FILE_METRICS = f"""
    SELECT m.repo_id, m.path, count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total_complexity,
           avg(complexity) AS average_complexity, min(l.loc) AS loc
    FROM ({_OF_FILES}) m LEFT JOIN ({LINE_METRICS}) l ON l.repo_id = m.repo_id AND l.path = m.path
    GROUP BY m.repo_id, m.path"""


def file_functions(b: Bindings):
    files = b.files.select("repo_id", "path", F.regexp_extract("path", r"([0-9]+)\.", 1).cast("bigint").alias("doc_id"))
    documents = b.documents.select(1 + F.max("doc_id")).scalar()
    lines = b.lineitem.select(
        (F.col("l_orderkey") % documents).alias("doc_id"),
        F.col("l_linenumber").alias("lineno"),
        F.col("l_quantity").cast("int").alias("complexity"),
    )
    joined = files.join(lines, "doc_id")
    moved = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path"))
    return joined.select("repo_id", moved.alias("path"), "lineno", "complexity")


def joined_file_metrics(b: Bindings):
    lines = metrics.line_metrics(union_all([b.files, b.source_docs]))
    return metrics.file_metrics(file_functions(b), lines)


@query(
    "j5_file_metrics",
    f"SELECT repo_id, path, functions, total_complexity, round(average_complexity, 6) AS average_complexity, loc FROM ({FILE_METRICS})",
    ("files", "source_docs"),
)
def file_metrics(b: Bindings):
    return joined_file_metrics(b).withColumn("average_complexity", rounded("average_complexity"))


# --- frameworks -----------------------------------------------------------------------------------


def _indicator_sql(indicator: str) -> str:
    if "*" in indicator:
        name = indicator.replace(".", "\\.").replace("*", "[^/]*")
        return f"regexp_matches(path, '(^|/){name}$')"
    return f"starts_with(path, '{indicator}')" if indicator.endswith("/") else f"path = '{indicator}'"


_FOUND = " UNION ALL ".join(
    [
        f"SELECT repo_id, '{language}' AS language, '{framework}' AS framework, {i} AS ord, '{indicator}' AS indicator, "
        f"{'path' if not indicator.endswith('/') else repr(indicator)} AS file "
        f"FROM project_files WHERE {_indicator_sql(indicator)}"
        for (language, framework), indicators in TEST_INDICATORS.items()
        for i, indicator in enumerate(indicators)
    ]
    + [
        f"SELECT repo_id, '{language}', '{framework}', 99, 'dependency', path FROM project_files "
        f"WHERE path = 'package.json' AND regexp_matches(text, '\"(@types/)?{framework}\"')"
        for language, framework in TEST_INDICATORS
        if language in MANIFEST_LANGUAGES
    ]
)


@query(
    "j6_test_frameworks",
    f"""
    SELECT repo_id, language, framework, string_agg(file, ',' ORDER BY indicator, r) AS files
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, language, framework, indicator ORDER BY file) AS r
          FROM (SELECT DISTINCT * FROM ({_FOUND})))
    WHERE r <= 5 GROUP BY repo_id, language, framework""",
    ("project_files",),
)
def test_frameworks(b: Bindings):
    found = discovery.test_frameworks(b.project_files)
    return found.withColumn("files", F.array_join("files", ","))


@query(
    "j6_detected_frameworks",
    f"SELECT DISTINCT repo_id, language, framework FROM ({_FOUND})",
    ("project_files",),
)
def detected_frameworks(b: Bindings):
    return discovery.detected_frameworks(b.project_files)


RELATED = f"""
    SELECT repo_id, claim_id, related FROM ({API_RELATED})
    UNION ALL SELECT repo_id, claim_id, related FROM ({FEATURE_RELATED})
    UNION ALL SELECT repo_id, claim_id, related FROM ({_SECURITY})"""
CORRELATED_VIEWS = ("claims", "symbols", "files", "code_files")


def correlated(b: Bindings):
    return audit.correlated_claims(line_claims(b), _code(b))


@query(
    "j7_unrelated_claims",
    f"""
    SELECT c.repo_id, c.claim_id, c.claim_type FROM claims c
    WHERE NOT EXISTS (SELECT 1 FROM ({RELATED}) r WHERE r.repo_id = c.repo_id AND r.claim_id = c.claim_id)""",
    CORRELATED_VIEWS,
)
def unrelated_claims(b: Bindings):
    found = stage(correlated(b), "correlated")
    unrelated = correlate.unrelated_claims(found, found.filter(F.col("related") > 0))
    return unrelated.select("repo_id", "claim_id", "claim_type")


@query(
    "j7_correlated_claims",
    f"""
    SELECT c.repo_id, c.claim_id, c.claim_type, coalesce(r.related, 0) AS related
    FROM claims c LEFT JOIN ({RELATED}) r ON r.repo_id = c.repo_id AND r.claim_id = c.claim_id""",
    CORRELATED_VIEWS,
)
def correlated_claims(b: Bindings):
    return correlated(b).select("repo_id", "claim_id", "claim_type", "related")


