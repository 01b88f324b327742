"""Registration of queries and the pieces their ANSI twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.fixed_values import CERTAIN_WORDS, CLAIM_PATTERNS, HEDGING_WORDS, VERIFICATION_METHODS
from auditframe.functions.text import SPACE, SPACE_CHARACTERS
from auditframe.sources.bindings import VIEWS, Bindings, as_ansi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF_COMMITS = "2024-01-31"
AS_OF_FILES = "2001-12-01"

# --- ANSI pieces ----------------------------------------------------------------------------------

NL = "chr(10)"
# The trimmed characters spelled out, since a query text should hold no control characters.
_TRIMMED = " || ".join(f"chr({ord(c)})" for c in SPACE_CHARACTERS)


def sql_strip(x: str) -> str:
    return f"trim({x}, {_TRIMMED})"


def sql_lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def sql_rewrite(x: str, pattern: str, replacement: str) -> str:
    """Each match of a pattern replaced by an expression of ``m``."""
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{pattern}'), "
        f"list_concat(list_transform(regexp_extract_all({x}, '{pattern}'), lambda m: {replacement}), [''])), "
        f"lambda z: z[1] || z[2]), '')"
    )


def sql_suffix(path: str) -> str:
    return rf"regexp_extract({path}, '[^/](\.[^./]+)$', 1)"


def sql_confidence(text: str, kind: str) -> str:
    def any_of(words: list[str]) -> str:
        return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"

    return (
        f"least(greatest(CAST(0.5 AS DOUBLE) + CASE WHEN {any_of(CERTAIN_WORDS)} THEN CAST(0.2 AS DOUBLE) ELSE 0 END"
        f" - CASE WHEN {any_of(HEDGING_WORDS)} THEN CAST(0.2 AS DOUBLE) ELSE 0 END"
        f" + CASE WHEN regexp_matches({text}, '[0-9]') THEN CAST(0.1 AS DOUBLE) ELSE 0 END"
        f" + CASE {kind} WHEN 'api' THEN CAST(0.1 AS DOUBLE) WHEN 'performance' THEN CAST(0.05 AS DOUBLE) ELSE 0 END, 0), 1)"
    )


def sql_claims(source: str, keys: str) -> str:
    """Claims of the ``text`` column of ``source``, pattern by pattern."""
    selects = [
        f"SELECT {keys}, '{kind}' AS claim_type, {number} AS pattern_no, "
        f"unnest(regexp_extract_all(text, '(?i){pattern}', 2)) AS raw, "
        f"unnest(range(len(regexp_extract_all(text, '(?i){pattern}', 2)))) AS match_no FROM {source}"
        for kind, patterns in CLAIM_PATTERNS.items()
        for number, pattern in enumerate(patterns)
    ]
    return (
        f"SELECT {keys}, claim_type, CAST(pattern_no AS INT) AS pattern_no, CAST(match_no AS INT) AS match_no, "
        f"{sql_strip('raw')} AS text, {sql_confidence('raw', 'claim_type')} AS confidence "
        f"FROM ({' UNION ALL '.join(selects)})"
    )


_METHODS = " ".join(f"WHEN '{kind}' THEN '{method}'" for kind, (method, _) in VERIFICATION_METHODS.items())
_ALWAYS = ", ".join(f"'{kind}'" for kind, (_, always) in VERIFICATION_METHODS.items() if always)


def sql_method(kind: str) -> str:
    return f"CASE {kind} {_METHODS} END"


def sql_verifiable(kind: str, related: str) -> str:
    return f"({kind} IN ({_ALWAYS}) OR coalesce({related}, 0) > 0)"


_WORD = r"[\p{L}\p{N}_]+"

# Views over views, each with the views it needs.
_DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "claims": (
        ("claim_lines",),
        "SELECT *, concat(line_id, ':', claim_type, ':', pattern_no, ':', match_no) AS claim_id FROM ("
        + sql_claims("(SELECT repo_id, claim_id AS line_id, text FROM claim_lines)", "repo_id, line_id")
        + ")",
    ),
    "symbols": (
        ("code_files",),
        rf"""
        SELECT DISTINCT repo_id, path, symbol FROM (
            SELECT repo_id, path, unnest(list_concat(
                regexp_extract_all(text, 'def{SPACE}+({_WORD}){SPACE}*\(', 1),
                regexp_extract_all(text, 'class{SPACE}+({_WORD}){SPACE}*[\(:]', 1))) AS symbol
            FROM code_files WHERE path LIKE '%.py'
            UNION ALL
            SELECT repo_id, path, unnest(list_concat(
                regexp_extract_all(text, 'function{SPACE}+({_WORD}){SPACE}*\(', 1),
                regexp_extract_all(text, 'class{SPACE}+({_WORD}){SPACE}*\x7b', 1))) AS symbol
            FROM code_files WHERE path LIKE '%.js' OR path LIKE '%.ts')""",
    ),
    "package_claims": (
        ("package_docs",),
        sql_claims("(SELECT repo_id, claim_id AS line_id, text FROM package_docs)", "repo_id, line_id"),
    ),
    "package_symbols": (
        ("package_code",),
        r"SELECT DISTINCT repo_id, regexp_extract(text, 'def ([A-Za-z0-9_]+)\(', 1) AS symbol FROM package_code",
    ),
    "function_findings": (
        ("security_reports",),
        """
        SELECT repo_id, report_id, json_extract_string(r, '$.filename') AS path,
               CAST(json_extract_string(r, '$.line_number') AS INT) AS line,
               json_extract_string(r, '$.issue_severity') AS severity,
               json_extract_string(r, '$.issue_confidence') AS confidence,
               json_extract_string(r, '$.issue_text') AS message, json_extract_string(r, '$.test_id') AS test_id
        FROM (SELECT repo_id, report_id, unnest(CAST(json_extract(report, '$.results') AS JSON[])) AS r
              FROM security_reports WHERE json_valid(report))""",
    ),
    "stdout_counts": (
        ("test_runs",),
        r"""
        SELECT repo_id, run_id, run_part, language, framework, stdout, passed, failed, skipped,
               CASE WHEN stated = 0 THEN passed + failed + skipped ELSE stated END AS total
        FROM (
            SELECT *,
                   CASE framework WHEN 'pytest' THEN coalesce(TRY_CAST(regexp_extract(stdout, '(?i)([0-9]+) passed', 1) AS BIGINT), 0)
                                  WHEN 'jest' THEN coalesce(TRY_CAST(regexp_extract(stdout, '(?i)Tests:\s+([0-9]+) passed', 1) AS BIGINT), 0)
                                  WHEN 'cargo' THEN coalesce(TRY_CAST(regexp_extract(stdout, '(?i)test result: ok. ([0-9]+) passed', 1) AS BIGINT), 0)
                                  WHEN 'gotest' THEN len(regexp_extract_all(stdout, '--- PASS:')) ELSE 0 END AS passed,
                   CASE framework WHEN 'pytest' THEN coalesce(TRY_CAST(regexp_extract(stdout, '(?i)([0-9]+) failed', 1) AS BIGINT), 0)
                                                     + coalesce(TRY_CAST(regexp_extract(stdout, '(?i)([0-9]+) error', 1) AS BIGINT), 0)
                                  WHEN 'jest' THEN coalesce(TRY_CAST(regexp_extract(stdout, '(?i)Tests:\s+([0-9]+) failed', 1) AS BIGINT), 0)
                                  WHEN 'cargo' THEN coalesce(TRY_CAST(regexp_extract(stdout, '(?i)([0-9]+) failed', 1) AS BIGINT), 0)
                                  WHEN 'gotest' THEN len(regexp_extract_all(stdout, '--- FAIL:')) ELSE 0 END AS failed,
                   CASE framework WHEN 'pytest' THEN coalesce(TRY_CAST(regexp_extract(stdout, '(?i)([0-9]+) skipped', 1) AS BIGINT), 0)
                                  WHEN 'cargo' THEN coalesce(TRY_CAST(regexp_extract(stdout, '(?i)([0-9]+) ignored', 1) AS BIGINT), 0)
                                  ELSE 0 END AS skipped,
                   CASE framework WHEN 'jest' THEN coalesce(TRY_CAST(regexp_extract(stdout, '(?i)Tests:\s+([0-9]+) total', 1) AS BIGINT), 0)
                                  ELSE 0 END AS stated
            FROM test_runs)""",
    ),
}


def _views(names: tuple[str, ...]) -> dict[str, str]:
    found: dict[str, str] = {}
    for name in names:
        if name in _DERIVED:
            needs, text = _DERIVED[name]
            found |= _views(needs)
            found[name] = text
        else:
            found[name] = as_ansi(VIEWS[name])
    return found


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of the bindings as a query, and its ANSI twin over the named views."""

    def register(build: Callable[[Bindings], DataFrame]) -> Callable[[Bindings], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Bindings(spark, folder))
        if oracle is not None:
            with_ = ", ".join(f"{view} AS ({text})" for view, text in _views(views).items())
            ORACLES[name] = f"WITH {with_} SELECT * FROM ({oracle}) q" if with_ else oracle
        return build

    return register


# --- Spark pieces ---------------------------------------------------------------------------------


def rounded(column: str | Column) -> Column:
    return F.round(column, 6)


def seconds(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def line_claims(b: Bindings) -> DataFrame:
    """Claims of the claim lines, with an identifier each."""
    from auditframe.operators.claims import extract_claims, with_claim_id

    units = b.claim_lines.withColumnRenamed("claim_id", "line_id")
    return with_claim_id(extract_claims(units), ["line_id", "claim_type", "pattern_no", "match_no"])


def scanner_findings(b: Bindings) -> DataFrame:
    """Results of the security reports in the findings schema."""
    from auditframe.operators.findings import as_findings
    from auditframe.sources.reports import security_results

    return as_findings(
        security_results(b.security_reports), "security", "bandit", path="filename", line="line_number",
        severity="issue_severity", confidence="issue_confidence", message="issue_text", test_id="test_id",
    )


def type_findings(b: Bindings) -> DataFrame:
    from auditframe.operators.findings import as_findings
    from auditframe.sources.logs import type_check_lines

    return as_findings(
        type_check_lines(b.type_logs), "type_checking", "mypy", path="path", line=F.col("line").try_cast("int"),
        kind="kind", message="message",
    )


def lint_findings(b: Bindings) -> DataFrame:
    from auditframe.operators.findings import as_findings
    from auditframe.sources.reports import lint_messages

    return as_findings(
        lint_messages(b.lint_reports), "linting", "pylint", path="path", line="line", col="column", kind="type",
        message="message", test_id="symbol",
    )
