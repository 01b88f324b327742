"""T: text units, claims, references, scans and log parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.catalog.registry import line_claims, query, rounded, sql_claims, sql_lines, sql_strip
from auditframe.functions import documents
from auditframe.functions.fixed_values import CODE_BLOCK, FEATURE_STOP_WORDS, SECRET_PATTERNS
from auditframe.functions.text import SPACE, WORD, WORD_CHARS
from auditframe.operators import claims, correlate, discovery, findings
from auditframe.operators.findings import union_all
from auditframe.sources import logs
from auditframe.sources.bindings import Bindings


def _numbered(view: str, keys: str, text: str = "text") -> str:
    return (
        f"SELECT {keys}, unnest({sql_lines(text)}) AS line, "
        f"CAST(unnest(range(1, len({sql_lines(text)}) + 1)) AS INT) AS no FROM {view}"
    )


@query(
    "t1_text_lines",
    f"""
    SELECT doc_id, no AS line_number, line AS text, 'General' AS context
    FROM ({_numbered('documents', 'doc_id')}) WHERE {sql_strip('line')} <> ''""",
)
def text_lines(b: Bindings):
    units = b.documents.select("doc_id", F.inline(documents.text_units(F.col("text"))))
    return units.select("doc_id", "line_number", "text", "context")


@query(
    "t2_rst_sections",
    rf"""
    SELECT path, no AS line_number, line AS text, coalesce(section, 'General') AS context
    FROM (SELECT *, last_value(CASE WHEN heads THEN {sql_strip('line')} END IGNORE NULLS)
                        OVER (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
          FROM (SELECT *, coalesce(regexp_matches({sql_strip('lead(line) OVER (PARTITION BY path ORDER BY no)')},
                                                  '^[=~-]+$'), false) AS heads
                FROM ({_numbered('rst_docs', 'path')})))
    WHERE NOT heads AND {sql_strip('line')} <> ''""",
    ("rst_docs",),
)
def rst_sections(b: Bindings):
    return claims.document_units(b.rst_docs).select("path", "line_number", "text", "context")


_ITEM = r"[ \t]*([-*+]|[0-9]+[.)])[ \t]+"
_RULE = r"^ {0,3}([-_*][ \t]*){3,}$"


def _markdown_sql(view: str) -> str:
    """Blocks from classes of lines: windows over the lines of each text, where the query cuts texts by patterns."""
    over = "(PARTITION BY path ORDER BY no)"
    return rf"""
    SELECT path, min(no) AS unit_no, string_agg(bare, chr(10) ORDER BY no) AS text, any_value(coalesce(section, 'General')) AS context
    FROM (
        SELECT *, sum(CAST(opens AS INT)) OVER {over} AS block,
               CASE WHEN code THEN line
                    ELSE regexp_replace(regexp_replace(line, '^({_ITEM}|[ \t]+)', ''), '\*\*|`', '', 'g') END AS bare,
               last_value(CASE WHEN atx OR title THEN {sql_strip("regexp_replace(line, '^#+|#+$', '', 'g')")} END IGNORE NULLS)
                   OVER (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
        FROM (SELECT *, item OR NOT coalesce(lag(unit) OVER {over}, false) OR code <> lag(code) OVER {over} AS opens FROM (
            SELECT *, code OR (plain AND NOT blank AND NOT atx AND NOT title AND NOT deep AND NOT underlines
                               AND NOT rule) AS unit
            FROM (
                SELECT *, coalesce(lag(title) OVER {over}, false) AS underlines
                FROM (
                    SELECT *, plain AND NOT (blank OR item OR atx OR deep OR rule OR under)
                              AND coalesce(lead(under) OVER {over}, false) AS title
                    FROM (
                        SELECT *, plain AND {sql_strip('line')} = '' AS blank, plain AND regexp_matches(line, '^#{{1,3}} ') AS atx,
                               plain AND regexp_matches(line, '^#{{4,6}} ') AS deep, plain AND regexp_matches(line, '{_RULE}') AS rule,
                               plain AND regexp_matches(line, '^{_ITEM}') AND NOT regexp_matches(line, '{_RULE}') AS item,
                               plain AND regexp_matches(line, '^ {{0,3}}(=+|-+)[ \t]*$') AS under
                        FROM (
                            SELECT *, NOT fence AND fences % 2 = 0 AS plain, NOT fence AND fences % 2 = 1 AS code
                            FROM (
                                SELECT *, sum(CAST(fence AS INT)) OVER {over} AS fences
                                FROM (SELECT *, regexp_matches(line, '^ {{0,3}}```[^`]*$') AS fence
                                      FROM ({_numbered(view, 'path')})))))))))
        )
    WHERE unit GROUP BY path, block HAVING {sql_strip("string_agg(bare, chr(10) ORDER BY no)")} <> ''"""


@query("t3_markdown_sections", _markdown_sql("markdown_docs"), ("markdown_docs",))
def markdown_sections(b: Bindings):
    return claims.document_units(b.markdown_docs).select("path", "unit_no", "text", "context")


@query("t3_markdown_blocks", _markdown_sql("guide_docs"), ("guide_docs",))
def markdown_blocks(b: Bindings):
    return claims.document_units(b.guide_docs).select("path", "unit_no", "text", "context")


_TAG = """</?[a-zA-Z]([^>=]|=\\s*("[^"]*"|''[^'']*'')?)*>"""
_RAW = r"(?is)<!--.*?(-->|\z)|<script\b.*?(</script\s*>|\z)|<style\b.*?(</style\s*>|\z)"
_HEADING = r"(?is)\A(<h1\b[^>]*>(.*?)</h1>|<h2\b[^>]*>(.*?)</h2>|<h3\b[^>]*>(.*?)</h3>)"
_SECTION = r"(?i)<h[1-3]\b"
_VOID = "('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr')"


def _cut_before(text: str, pattern: str, mark: int) -> str:
    """Parts of a text, each but the first opening with a match."""
    return f"string_split(regexp_replace({text}, '({pattern})', concat(chr({mark}), '\\1'), 'g'), chr({mark}))"


def _plain_sql(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, code in (("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&#39;", 39), ("&nbsp;", 160), ("&amp;", 38)):
        x = f"replace({x}, '{entity}', chr({code}))"
    return x


#: One tag after another: the names of the open elements, and the text of the unit that is open.
_HTML_UNITS = rf"""
    WITH RECURSIVE sections AS MATERIALIZED (
        SELECT page_id, CAST(unnest(range(len(s))) AS INT) AS section_no, unnest(s) AS section
        FROM (SELECT page_id, {_cut_before(f"regexp_replace(html, '{_RAW}', '', 'g')", _SECTION, 1)} AS s FROM pages)),
    parts AS MATERIALIZED (
        SELECT page_id, section_no, regexp_matches(section, '{_HEADING}') AS headed,
               {_plain_sql(f"concat(regexp_extract(section, '{_HEADING}', 2), regexp_extract(section, '{_HEADING}', 3), regexp_extract(section, '{_HEADING}', 4))")} AS title,
               {_cut_before(f"regexp_replace(section, '{_HEADING}', '')", _TAG, 2)} AS pieces
        FROM sections),
    tags AS MATERIALIZED (
        SELECT page_id, section_no, k, lower(regexp_extract(piece, '\A</?([a-zA-Z][^\s/>]*)', 1)) AS name,
               starts_with(piece, '</') AS ends, ends_with(regexp_extract(piece, '\A{_TAG}'), '/>') AS closed,
               regexp_replace(piece, '\A{_TAG}', '') AS said
        FROM (SELECT page_id, section_no, unnest(range(1, len(pieces) + 1)) AS k, unnest(pieces) AS piece FROM parts)),
    walk AS (
        SELECT page_id, section_no, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS open, CAST(0 AS BIGINT) AS depth, '' AS text,
               CAST([] AS VARCHAR[]) AS found FROM parts
        UNION ALL
        SELECT page_id, section_no, k, after,
               CASE WHEN begins THEN len(after) WHEN inside THEN depth ELSE 0 END,
               CASE WHEN begins THEN said WHEN inside THEN concat(text, said) ELSE '' END,
               CASE WHEN depth > 0 AND NOT inside THEN list_append(found, text) ELSE found END
        FROM (
            SELECT *, depth = 0 AND opens AND name IN ('p', 'li', 'code') AS begins, depth > 0 AND len(after) >= depth AS inside
            FROM (
                SELECT *, CASE WHEN ends AND last > 0 THEN list_slice(open, 1, len(open) - last)
                               WHEN opens THEN list_append(open, name) ELSE open END AS after
                FROM (SELECT w.page_id, w.section_no, t.k, w.open, w.depth, w.text, w.found, t.name, t.said, t.ends,
                             coalesce(list_position(list_reverse(w.open), t.name), 0) AS last,
                             t.name <> '' AND NOT t.ends AND NOT t.closed AND t.name NOT IN {_VOID} AS opens
                      FROM walk w JOIN tags t ON t.page_id = w.page_id AND t.section_no = w.section_no AND t.k = w.k + 1)))),
    done AS (
        SELECT w.page_id, w.section_no, CASE WHEN p.headed THEN p.title ELSE 'General' END AS context,
               CASE WHEN w.depth > 0 THEN list_append(w.found, w.text) ELSE w.found END AS units
        FROM walk w JOIN parts p ON p.page_id = w.page_id AND p.section_no = w.section_no WHERE w.k = len(p.pieces))
    SELECT page_id, section_no, unit_no, text, context
    FROM (SELECT page_id, section_no, CAST(unnest(range(len(units))) AS INT) AS unit_no, {_plain_sql('unnest(units)')} AS text, context
          FROM done)
    WHERE {sql_strip('text')} <> ''"""


@query("t4_html_sections", _HTML_UNITS)
def html_sections(b: Bindings):
    """Units of every page; scripts, styles and comments hold none."""
    units = b.pages.select("page_id", F.inline(documents.html_units(F.col("html"))))
    return units.select("page_id", "section_no", "unit_no", "text", "context")


def _claims_of(source: str, keys: str) -> str:
    return (
        f"SELECT {keys}, claim_type, pattern_no, match_no, text, round(confidence, 6) AS confidence "
        f"FROM ({sql_claims(source, keys)})"
    )


@query(
    "t5_document_claims",
    _claims_of(f"(SELECT doc_id, no AS line_number, line AS text FROM ({_numbered('documents', 'doc_id')}))", "doc_id, line_number"),
)
def document_claims(b: Bindings):
    units = b.documents.select("doc_id", F.inline(documents.text_units(F.col("text"))))
    found = claims.extract_claims(units.select("doc_id", "line_number", "text"))
    return found.withColumn("confidence", rounded("confidence"))


@query(
    "t5_conversation_claims",
    _claims_of(
        f"(SELECT conv_id, turn, no AS line_number, line AS text FROM ({_numbered('conversations', 'conv_id, turn')}))",
        "conv_id, turn, line_number",
    ),
)
def conversation_claims(b: Bindings):
    units = b.conversations.select("conv_id", "turn", F.inline(documents.text_units(F.col("text"))))
    found = claims.extract_claims(units.select("conv_id", "turn", "line_number", "text"))
    return found.withColumn("confidence", rounded("confidence"))


@query(
    "t5_line_claims",
    "SELECT claim_id, claim_type, text, round(confidence, 6) AS confidence FROM claims",
    ("claims",),
)
def claims_of_lines(b: Bindings):
    return line_claims(b).select("claim_id", "claim_type", "text", rounded("confidence").alias("confidence"))


# --- code in documentation ------------------------------------------------------------------------

_BLOCKS = (
    f"SELECT path, unnest(regexp_extract_all(text, '{CODE_BLOCK}', 1)) AS code, "
    f"CAST(unnest(range(len(regexp_extract_all(text, '{CODE_BLOCK}', 1)))) AS INT) AS block_no FROM markdown_docs"
)


@query("t6_code_blocks", f"SELECT path, block_no, code FROM ({_BLOCKS})", ("markdown_docs",))
def code_blocks(b: Bindings):
    return claims.code_blocks(b.markdown_docs).select("path", "block_no", "code")


_CALL = rf"({WORD}+){SPACE}*\([^)]*\)"
_METHOD = rf"({WORD}+)\.({WORD}+){SPACE}*\([^)]*\)"


@query(
    "t7_function_call_claims",
    f"""
    SELECT path, block_no, concat('Function ''', f, ''' exists and can be called') AS text
    FROM (SELECT path, block_no, unnest(regexp_extract_all(code, '{_CALL}', 1)) AS f FROM ({_BLOCKS}))""",
    ("markdown_docs",),
)
def function_call_claims(b: Bindings):
    found = claims.code_example_claims(claims.code_blocks(b.markdown_docs))
    return found.filter(F.col("pattern_no") == 0).select("path", "block_no", "text")


@query(
    "t8_method_call_claims",
    f"""
    SELECT path, block_no, concat('Object ''', o, ''' has method ''', m, '''') AS text
    FROM (SELECT path, block_no, unnest(regexp_extract_all(code, '{_METHOD}', 1)) AS o,
                 unnest(regexp_extract_all(code, '{_METHOD}', 2)) AS m FROM ({_BLOCKS}))""",
    ("markdown_docs",),
)
def method_call_claims(b: Bindings):
    found = claims.code_example_claims(claims.code_blocks(b.markdown_docs))
    return found.filter(F.col("pattern_no") == 1).select("path", "block_no", "text")


_CLASS_REF = rf"`class{SPACE}+({WORD}+)`|`({WORD}+){SPACE}+class`"
_REFS = (
    rf"list_concat(list_concat(regexp_extract_all(text, '`({WORD}+\.{WORD}+|{WORD}+\(\))`', 1), "
    f"list_filter(list_transform(list_zip(regexp_extract_all(text, '{_CLASS_REF}', 1), "
    f"regexp_extract_all(text, '{_CLASS_REF}', 2)), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), lambda r: r <> '')), "
    rf"regexp_extract_all(text, '`([/{WORD_CHARS}]+\.{WORD}+)`', 1))"
)


@query(
    "t9_code_references",
    f"SELECT path, unnest({_REFS}) AS ref, CAST(unnest(range(len({_REFS}))) AS INT) AS ord FROM markdown_docs",
    ("markdown_docs",),
)
def code_references(b: Bindings):
    return claims.code_references(b.markdown_docs).select("path", "ref", "ord")


@query(
    "t10_docstrings",
    f"""
    SELECT path, line_number, text FROM (
        SELECT path, 0 AS line_number, {sql_strip("regexp_extract(text, '(?s)^\"\"\"(.*?)\"\"\"', 1)")} AS text FROM source_docs
        UNION ALL
        SELECT path, 2, {sql_strip("regexp_extract(text, '(?s)def[^\\n]*:\\n *\"\"\"(.*?)\"\"\"', 1)")} FROM source_docs
        UNION ALL
        SELECT path, 8, {sql_strip("regexp_extract(text, '(?s)class[^\\n]*:\\n\\n    # comment\\n *\"\"\"(.*?)\"\"\"', 1)")}
        FROM source_docs)
    WHERE text <> ''""",
    ("source_docs",),
)
def docstrings(b: Bindings):
    return claims.docstrings(b.source_docs).select("path", "line_number", "text")


@query(
    "t10_signature_docstrings",
    r"""
    SELECT path, line_number, text FROM (
        SELECT path, 1 AS line_number, regexp_extract(text, 'int\]:\n *"{3}([^"]*)"{3}', 1) AS text FROM signature_files
        UNION ALL
        SELECT path, 7, regexp_extract(text, '\n\):\n *"{3}([^"]*)"{3}', 1)
        FROM signature_files)
    WHERE text <> ''""",
    ("signature_files",),
)
def signature_docstrings(b: Bindings):
    """Signatures over several lines."""
    return claims.docstrings(b.signature_files).select("path", "line_number", "text")


@query("t11_symbols", "SELECT repo_id, path, symbol FROM symbols", ("symbols",))
def symbols(b: Bindings):
    return correlate.symbols(b.code_files)


_KEYWORDS = (
    f"list_slice(list_filter(list_transform(list_filter(regexp_extract_all(text, '{WORD}+'), lambda w: length(w) >= 4), "
    f"lambda w: lower(w)), lambda w: w NOT IN ({', '.join(repr(w) for w in FEATURE_STOP_WORDS)})), 1, 3)"
)


@query(
    "t12_claim_tokens",
    f"""
    SELECT claim_id, claim_type, array_to_string(CASE WHEN claim_type = 'api' THEN regexp_extract_all(text, '{WORD}+')
                                                      ELSE {_KEYWORDS} END, ' ') AS tokens
    FROM claims""",
    ("claims",),
)
def claim_tokens(b: Bindings):
    text = F.col("text")
    tokens = F.when(F.col("claim_type") == "api", documents.api_words(text)).otherwise(documents.feature_keywords(text))
    return line_claims(b).select("claim_id", "claim_type", F.array_join(tokens, " ").alias("tokens"))


@query(
    "t12_document_keywords",
    f"SELECT doc_id, array_to_string({_KEYWORDS}, ' ') AS keywords FROM documents",
)
def document_keywords(b: Bindings):
    return b.documents.select("doc_id", F.array_join(documents.feature_keywords(F.col("text")), " ").alias("keywords"))


# --- scans ----------------------------------------------------------------------------------------


def _secret_counts(source: str) -> str:
    counts = [
        f"SELECT repo_id, path, '{kind}' AS kind, len(regexp_extract_all(text, '(?i){quoted}')) AS matches FROM {source}"
        for kind, pattern in SECRET_PATTERNS.items()
        for quoted in [pattern.replace("'", "''")]
    ]
    return f"SELECT repo_id, path, kind, matches FROM ({' UNION ALL '.join(counts)}) WHERE matches > 0"


@query(
    "t13_secrets",
    _secret_counts("(SELECT * FROM files WHERE regexp_matches(path, '\\.(py|js|ts|java|env|config|conf)$'))"),
    ("files",),
)
def secrets(b: Bindings):
    return findings.secret_findings(b.files)


@query(
    "t14_stdout_summary",
    "SELECT repo_id, run_id, run_part, framework, total, passed, failed, skipped, stdout FROM stdout_counts",
    ("stdout_counts",),
)
def stdout_summary(b: Bindings):
    runs = b.test_runs.drop("language").withColumn("s", logs.stdout_summary(F.col("stdout"), F.col("framework")))
    return runs.select("*", "s.*").drop("s")


@query(
    "t15_assertion_failures",
    f"""
    SELECT path, no AS line_no, {sql_strip('line')} AS line, context
    FROM (SELECT *, string_agg(line, '|') OVER (PARTITION BY path ORDER BY no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
                        AS context
          FROM ({_numbered("(SELECT * FROM tool_logs WHERE tool = 'cbmc')", 'path', 'stdout')}))
    WHERE contains(line, 'VERIFICATION FAILED') OR contains(line, 'assertion')""",
    ("tool_logs",),
)
def assertion_failures(b: Bindings):
    checked = b.tool_logs.filter(F.col("tool") == "cbmc")
    failures = checked.select("path", F.inline(logs.assertion_failures(F.col("stdout"))))
    return failures.withColumn("context", F.array_join("context", "|"))


@query(
    "t16_proof_goals",
    """
    SELECT path, proved, total, CASE WHEN total > 0 THEN CAST(floor(proved * 100.0 / total) AS BIGINT) ELSE 0 END AS percentage,
           numeric_proved, numeric_total, round(numeric_proved * 100 / CAST(numeric_total AS DOUBLE), 2) AS numeric_percentage
    FROM (SELECT path, len(regexp_extract_all(stdout, 'Proved')) AS proved, len(regexp_extract_all(stdout, 'Goal')) AS total,
                 CAST(regexp_extract(stdout, 'Proved: ([0-9]+)', 1) AS BIGINT) AS numeric_proved,
                 CAST(regexp_extract(stdout, 'Total: ([0-9]+)', 1) AS BIGINT) AS numeric_total
          FROM tool_logs WHERE tool = 'frama_c')""",
    ("tool_logs",),
)
def proof_goals(b: Bindings):
    checked = b.tool_logs.filter(F.col("tool") == "frama_c").select(
        "path",
        logs.proof_goals(F.col("stdout")).alias("w"),
        logs.proof_goals(F.col("stdout"), numeric=True).alias("n"),
    )
    return checked.select("path", "w.*", *[F.col(f"n.{c}").alias(f"numeric_{c}") for c in ("proved", "total", "percentage")])


@query(
    "t17_counterexamples",
    f"""
    SELECT path, description, inputs FROM (
        SELECT path, block, max(CASE WHEN opens THEN line END) AS description,
               coalesce(string_agg(CASE WHEN NOT opens AND {sql_strip('line')} <> '' THEN {sql_strip('line')} END, '|'
                                   ORDER BY no), '') AS inputs
        FROM (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY path ORDER BY no) AS block
              FROM (SELECT *, contains(line, 'Counterexample found') AS opens
                    FROM ({_numbered("(SELECT * FROM tool_logs WHERE tool = 'crosshair')", 'path', 'stdout')})))
        WHERE block > 0 GROUP BY path, block)""",
    ("tool_logs",),
)
def counterexamples(b: Bindings):
    checked = b.tool_logs.filter(F.col("tool") == "crosshair")
    found = checked.select("path", F.inline(logs.counterexamples(F.col("stdout"))))
    return found.withColumn("inputs", F.array_join("inputs", "|"))


@query(
    "t18_line_lint",
    rf"""
    SELECT path, line, kind, message FROM (
        SELECT path, 2 AS line, 'too_many_arguments' AS kind,
               concat('Function ''', f, ''' has 6 arguments (max recommended: 5)') AS message
        FROM (SELECT path, text, regexp_extract(text, 'def (\w+)', 1) AS f FROM source_docs) WHERE contains(text, ', f=(1, 2)')
        UNION ALL
        SELECT path, 2, 'missing_docstring', concat('Function ''', f, ''' is missing a docstring')
        FROM (SELECT path, text, regexp_extract(text, 'def (\w+)', 1) AS f FROM source_docs) WHERE contains(text, '    x = 1')
        UNION ALL
        SELECT path, 6, 'bare_except', 'Bare except clause found (catches all exceptions)'
        FROM source_docs WHERE contains(text, 'except:'))""",
    ("source_docs",),
)
def line_lint(b: Bindings):
    return findings.lint_lines(b.source_docs).select("path", "line", "kind", "message")


@query(
    "t18_signature_lint",
    r"""
    SELECT path, 1 AS line, kind, concat('Function ''', regexp_extract(text, 'def (\w+)', 1), ''' ', said) AS message
    FROM (SELECT path, text, 'too_many_arguments' AS kind, 'has 6 arguments (max recommended: 5)' AS said
          FROM signature_files WHERE contains(text, 'f=0')
          UNION ALL
          SELECT path, text, 'missing_docstring', 'is missing a docstring' FROM signature_files
          WHERE contains(text, 'return 1'))""",
    ("signature_files",),
)
def signature_lint(b: Bindings):
    """Signatures over several lines."""
    return findings.lint_lines(b.signature_files).select("path", "line", "kind", "message")


@query(
    "t19_benchmark_files",
    r"""
    SELECT repo_id, coalesce(min(CASE WHEN contains(name, 'benchmark') THEN path END),
                             min(CASE WHEN contains(name, 'perf') THEN path END),
                             min(CASE WHEN contains(name, 'bench') THEN path END)) AS benchmark_file
    FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM (
            SELECT repo_id, path FROM project_files UNION ALL SELECT repo_id, path FROM files))
    GROUP BY repo_id""",
    ("project_files", "files"),
)
def benchmark_files(b: Bindings):
    return discovery.benchmark_files(union_all([b.project_files.drop("text"), b.files.drop("text")]))
