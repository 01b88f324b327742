"""R: redaction at three levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.catalog.registry import query, sql_rewrite
from auditframe.functions import redact
from auditframe.functions.fixed_values import LOCAL_IP_STARTS, SAFE_IPS, SAFE_MACS
from auditframe.functions.text import SPACE, rewrite_matches
from auditframe.operators.grouping import join_large
from auditframe.session import deal
from auditframe.sources.bindings import Bindings

# --- ANSI twins of the rules ----------------------------------------------------------------------

_ASSIGNED = rf"(?i)(?:api[_-]?key|token|secret)[\x22\x27]?{SPACE}*[:=]{SPACE}*[\x22\x27]?[a-zA-Z0-9_\-]{{10,}}[\x22\x27]?"
_STANDALONE = r"\b(?:sk-[a-zA-Z0-9_\-]{10,}|pk_[a-zA-Z0-9_\-]{10,}|[a-zA-Z0-9]{32,})\b"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
_HOST = rf"(?i)(?:hostname|machine|computer)[\x22\x27]?{SPACE}*[:=]{SPACE}*[\x22\x27]?[a-zA-Z0-9_\-\.]+[\x22\x27]?"


def _masked(equals: str, colon: str) -> str:
    return (
        f"CASE WHEN contains(m, '=') THEN split_part(m, '=', 1) || '{equals}' "
        f"ELSE split_part(m, ':', 1) || '{colon}' END"
    )


def sql_secrets(x: str) -> list[str]:
    """Steps as expressions of the column ``t``; the first reads ``x``."""
    return [
        sql_rewrite(x, _ASSIGNED, _masked("=[REDACTED]", ': "[REDACTED]"')),
        "regexp_replace(t, 'ssh-(?:rsa|dss|ed25519) [A-Za-z0-9+/=]+', '[SSH_KEY_REDACTED]', 'g')",
        f"regexp_replace(t, '{_STANDALONE}', '[SECRET_REDACTED]', 'g')",
        "regexp_replace(t, 'gh[ps]_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]+', '[GITHUB_TOKEN_REDACTED]', 'g')",
        "regexp_replace(t, 'AKIA[0-9A-Z]{16}', '[AWS_ACCESS_KEY_REDACTED]', 'g')",
        rf"regexp_replace(t, '(?i)((?:aws_secret_access_key|aws_secret_key|secret_key){SPACE}*)={SPACE}*[A-Za-z0-9/+=]{{40}}', "
        r"'\1=[AWS_SECRET_REDACTED]', 'g')",
        sql_rewrite(
            "t", "(?:https?|ftp)://[^:]+:[^@]+@[^/]+",
            "regexp_replace(m, '://[^@]+@', '://[CREDENTIALS_REDACTED]@', 'g')",
        ),
    ]


def sql_paths(x: str) -> list[str]:
    return [
        f"regexp_replace({x}, '(?i)/(?:home|Users)/([^/]+)/', '/home/USER/', 'g')",
        r"regexp_replace(t, '(?i)C:\\Users\\([^\\]+)\\', 'C:\\Users\\USER\\', 'g')",
    ]


def sql_emails(x: str, level: str) -> str:
    local, domain = "split_part(m, '@', 1)", "split_part(m, '@', 2)"
    masked = {
        "high": "'[EMAIL_REDACTED]'",
        "medium": f"left(sha256({local}), 8) || '@' || {domain}",
        "low": f"CASE WHEN length({local}) > 2 THEN left({local}, 1) || '***' || right({local}, 1) || '@' || {domain} ELSE m END",
    }
    return sql_rewrite(x, _EMAIL, masked[level])


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_ips(x: str, level: str) -> str:
    if level == "high":
        return sql_rewrite(x, _IPV4, "'[IP_REDACTED]'")
    local = " OR ".join(f"starts_with(m, '{start}')" for start in LOCAL_IP_STARTS)
    hidden = "split_part(m, '.', 1) || '.' || split_part(m, '.', 2) || '.XXX.XXX'"
    return sql_rewrite(x, _IPV4, f"CASE WHEN m IN {_in(SAFE_IPS)} OR {local} THEN m ELSE {hidden} END")


def sql_macs(x: str, level: str) -> str:
    if level == "low":
        return x
    if level == "high":
        return sql_rewrite(x, _MAC, "'[MAC_REDACTED]'")
    halves = " ".join(
        f"WHEN len(string_split(m, '{s}')) = 6 THEN array_to_string(list_concat(string_split(m, '{s}')[1:3], "
        f"['XX', 'XX', 'XX']), '{s}')"
        for s in ":-"
    )
    return sql_rewrite(x, _MAC, f"CASE WHEN upper(m) IN {_in(SAFE_MACS)} THEN m {halves} ELSE m END")


def sql_hosts(x: str, level: str) -> str:
    return x if level == "low" else sql_rewrite(x, _HOST, _masked('="[HOSTNAME]"', ': "[HOSTNAME]"'))


def sql_chain(source: str, keys: str, column: str, steps: list[str]) -> str:
    """Steps applied one after the other; each reads ``t`` of the one before."""
    body = f"SELECT {keys}, {steps[0].replace('__x__', column)} AS t FROM {source}"
    for step in steps[1:]:
        body = f"SELECT {keys}, {step} AS t FROM ({body})"
    return f"SELECT {keys}, t AS text FROM ({body})"


def sql_all(level: str) -> list[str]:
    return [
        *sql_secrets("__x__"), *sql_paths("t"), sql_emails("t", level), sql_ips("t", level), sql_macs("t", level),
        sql_hosts("t", level),
    ]


# Texts with one planted instance of each kind, made of the given values.
PLANTED = """
    SELECT p_partkey, concat(
        'mail ', replace(p_name, ' ', '.'), '@example', CAST(p_size AS STRING), '.com ip ', CAST(p_partkey % 250 AS STRING),
        '.', CAST(p_size AS STRING), '.7.9 mac 0a:1B:', CAST(10 + p_size AS STRING), ':33:44:55 or 00-11-22-33-44-',
        CAST(10 + p_size AS STRING), ' safe 00:00:00:00:00:00 hostname="', replace(p_name, ' ', '-'),
        '.local" machine: box', CAST(p_size AS STRING), ' at /home/user', CAST(p_partkey AS STRING),
        '/x and C:', chr(92), 'Users', chr(92), 'me', CAST(p_partkey AS STRING), chr(92), 'f api_key = "', md5(p_name),
        '" secret: ', md5(p_type), ' ssh-rsa AAAA', md5(p_name), '== AKIA', upper(substr(md5(p_name), 1, 16)),
        ' url https://user:', p_brand, '@host.org/p aws_secret_key = ', substr(concat(md5(p_name), md5(p_type)), 1, 40),
        ' plain ', md5(p_brand), ' ghp_', substr(concat(md5(p_brand), md5(p_name)), 1, 36)) AS text
    FROM {part}"""


def planted(b: Bindings):
    return b.sql(PLANTED)


def _register(name: str, rule, steps: list[str], source: str = "documents", keys: str = "doc_id", column: str = "text"):
    """One rule over a given table, and over the planted texts."""

    @query(name, sql_chain(source, keys, column, steps))
    def over_table(b: Bindings):
        return b.table(source).select(*keys.split(", "), rule(F.col(column)).alias("text"))

    if source != "documents":
        return

    @query(f"{name}_planted", sql_chain(f"({PLANTED.replace('{part}', 'part')})", "p_partkey", "text", steps))
    def over_planted(b: Bindings):
        return planted(b).select("p_partkey", rule(F.col("text")).alias("text"))


@query(
    "r0_rewrite_matches",
    f"SELECT doc_id, {sql_rewrite('text', '[0-9]+', chr(39) + '<' + chr(39) + ' || reverse(m) || ' + chr(39) + '>' + chr(39))} AS text FROM documents",
)
def rewritten(b: Bindings):
    def reversed_number(m):
        return F.concat(F.lit("<"), F.reverse(m), F.lit(">"))

    return b.documents.select("doc_id", rewrite_matches(F.col("text"), "[0-9]+", reversed_number).alias("text"))


_register("r1_secrets", redact.mask_secrets, sql_secrets("__x__"))
_register("r2_paths", redact.mask_paths, sql_paths("__x__"))
_register("r2_page_urls", redact.mask_paths, sql_paths("__x__"), "pages", "page_id", "url")
for _level in redact.LEVELS:
    _register(f"r3_email_{_level}", lambda t, level=_level: redact.mask_emails(t, level), [sql_emails("__x__", _level)])
    _register(f"r4_ip_{_level}", lambda t, level=_level: redact.mask_ips(t, level), [sql_ips("__x__", _level)])
    _register(f"r5_mac_{_level}", lambda t, level=_level: redact.mask_macs(t, level), [sql_macs("__x__", _level)])
    _register(f"r6_host_{_level}", lambda t, level=_level: redact.mask_hosts(t, level), [sql_hosts("__x__", _level)])
    _register(f"r7_text_{_level}", lambda t, level=_level: redact.redact_text(t, level), sql_all(_level))
_register("r7_conversations", redact.redact_text, sql_all("medium"), "conversations", "conv_id, turn")
_register("r7_pages", redact.redact_text, sql_all("medium"), "pages", "page_id", "html")


@query("r7_redacted_sources", f"""
    SELECT source, count(*) AS documents, count_if(t <> text) AS redacted
    FROM (SELECT d.source, d.text, r.text AS t FROM documents d
          JOIN ({sql_chain('documents', 'doc_id', 'text', sql_all('medium'))}) r ON d.doc_id = r.doc_id)
    GROUP BY source""".replace("count_if(t <> text)", "CAST(count_if(t <> text) AS BIGINT)"))
def redacted_sources(b: Bindings):
    """How many documents of each source hold something to redact."""
    changed = b.documents.select("source", (redact.redact_text(F.col("text")) != F.col("text")).alias("changed"))
    return changed.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("changed").cast("bigint").alias("redacted")
    )


@query(
    "r8_nested",
    f"""
    SELECT p.p_partkey AS p_partkey, p.p_size AS number, r.text AS inner_text, r.text AS listed, r.text AS map_value,
           'k [EMAIL_REDACTED]' AS map_key
    FROM part p JOIN ({sql_chain('(' + PLANTED.replace('{part}', 'part') + ')', 'p_partkey', 'text', sql_all('high'))}) r
      ON p.p_partkey = r.p_partkey""",
)
def nested(b: Bindings):
    """A record of structs, lists and maps, redacted as a whole, then read back.

    The parts are dealt out by their key before they become texts: neither the driver nor a shuffle gets a text.
    """
    part = deal(b.part, "p_partkey")
    base = join_large(b.spark.sql(PLANTED, part=part), part.select("p_partkey", "p_size"), ["p_partkey"])
    record = base.select(
        "p_partkey",
        F.struct(
            F.col("p_size").alias("number"),
            F.struct(F.col("text").alias("inner")).alias("config"),
            F.array(F.struct(F.col("text").alias("item"))).alias("list"),
            F.create_map(F.lit("k a.b@c.org"), F.col("text")).alias("map"),
        ).alias("record"),
    )
    out = redact.redact_frame(record, "high")
    return out.select(
        "p_partkey",
        F.col("record.number").alias("number"),
        F.col("record.config.inner").alias("inner_text"),
        F.col("record.list")[0]["item"].alias("listed"),
        F.map_values("record.map")[0].alias("map_value"),
        F.map_keys("record.map")[0].alias("map_key"),
    )
