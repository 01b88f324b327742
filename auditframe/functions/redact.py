"""Redaction of secrets, paths, addresses and host names at three levels: low, medium, high.

Every rule maps a text column to a text column. Their order in ``redact_text`` is part of the result:
later rules see what earlier ones wrote.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.functions import fixed_values as fixed
from auditframe.functions.text import let, replace_matches, rewrite_matches

LEVELS = ("low", "medium", "high")


def _check(level: str) -> None:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")


def _mask_assignment(match: Column, equals_mask: str, colon_mask: str) -> Column:
    """Keep the part before the delimiter of ``key = value`` or ``key: value``, mask the value."""
    return F.when(
        match.contains("="), F.concat(F.substring_index(match, "=", 1), F.lit(equals_mask))
    ).otherwise(F.concat(F.substring_index(match, ":", 1), F.lit(colon_mask)))


def mask_secrets(text: Column) -> Column:
    """Assigned keys first, then bare keys of known shapes, then credentials in URLs."""
    text = rewrite_matches(
        text,
        fixed.ASSIGNED_KEY,
        lambda m: _mask_assignment(m, "=[REDACTED]", ': "[REDACTED]"'),
        words=("api", "token", "secret"),
    )
    text = replace_matches(text, fixed.SSH_KEY, "[SSH_KEY_REDACTED]", needs=("ssh-",))
    text = F.regexp_replace(text, fixed.STANDALONE_SECRET, "[SECRET_REDACTED]")
    text = replace_matches(
        text, fixed.GITHUB_TOKEN, "[GITHUB_TOKEN_REDACTED]", needs=("_",), words=("ghp_", "ghs_", "github_pat_")
    )
    text = replace_matches(text, fixed.AWS_ACCESS_KEY, "[AWS_ACCESS_KEY_REDACTED]", needs=("AKIA",))
    text = replace_matches(text, fixed.AWS_SECRET, "$1=[AWS_SECRET_REDACTED]", needs=("_", "="))
    return rewrite_matches(
        text,
        fixed.URL_CREDENTIALS,
        lambda m: F.regexp_replace(m, fixed.URL_USER_PART, "://[CREDENTIALS_REDACTED]@"),
        needs=("://", "@"),
    )


def mask_paths(text: Column, home: str | None = None, user: str | None = None) -> Column:
    """Hide user names in paths. Home and user are arguments: the cluster's own would leak."""
    if home:
        text = F.replace(text, F.lit(home), F.lit("~"))
    if user:
        quoted = re.escape(user)
        text = F.regexp_replace(text, f"/(?:home|Users)/{quoted}/", "/home/USER/")
        text = F.regexp_replace(text, rf"C:\\Users\\{quoted}\\", r"C:\\Users\\USER\\")
    text = replace_matches(text, fixed.USER_PATH, "/home/USER/", needs=("/",))
    return replace_matches(text, fixed.WINDOWS_PATH, r"C:\\Users\\USER\\", needs=(":\\",))


def mask_emails(text: Column, level: str = "medium") -> Column:
    _check(level)
    if level == "high":
        return replace_matches(text, fixed.EMAIL, "[EMAIL_REDACTED]", needs=("@",))

    def masked(email: Column) -> Column:
        local, domain = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
        if level == "medium":
            return F.concat(F.substring(F.sha2(local, 256), 1, 8), F.lit("@"), domain)
        shortened = F.concat(F.left(local, F.lit(1)), F.lit("***"), F.right(local, F.lit(1)), F.lit("@"), domain)
        return F.when(F.length(local) > 2, shortened).otherwise(email)

    return rewrite_matches(text, fixed.EMAIL, masked, needs=("@",))


def mask_ips(text: Column, level: str = "medium") -> Column:
    """Low and medium keep local and well-known addresses and the first half of all others."""
    _check(level)
    if level == "high":
        return F.regexp_replace(text, fixed.IPV4, "[IP_REDACTED]")

    def masked(ip: Column) -> Column:
        kept = ip.isin(fixed.SAFE_IPS)
        for start in fixed.LOCAL_IP_STARTS:
            kept = kept | ip.startswith(start)
        return F.when(kept, ip).otherwise(F.concat(F.substring_index(ip, ".", 2), F.lit(".XXX.XXX")))

    return rewrite_matches(text, fixed.IPV4, masked)


def mask_macs(text: Column, level: str = "medium") -> Column:
    """Medium keeps the vendor half; low keeps everything."""
    _check(level)
    if level == "low":
        return text
    if level == "high":
        return F.regexp_replace(text, fixed.MAC, "[MAC_REDACTED]")

    def masked(mac: Column) -> Column:
        def halved(separator: str) -> Column:
            # NULL unless the separator divides the address into its six parts.
            vendor = F.substring_index(mac, separator, 3)
            hidden = F.concat(vendor, F.lit(separator), F.lit(separator.join(["XX"] * 3)))
            return F.when(F.size(F.split(mac, separator)) == 6, hidden)

        kept = F.upper(mac).isin(fixed.SAFE_MACS)
        return F.when(kept, mac).otherwise(F.coalesce(halved(":"), halved("-"), mac))

    return rewrite_matches(text, fixed.MAC, masked)


def mask_hosts(text: Column, level: str = "medium", host: str | None = None) -> Column:
    """Replace the given host name, and, above level low, whatever is assigned to a host key."""
    _check(level)
    if host:
        text = F.replace(text, F.lit(host), F.lit("[HOSTNAME]"))
    if level == "low":
        return text
    return rewrite_matches(
        text,
        fixed.HOST_ASSIGNMENT,
        lambda m: _mask_assignment(m, '="[HOSTNAME]"', ': "[HOSTNAME]"'),
        words=("hostname", "machine", "computer"),
    )


def redact_text(
    text: Column,
    level: str = "medium",
    home: str | None = None,
    user: str | None = None,
    host: str | None = None,
) -> Column:
    """All rules in their fixed order; NULL and empty texts stay as they are."""
    _check(level)
    text = mask_secrets(text)
    text = mask_paths(text, home, user)
    text = mask_emails(text, level)
    text = mask_ips(text, level)
    text = mask_macs(text, level)
    return mask_hosts(text, level, host)


def _last_of_equal_keys(pairs: Column) -> Column:
    """Entries of a map without those whose key comes again, in their order."""
    placed = F.array_sort(F.transform(pairs, lambda e, i: F.struct(e["key"].alias("key"), i.alias("place"))))

    def last(entries: Column) -> Column:
        ends = lambda e, i: F.coalesce(F.get(entries, i + 1)["key"] != e["key"], F.lit(True))
        return F.array_sort(F.transform(F.filter(entries, ends), lambda e: e["place"]))

    return F.transform(let(placed, last), lambda place: F.get(pairs, place))


def redact_value(value: Column, data_type: T.DataType, level: str = "medium", **known: str | None) -> Column:
    """Redact every text inside a nested value, driven by its type.

    Numbers, booleans and NULLs are kept; map keys are rewritten too; other leaf types become redacted
    text. Struct field names are schema, not data, and stay.
    """
    if isinstance(data_type, T.StringType):
        return redact_text(value, level, **known)
    if isinstance(data_type, (T.NumericType, T.BooleanType, T.NullType)):
        return value
    if isinstance(data_type, T.StructType):
        fields = [
            redact_value(value[field.name], field.dataType, level, **known).alias(field.name)
            for field in data_type.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, data_type.elementType, level, **known))
    if isinstance(data_type, T.MapType):
        pairs = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                redact_value(e["key"], data_type.keyType, level, **known).alias("key"),
                redact_value(e["value"], data_type.valueType, level, **known).alias("value"),
            ),
        )
        # Two keys may become one; the last then wins, as with any later assignment. Sorted by key and place, the
        # last of equal keys stands before another key; the places then bring back the order.
        return F.map_from_entries(let(pairs, _last_of_equal_keys))
    return redact_text(value.cast("string"), level, **known)


def pseudonym(key: Column, redacted: Column) -> Column:
    """A key as it is where the rules leave it alone, else its redacted text and 16 digits of its hash.

    Keys that differ stay different and equal ones equal, in every table, so tables still join.
    """
    return F.when(redacted == key, key).otherwise(F.concat(redacted, F.lit("#"), F.left(F.sha2(key, 256), F.lit(16))))


def redact_frame(df: DataFrame, level: str = "medium", keys: Sequence[str] = (), **known: str | None) -> DataFrame:
    """Redact every text of every column, at any depth; ``keys`` name text columns that get pseudonyms.

    The text columns go through the rules as one array, so that the plan holds the rules once.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    redacted = F.transform(F.array(*[F.col(f"`{c}`") for c in texts]), lambda t: redact_text(t, level, **known))
    packed = df.withColumn("__texts", redacted) if texts else df

    def column(field: T.StructField) -> Column:
        if field.name in texts:
            redacted = F.element_at("__texts", texts.index(field.name) + 1)
            return pseudonym(F.col(f"`{field.name}`"), redacted) if field.name in keys else redacted
        return redact_value(F.col(f"`{field.name}`"), field.dataType, level, **known)

    return packed.select(*[column(f).alias(f.name) for f in df.schema.fields])
