"""Python signatures that run over several lines, put on one line.

Works on numbered text (``text.number_lines``), so that every other line keeps its number. A signature goes on while
a bracket is open, inside a string in triple quotes, or behind a backslash. Only positions are folded over the
text, so the work is linear however long a signature or the body behind it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe.functions.text import let

#: The line that opens a function or class, in numbered text.
DEFINITION = r"[0-9]+:[ \t]*(?:def|class)[ \t]"

_STRINGS = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\n]*\"|'[^'\n]*'"
_COMMENT = r"#[^\n]*"
_CONTINUED = r"\\\n[0-9]+:[ \t]*"
# The last alternative takes quotes without a partner and lone backslashes.
_TOKEN = rf"{_STRINGS}|{_COMMENT}|{_CONTINUED}|[\[({{\])}}]|[^\[({{\])}}\"'#\\]+|[\s\S]"


def sections(numbered_text: Column) -> Column:
    """The text cut before each definition, every signature on one line; together they are the whole text."""
    return F.transform(F.split(numbered_text, f"(?dm)(?=^{DEFINITION})"), _one_line)


def _one_line(section: Column) -> Column:
    first = F.substring_index(section, "\n", 1)
    opened = F.length(F.regexp_replace(first, r"[^\[({]", ""))
    closed = F.length(F.regexp_replace(first, r"[^\])}]", ""))
    # Without quotes, brackets of a line that is whole are balanced; nearly all definitions end here.
    whole = (opened == closed) & ~first.rlike(r"[\"']") & ~first.endswith("\\")
    return F.when(whole | ~section.rlike(rf"\A{DEFINITION}"), section).otherwise(_joined(section))


def _joined(section: Column) -> Column:
    def cut(plain: Column, place: Column) -> Column:
        head = F.substr(plain, F.lit(1), place)
        return F.when(place > 0, F.concat(_flat(head), F.substr(section, place + 1))).otherwise(section)

    # Escapes become fillers of the same length: no quote is escaped any more, and places stay.
    filled = F.regexp_replace(section, r"\\[^\n]", "__")
    return let(filled, lambda plain: let(_last_break(plain), lambda place: cut(plain, place)))


def _last_break(plain: Column) -> Column:
    """Characters up to the last line of the signature, 0 if it has one line or never closes."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("last"), F.lit(False).alias("done")
    )

    def step(state: Column, token: Column) -> Column:
        opens, closes = token.isin("[", "(", "{"), token.isin("]", ")", "}")
        at = state["at"] + F.length(token)
        breaks = token.contains("\n")
        quoted = token.startswith('"') | token.startswith("'")
        inside = (state["depth"] > 0) | quoted | token.startswith("\\")
        return F.struct(
            F.greatest(state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), F.lit(0)).alias("depth"),
            at.alias("at"),
            F.when(breaks & inside & ~state["done"], at).otherwise(state["last"]).alias("last"),
            (state["done"] | (breaks & ~inside)).alias("done"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["done"] | (state["depth"] == 0), state["last"]).otherwise(0)

    return F.aggregate(F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0)), start, step, finish)


def _flat(head: Column) -> Column:
    """The broken lines of a signature as one, without comments."""
    uncommented = F.regexp_replace(head, rf"({_STRINGS})|{_COMMENT}", "$1")
    return F.regexp_replace(uncommented, r"\\?\n[0-9]+:[ \t]*", " ")
