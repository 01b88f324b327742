"""Source texts: definitions, words, secrets and line lint, each as an array per text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe.functions import fixed_values as fixed
from auditframe.functions.classify import any_case, any_of
from auditframe.functions.signatures import sections
from auditframe.functions.text import (
    SPACE,
    WORD,
    find_all,
    is_blank,
    let,
    line_no_of,
    line_text_of,
    may_hold,
    number_lines,
    strip,
    suffix,
)

# --- definitions ----------------------------------------------------------------------------------

_PYTHON_SYMBOLS = (rf"def{SPACE}+({WORD}++){SPACE}*\(", rf"class{SPACE}+({WORD}++){SPACE}*[\(:]")
_SCRIPT_SYMBOLS = (rf"function{SPACE}+({WORD}++){SPACE}*\(", rf"class{SPACE}+({WORD}++){SPACE}*\{{")


def symbols_in(path: Column, text: Column) -> Column:
    """Functions and classes a file defines, each once; empty for languages without a rule."""
    kind = suffix(path)

    def defined(patterns: tuple[str, str]) -> Column:
        return F.array_distinct(F.concat(*[find_all(text, p, 1) for p in patterns]))

    return (
        F.when(kind == ".py", defined(_PYTHON_SYMBOLS))
        .when(kind.isin(".js", ".ts"), defined(_SCRIPT_SYMBOLS))
        .otherwise(F.array().cast("array<string>"))
    )


# --- words ----------------------------------------------------------------------------------------

# Words are cut into overlapping pieces of at most 95 characters, 64 apart: any 32 characters in a row
# lie within one piece, however long the word.
PIECE_STEP, KEY_LENGTH = 64, 32


def word_pieces(text: Column, shortest: int) -> Column:
    """Distinct pieces, of at least ``shortest`` characters, of the words of a text, in lower case."""
    longest = PIECE_STEP + KEY_LENGTH - 1
    pattern = rf"(?=({WORD}{{{shortest},{longest}}}+)){WORD}{{1,{PIECE_STEP}}}"
    return F.array_distinct(find_all(F.lower(text), pattern, 1))


def security_keywords_in(text: Column) -> Column:
    """The fixed security keywords a text holds, as substrings in any case."""
    return let(
        F.lower(text),
        lambda t: F.array_compact(F.array(*[F.when(t.contains(k), F.lit(k)) for k in fixed.SECURITY_KEYWORDS])),
    )


# --- secrets --------------------------------------------------------------------------------------


def is_scanned_for_secrets(path: Column) -> Column:
    return any_of([path.endswith(s) for s in fixed.SECRET_SCAN_SUFFIXES])


# Every match of a secret pattern holds one of these.
_SECRET_WORDS = {"api_key": ["api"], "password": ["passw", "pwd"], "token": ["token", "auth"], "aws": ["aws"]}


def secrets_in(path: Column, text: Column) -> Column:
    """Kinds of secrets in a file with their numbers of matches."""

    def matches(kind: str, pattern: str) -> Column:
        return F.when(may_hold(text, _SECRET_WORDS[kind]), F.size(find_all(text, any_case(pattern)))).otherwise(0)

    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), matches(kind, p).cast("bigint").alias("matches"))
            for kind, p in fixed.SECRET_PATTERNS.items()
        ]
    )
    found = F.filter(kinds, lambda k: k["matches"] > 0)
    return F.when(is_scanned_for_secrets(path), found)


# --- line lint ------------------------------------------------------------------------------------

_DEF = r"^\s*def\s+([\p{L}_][\p{L}\p{N}_]*)\s*\((.*)\)[^()]*:\s*(?:#.*)?$"
_CLASS = r"^\s*class\s+([\p{L}_][\p{L}\p{N}_]*)\s*(?:\(.*\))?\s*:\s*(?:#.*)?$"
_QUOTE = r"^\s*[rRuU]?[\"']"


def _positional_arguments(signature: Column) -> Column:
    """Plain parameters of a signature: none after a star, none before a slash."""
    unquoted = F.regexp_replace(signature, r"[\"'][^\"']*[\"']", "")
    # Runs of text between brackets, each bracket on its own; what lies within any is left out, however deep.
    parts = F.regexp_extract_all(unquoted, F.lit(r"[\[({\])}]|[^\[({\])}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, part: Column) -> Column:
        opens, closes = part.isin("[", "(", "{"), part.isin("]", ")", "}")
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        outside = ~opens & ~closes & (state["depth"] == 0)
        kept = F.when(outside, F.concat(state["kept"], F.array(part))).otherwise(state["kept"])
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), kept.alias("kept"))

    flat = F.array_join(F.aggregate(parts, start, step)["kept"], "")
    names = F.filter(F.transform(F.split(flat, ","), strip), lambda a: a != "")
    starred = F.array_position(F.transform(names, lambda a: a.startswith("*")), True)
    plain = F.when(starred > 0, F.slice(names, F.lit(1), (starred - 1).cast("int"))).otherwise(names)
    slash = F.array_position(plain, "/")
    return F.size(plain) - F.coalesce(slash, F.lit(0)).cast("int")


def lint_issues(path: Column, text: Column, max_arguments: int = 5) -> Column:
    """Long parameter lists, missing docstrings and bare excepts of a Python file, by line.

    A signature over several lines counts at its first. A docstring is a quote on the next line that is neither blank nor a
    comment; that neighbour is looked up in the array of the file's lines.
    """
    rows = F.split(F.array_join(sections(number_lines(text)), ""), "\n", -1)
    split = F.transform(rows, lambda row: F.struct(line_no_of(row).alias("no"), line_text_of(row).alias("text")))
    telling = F.filter(split, lambda x: ~is_blank(x["text"]) & ~strip(x["text"]).startswith("#"))

    def of_rows(rows: Column) -> Column:
        def issues(row: Column, i: Column) -> Column:
            text = row["text"]
            following = F.coalesce(F.get(rows, i + 1)["text"], F.lit(""))
            is_def, is_class = text.rlike(_DEF), text.rlike(_CLASS)
            name = F.when(is_def, F.regexp_extract(text, _DEF, 1)).otherwise(F.regexp_extract(text, _CLASS, 1))
            arguments = _positional_arguments(F.regexp_extract(text, _DEF, 2))
            what = F.when(is_def, "Function").otherwise("Class")

            def issue(kind: str, message: Column) -> Column:
                return F.struct(row["no"].alias("line"), F.lit(kind).alias("kind"), message.alias("message"))

            return F.array(
                F.when(
                    is_def & (arguments > max_arguments),
                    issue(
                        "too_many_arguments",
                        F.format_string(
                            f"Function '%s' has %d arguments (max recommended: {max_arguments})", name, arguments
                        ),
                    ),
                ),
                F.when(
                    (is_def | is_class) & ~following.rlike(_QUOTE),
                    issue("missing_docstring", F.format_string("%s '%s' is missing a docstring", what, name)),
                ),
                F.when(
                    text.rlike(r"^\s*except\s*:"),
                    issue("bare_except", F.lit("Bare except clause found (catches all exceptions)")),
                ),
            )

        return F.array_compact(F.flatten(F.transform(rows, issues)))

    return F.when(suffix(path) == ".py", let(telling, of_rows))
