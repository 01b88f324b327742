"""Documentation texts: their units, and the claims, references and code examples in them.

Everything here maps a text to an array. Texts are cut into sections by splitting before headings, so no
window over a document's lines is needed and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe.functions import fixed_values as fixed
from auditframe.functions.classify import any_case, claim_confidence, is_documentation
from auditframe.functions.signatures import DEFINITION, sections
from auditframe.functions.text import (
    WORD,
    find_all,
    is_blank,
    let,
    line_no_of,
    line_text_of,
    lines,
    may_hold,
    number_lines,
    strip,
    suffix,
)

GENERAL = "General"

# White space within a line, and headings in a text whose lines carry their number ("12:text").
_GAP = r"[\t\x0b-\r\x1c-\x20\x85\p{Z}]*"
_RST_HEADING = rf"[0-9]+:[^\n]*\n[0-9]+:{_GAP}[=\-~]+{_GAP}$"
# Markdown blocks by their first line.
_FENCE = r" {0,3}```[^`\n]*$"
_ITEM = r"[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+"
_RULE = r" {0,3}(?:[-_*][ \t]*){3,}$"
_UNDERLINE = r" {0,3}(?:=+|-+)[ \t]*$"
_UNDERLINED = rf"[0-9]+:(?!{_ITEM}|#{{1,6}} |{_RULE}|{_UNDERLINE}|{_GAP}$)[^\n]*\n[0-9]+:{_UNDERLINE}"
_MARKDOWN_HEADING = rf"(?:[0-9]+:#{{1,3}} [^\n]*$|{_UNDERLINED})"

# --- units of text --------------------------------------------------------------------------------


def text_units(text: Column) -> Column:
    """Non-blank lines with their numbers, all in one general section."""
    units = F.transform(
        lines(text),
        lambda line, i: F.struct(
            F.lit(0).alias("section_no"),
            (i + 1).alias("unit_no"),
            (i + 1).alias("line_number"),
            line.alias("text"),
            F.lit(GENERAL).alias("context"),
        ),
    )
    return F.filter(units, lambda u: ~is_blank(u["text"]))


def _sectioned(text: Column) -> Column:
    numbered = number_lines(text)
    sections = F.split(numbered, f"(?dm)(?=^{_RST_HEADING})")
    # Only the first section can lack a heading.
    opens_headed = numbered.rlike(f"(?dm)\\A{_RST_HEADING}")

    def units(section: Column, section_no: Column) -> Column:
        headed = (section_no > 0) | opens_headed
        rows = F.filter(lines(section), lambda row: row != "")
        context = F.when(headed, strip(line_text_of(F.element_at(rows, 1)))).otherwise(GENERAL)
        body = F.when(headed, F.slice(rows, F.lit(2), F.size(rows))).otherwise(rows)
        return F.transform(
            F.filter(body, lambda row: ~is_blank(line_text_of(row))),
            lambda row: F.struct(
                section_no.alias("section_no"),
                line_no_of(row).alias("unit_no"),
                line_no_of(row).alias("line_number"),
                line_text_of(row).alias("text"),
                context.alias("context"),
            ),
        )

    return F.flatten(F.transform(sections, units))


def rst_units(text: Column) -> Column:
    """Lines under the latest heading, a line that the next one underlines. Underlines are text too."""
    return _sectioned(text)


def _fenced_apart(text: Column) -> Column:
    """The numbered lines of a Markdown text, those of fenced code as "12;text"; fences become empty lines.

    What is code follows from how many fences come before; one that stays open reaches to the end.
    """
    numbered = number_lines(text)
    marked = F.transform(
        F.split(numbered, f"(?dm)^[0-9]+:{_FENCE}"),
        lambda piece, i: F.when(i % 2 == 0, piece).otherwise(F.regexp_replace(piece, "(?dm)^([0-9]+):", "$1;")),
    )
    return F.when(text.contains("```"), F.array_join(marked, "")).otherwise(numbered)


def markdown_units(text: Column) -> Column:
    """Paragraphs, list items and fenced code under the latest heading of level 1 to 3; line numbers are not kept.

    A block is one unit however many lines it wraps over; ``unit_no`` is its first line. Blank lines, headings,
    fences, rules and list items end a block; an item nested in another is a unit of its own and counts once.
    A line that the next one underlines with ``=`` or ``-`` is a heading. Lists need no blank line before them.
    Deeper headings and rules are no text; list markers, bold marks and back-ticks are left out but for code, whose
    lines stay as they are.
    """
    sections = F.split(_fenced_apart(text), f"(?dm)(?=^{_MARKDOWN_HEADING})")
    heading = f"(?dm)\\A{_MARKDOWN_HEADING}"

    def line_text(row: Column) -> Column:
        bare = F.regexp_replace(row, rf"\A[0-9]+:(?:{_ITEM}|[ \t]+)?", "")
        return F.when(row.rlike(r"\A[0-9]+;"), F.regexp_replace(row, r"\A[0-9]+;", "")).otherwise(
            F.regexp_replace(bare, r"\*\*|`", "")
        )

    def units(section: Column, section_no: Column) -> Column:
        title = F.regexp_replace(line_text(F.substring_index(section, "\n", 1)), "^#+|#+$", "")
        context = F.when(section.rlike(heading), strip(title)).otherwise(GENERAL)
        chunks = F.split(F.regexp_replace(section, heading, ""), f"(?dm)^(?:[0-9]+:{_GAP})?$")
        starts = f"(?dm)(?=^[0-9]+:(?:{_ITEM}|#{{4,6}} |{_RULE}))"
        blocks = F.flatten(F.transform(chunks, lambda chunk: F.split(chunk, starts)))

        def rows(block: Column) -> Column:
            return F.filter(lines(block), lambda row: (row != "") & ~row.rlike(f"\\A[0-9]+:(?:#{{4,6}} |{_RULE})"))

        def unit(held: Column) -> Column:
            return F.struct(
                section_no.alias("section_no"),
                F.regexp_extract(F.element_at(held, 1), r"\A[0-9]+", 0).cast("int").alias("unit_no"),
                F.lit(0).alias("line_number"),
                F.array_join(F.transform(held, line_text), "\n").alias("text"),
                context.alias("context"),
            )

        held = F.filter(F.transform(blocks, rows), lambda r: F.size(r) > 0)
        return F.filter(F.transform(held, unit), lambda u: ~is_blank(u["text"]))

    return F.flatten(F.transform(sections, units))


def _plain(html: Column) -> Column:
    """Text of an HTML fragment: tags dropped, the common entities resolved, ampersands last."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, character in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


# Elements without an end tag, and those whose texts are units.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_UNIT_ELEMENTS = ("p", "li", "code")
# A tag ends at the first ">" that is not inside a quoted attribute value.
_TAG = r"""</?[a-zA-Z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
# Comments, and elements whose content is no text; one that stays open reaches to the end. The first to begin holds
# what looks like the other.
_RAW = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"


def _html_elements(html: Column) -> Column:
    """Whole inner HTML of the outermost unit elements, each up to its own end tag.

    One pass over the tags keeps the names of the open elements. An end tag closes the last element of its
    name and all within; without such an element it counts for nothing. Elements that stay open end with the HTML.
    """
    # Each piece but the first begins with a tag. Marks go before whole tags, so that none is seen inside another's values.
    marked = F.regexp_replace(F.replace(html, F.lit("\x01"), F.lit("")), f"({_TAG})", "\x01$1")
    pieces = F.transform(
        F.split(marked, "\x01"),
        lambda piece: F.struct(
            F.lower(F.regexp_extract(piece, r"\A</?([a-zA-Z][^\s/>]*)", 1)).alias("name"),
            piece.startswith("</").alias("ends"),
            F.regexp_extract(piece, rf"\A{_TAG}", 0).endswith("/>").alias("closed"),
            F.regexp_replace(piece, rf"\A{_TAG}", "").alias("text"),
        ),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("open"),
        F.lit(0).alias("depth"),
        F.lit("").alias("text"),
        F.array().cast("array<string>").alias("found"),
    )

    def step(state: Column, piece: Column) -> Column:
        opened, depth = state["open"], state["depth"]
        last = F.array_position(F.reverse(opened), piece["name"]).cast("int")
        opens = (piece["name"] != "") & ~piece["ends"] & ~piece["closed"] & ~piece["name"].isin(*_VOID)
        stack = (
            F.when(piece["ends"] & (last > 0), F.slice(opened, F.lit(1), F.size(opened) - last))
            .when(opens, F.concat(opened, F.array(piece["name"])))
            .otherwise(opened)
        )

        def moved(after: Column) -> Column:
            begins = (depth == 0) & opens & piece["name"].isin(*_UNIT_ELEMENTS)
            inside = (depth > 0) & (F.size(after) >= depth)
            return F.struct(
                after.alias("open"),
                F.when(begins, F.size(after)).when(inside, depth).otherwise(0).alias("depth"),
                F.when(begins, piece["text"])
                .when(inside, F.concat(state["text"], piece["text"]))
                .otherwise("")
                .alias("text"),
                F.when((depth > 0) & ~inside, F.concat(state["found"], F.array(state["text"])))
                .otherwise(state["found"])
                .alias("found"),
            )

        return let(stack, moved)

    def finish(state: Column) -> Column:
        return F.when(state["depth"] > 0, F.concat(state["found"], F.array(state["text"]))).otherwise(state["found"])

    return F.aggregate(pieces, start, step, finish)


def html_units(html: Column) -> Column:
    """Text of paragraphs, list items and code under the latest heading; nested elements count once.

    Scripts, styles and comments are taken out first, so what they hold opens, closes and says nothing.
    """
    html = F.regexp_replace(html, _RAW, "")
    heading = r"(?is)\A<(h[1-3])\b[^>]*>(.*?)</\1>"
    sections = F.split(html, r"(?i)(?=<h[1-3]\b)")

    def units(section: Column, section_no: Column) -> Column:
        headed = section.rlike(heading)
        context = F.when(headed, _plain(F.regexp_extract(section, heading, 2))).otherwise(GENERAL)
        rest = F.when(headed, F.regexp_replace(section, heading, "")).otherwise(section)
        elements = F.transform(_html_elements(rest), _plain)
        return F.filter(
            F.transform(
                elements,
                lambda text, i: F.struct(
                    section_no.alias("section_no"),
                    i.alias("unit_no"),
                    F.lit(0).alias("line_number"),
                    text.alias("text"),
                    context.alias("context"),
                ),
            ),
            lambda u: ~is_blank(u["text"]),
        )

    return F.flatten(F.transform(sections, units))


def docstring_units(text: Column) -> Column:
    """Docstrings of a module and of its functions and classes."""
    quoted = '("""|\'\'\')(.*?)\\1'
    body = r"(?:\n[0-9]+:[ \t]*(?:#[^\n]*)?)*[rRuU]?" + quoted
    of_definition = rf"(?s)\A{DEFINITION}[^\n]*:[ \t]*{body}"
    of_module = rf"(?s)\A[0-9]+:(?:[ \t]*(?:#[^\n]*)?\n[0-9]+:)*[ \t]*[rRuU]?{quoted}"
    split = sections(number_lines(text))

    def unit(section: Column, section_no: Column) -> Column:
        defined = section.rlike(rf"\A{DEFINITION}")
        found = F.when(defined, F.regexp_extract(section, of_definition, 2)).otherwise(
            F.regexp_extract(section, of_module, 2)
        )
        line = F.when(defined, line_no_of(section)).otherwise(0)
        return F.struct(
            section_no.alias("section_no"),
            F.lit(0).alias("unit_no"),
            line.alias("line_number"),
            strip(F.regexp_replace(found, r"(?m)^[0-9]+:", "")).alias("text"),
            F.lit("docstring").alias("context"),
        )

    return F.filter(F.transform(split, unit), lambda u: u["text"] != "")


# --- claims ---------------------------------------------------------------------------------------

def _first_words(pattern: str) -> list[str]:
    """Fixed letters that every match of each alternative of the first group holds."""
    alternatives = pattern[1 : pattern.index(")")].split("|")
    required = [re.sub(r"s\?|\[[sx]\]\?", "", alternative) for alternative in alternatives]
    return [max(re.findall("[a-z]+(?: [a-z]+)*", r), key=len) for r in required]


_PATTERNS = [
    (kind, number, any_case(pattern), _first_words(pattern))
    for kind, patterns in fixed.CLAIM_PATTERNS.items()
    for number, pattern in enumerate(patterns)
]
_CLAIM_WORDS = sorted({word for *_, words in _PATTERNS for word in words})


def matched_claims(text: Column) -> Column:
    """Every match of every claim pattern in a text, as an array of (type, pattern, match, raw text).

    A pattern is tried only on texts that hold one of its words.
    """

    def of_pattern(kind: str, number: int, pattern: str, words: list[str]) -> Column:
        matches = F.when(may_hold(text, words), find_all(text, pattern, 2)).otherwise(
            F.array().cast("array<string>")
        )
        return F.transform(
            matches,
            lambda m, i: F.struct(
                F.lit(kind).alias("claim_type"),
                F.lit(number).alias("pattern_no"),
                i.alias("match_no"),
                m.alias("raw"),
            ),
        )

    return F.flatten(F.array(*[of_pattern(*p) for p in _PATTERNS]))


def _no_claims() -> Column:
    none = F.struct(
        F.lit("").alias("claim_type"), F.lit(0).alias("pattern_no"), F.lit(0).alias("match_no"), F.lit("").alias("raw")
    )
    return F.slice(F.array(none), 1, 0)


def claims_in(text: Column) -> Column:
    """``matched_claims``, with one check for all texts that cannot hold a claim."""
    return F.when(may_hold(text, _CLAIM_WORDS), matched_claims(text)).otherwise(_no_claims())


# --- code in documentation ------------------------------------------------------------------------


def code_blocks_in(text: Column) -> Column:
    """Bodies of fenced blocks in text order."""
    return F.when(text.contains("```"), find_all(text, fixed.CODE_BLOCK, 1)).otherwise(
        F.array().cast("array<string>")
    )


def calls_in(code: Column) -> Column:
    """Calls in a code block, read as claims that the function, or the object's method, exists."""
    functions = F.transform(
        find_all(code, fixed.FUNCTION_CALL, 1),
        lambda f: F.format_string("Function '%s' exists and can be called", f),
    )
    methods = F.zip_with(
        find_all(code, fixed.METHOD_CALL, 1),
        find_all(code, fixed.METHOD_CALL, 2),
        lambda o, m: F.format_string("Object '%s' has method '%s'", o, m),
    )

    def claims(texts: Column, pattern_no: int) -> Column:
        return F.transform(
            texts, lambda t, i: F.struct(F.lit(pattern_no).alias("pattern_no"), i.alias("match_no"), t.alias("text"))
        )

    return F.concat(claims(functions, 0), claims(methods, 1))


def references_in(text: Column) -> Column:
    """Back-ticked names: calls first, then classes, then files, in text order each."""
    classes = F.flatten(
        F.zip_with(
            find_all(text, fixed.REFERENCED_CLASS, 1),
            find_all(text, fixed.REFERENCED_CLASS, 2),
            lambda before, after: F.array(before, after),
        )
    )
    refs = F.concat(
        find_all(text, fixed.REFERENCED_CALL, 1),
        F.filter(classes, lambda c: c != ""),
        find_all(text, fixed.REFERENCED_FILE, 1),
    )
    return F.when(text.contains("`"), refs).otherwise(F.array().cast("array<string>"))


# --- claims of a whole file -----------------------------------------------------------------------


def document_units(path: Column, text: Column) -> Column:
    """Units of a documentation file by the rule of its type."""
    kind = suffix(path)
    return (
        F.when(kind == ".md", markdown_units(text)).when(kind == ".rst", rst_units(text)).otherwise(text_units(text))
    )


def _claim(source: str, unit: dict[str, Column], found: dict[str, Column]) -> Column:
    return F.struct(
        F.lit(source).alias("source"), *[c.alias(n) for n, c in unit.items()], *[c.alias(n) for n, c in found.items()]
    )


def _unit_claims(source: str, units: Column) -> Column:
    def of_unit(u: Column) -> Column:
        place = {n: u[n] for n in ("section_no", "unit_no", "line_number", "context")}
        return F.transform(
            claims_in(u["text"]),
            lambda c: _claim(
                source,
                place,
                {
                    "claim_type": c["claim_type"],
                    "pattern_no": c["pattern_no"],
                    "match_no": c["match_no"],
                    "text": strip(c["raw"]),
                    "confidence": claim_confidence(c["raw"], c["claim_type"]),
                },
            ),
        )

    return F.flatten(F.transform(units, of_unit))


def _example_claims(text: Column) -> Column:
    def of_block(code: Column, i: Column) -> Column:
        place = {
            "section_no": F.lit(0),
            "unit_no": i,
            "line_number": F.lit(0),
            "context": F.concat(F.lit("code_example_code_block_"), i.cast("string")),
        }
        return F.transform(
            calls_in(code),
            lambda c: _claim(
                "example",
                place,
                {
                    "claim_type": F.lit("api"),
                    "pattern_no": c["pattern_no"],
                    "match_no": c["match_no"],
                    "text": c["text"],
                    "confidence": F.lit(fixed.CODE_EXAMPLE_CONFIDENCE),
                },
            ),
        )

    return F.flatten(F.transform(code_blocks_in(text), of_block))


def claims_of_file(path: Column, text: Column) -> Column:
    """All claims of a file: of its docstrings, of its text and of its code examples."""
    documentation, kind = is_documentation(path), suffix(path)
    parts = [
        F.when(kind == ".py", _unit_claims("docstring", docstring_units(text))),
        F.when(documentation, _unit_claims("text", document_units(path, text))),
        F.when(documentation & (kind == ".md"), _example_claims(text)),
    ]
    return F.flatten(F.array_compact(F.array(*parts)))


# --- tokens ---------------------------------------------------------------------------------------


def api_words(text: Column) -> Column:
    """All words of a claim, repeated ones included."""
    return find_all(text, f"{WORD}+")


def feature_keywords(text: Column) -> Column:
    """The first three words of four letters or more that are not stop words, in lower case."""
    words = F.transform(
        F.filter(find_all(text, f"{WORD}+"), lambda w: F.length(w) >= fixed.FEATURE_KEYWORD_LENGTH), F.lower
    )
    kept = F.filter(words, lambda w: ~w.isin(fixed.FEATURE_STOP_WORDS))
    return F.slice(kept, 1, fixed.FEATURE_KEYWORDS)
