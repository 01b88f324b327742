"""Text helpers shared by every operator.

Regular expressions are written with explicit Unicode classes, so that a word, a space or a digit
means the same on every JDK and for every language: Java's own ``\\w`` and ``\\s`` are ASCII, and
what ``\\b`` means has changed between JDK releases.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contents of a character class, and the class itself.
WORD_CHARS = r"\p{L}\p{N}_"
WORD = f"[{WORD_CHARS}]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
DIGIT = r"\p{Nd}"

# Zero-width word edges.
STARTS_WORD = f"(?<!{WORD})"
ENDS_WORD = f"(?!{WORD})"
WORD_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Case-insensitive over Unicode; a dot stops at line feeds only.
ANY_CASE = "(?iud)"
UNIX_LINES = "(?d)"

# Every character that counts as white space when a text is trimmed.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space, Unicode spaces included, at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def number_lines(text: Column) -> Column:
    """The text with its line number in front of each line, so that parts of it keep their place."""
    marked = F.transform(lines(text), lambda line, i: F.concat((i + 1).cast("string"), F.lit(":"), line))
    return F.array_join(marked, "\n")


def line_no_of(line: Column) -> Column:
    return F.substring_index(line, ":", 1).try_cast("int")


def line_text_of(line: Column) -> Column:
    return F.substr(line, F.locate(":", line) + 1)


def whole_number(text: Column, type: str) -> Column:
    """``try_cast`` where most texts are no numbers: a cast that fails costs far more than a look at the start."""
    return F.when(text.rlike(r"^[\x00-\x20]*[+-]?[0-9]"), text.try_cast(type))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches of ``pattern``, as an array of one group's texts."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, NULL (not an empty text) where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name, so that ``body`` may use it many times at the cost of one.

    Without it a chain of n steps, each using its input k times, grows to k**n expressions.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# Characters that fold to an ASCII letter without being its other case.
_FOLDING = "\u017f\u0131\u0130\u212a"


def _any(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def may_hold(text: Column, words: Sequence[str]) -> Column:
    """False only if a text surely holds none of the lower-case words, in any case.

    Byte searches for fixed words cost a fraction of a case-insensitive pattern that finds nothing, so
    they go first. Texts with characters that fold in unusual ways are left to the pattern.
    """
    found = let(F.lower(text), lambda t: _any([t.contains(w) for w in words]))
    return found | _any([text.contains(c) for c in _FOLDING])


def _holds(text: Column, needs: Sequence[str], words: Sequence[str]) -> Column:
    held = F.lit(True)
    for literal in needs:
        held = held & text.contains(literal)
    return held & may_hold(text, words) if words else held


def replace_matches(
    text: Column, pattern: str, template: str, needs: Sequence[str] = (), words: Sequence[str] = ()
) -> Column:
    """``regexp_replace``, tried only on texts that can match: they hold every literal in ``needs`` and
    one of the lower-case ``words``, in any case."""
    return let(text, lambda t: F.when(_holds(t, needs, words), F.regexp_replace(t, pattern, template)).otherwise(t))


# Stands next to matches while a text is rewritten.
_MARK = "\x01"


def rewrite_matches(
    text: Column,
    pattern: str,
    replace: Callable[[Column], Column],
    needs: Sequence[str] = (),
    words: Sequence[str] = (),
) -> Column:
    """Replace each match of ``pattern``, which is never empty, by an expression of that match.

    ``regexp_replace`` knows only fixed templates. Here it sets a mark on both sides of each match, so that one pass
    of the pattern takes the text apart into gaps and matches by turns; the matches are rewritten and all put together
    again. Rows without a match, nearly all of them as a rule, stay one piece. Texts that hold the mark themselves are
    searched twice instead, for the gaps and for the matches. Every match holds all literals in ``needs`` and one of
    the lower-case ``words``, in any case.
    """

    def by_marks(t: Column) -> Column:
        pieces = F.split(F.regexp_replace(t, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
        return F.array_join(F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, replace(piece)).otherwise(piece)), "")

    def by_search(t: Column) -> Column:
        def interleaved(gaps: Column) -> Column:
            tails = F.slice(gaps, F.lit(2), F.size(gaps))
            pieces = F.zip_with(find_all(t, pattern), tails, lambda m, gap: F.concat(replace(m), gap))
            return F.concat(F.element_at(gaps, 1), F.array_join(pieces, ""))

        return let(F.split(t, pattern, -1), interleaved)

    def rewritten(t: Column) -> Column:
        return F.when(t.contains(_MARK), by_search(t)).when(_holds(t, needs, words), by_marks(t)).otherwise(t)

    return let(text, rewritten)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot; empty for dot files and names without one."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def has_suffix(path: Column, suffixes: Sequence[str]) -> Column:
    """Whether the last extension is one of ``suffixes``, from one look at the path."""
    return path.rlike(rf"[^/](?:{'|'.join(s.replace('.', chr(92) + '.') for s in suffixes)})$")
