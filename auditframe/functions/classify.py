"""Row-level classifiers: languages, ranks, commit categories, claim scores, log projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe.functions import fixed_values as fixed
from auditframe.functions.text import (
    ANY_CASE,
    ENDS_WORD,
    STARTS_WORD,
    basename,
    has_suffix,
    lines,
    strip,
    suffix,
)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


# --- files ----------------------------------------------------------------------------------------


def language(path: Column) -> Column:
    """Language of a file by its extension, NULL if unknown."""
    return _lookup(F.lower(suffix(path)), fixed.LANGUAGE_BY_SUFFIX)


def report_language(path: Column) -> Column:
    """The coarser grouping used in reports; extensions are taken as written."""
    by_suffix = {s: name for name, suffixes in fixed.REPORT_LANGUAGE_SUFFIXES.items() for s in suffixes}
    return _lookup(suffix(path), by_suffix)


def in_excluded_directory(path: Column, caller: str) -> Column:
    """True if a whole part of the path, the file name included, is on the caller's exclusion list."""
    excluded = F.array(*[F.lit(part) for part in fixed.EXCLUDED_PARTS[caller]])
    return F.arrays_overlap(F.split(path, "/"), excluded)


def is_documentation(path: Column) -> Column:
    """Documentation by name or extension in the root, or a direct child of a documentation directory."""
    by_name = f"^(?:{'|'.join(fixed.DOC_NAMES_AT_ROOT)})[^/]*$"
    by_suffix = rf"^[^/]*\.(?:{'|'.join(fixed.DOC_SUFFIXES_AT_ROOT)})$"
    by_directory = f"(?:^|/)(?:{'|'.join(fixed.DOC_DIRECTORIES)})/[^/]+$"
    return path.rlike(f"{by_name}|{by_suffix}|{by_directory}") & ~has_suffix(path, fixed.NOT_DOC_SUFFIXES)


def is_correlated_code(path: Column) -> Column:
    return has_suffix(path, fixed.CORRELATED_SUFFIXES)


def glob_pattern(glob: str) -> str:
    """A glob over path parts as a pattern."""
    return "[^/]*".join(f"\\Q{piece}\\E" if piece else "" for piece in glob.split("*"))


def is_key_file(path: Column) -> Column:
    """Files whose main committer is reported; one pattern for all globs."""
    return path.rlike(f"(?:^|/)(?:{'|'.join(glob_pattern(g) for g in fixed.KEY_FILE_GLOBS)})$")


def glob_matches(path: Column, glob: str) -> Column:
    """A relative glob, matched from the right on whole path parts, at any depth.

    The usual shapes become plain string comparisons; ``*`` in the middle takes a pattern.
    """
    if "*" not in glob:
        return (path == glob) | path.endswith("/" + glob)
    if glob.startswith("*") and "*" not in glob[1:] and "/" not in glob:
        tail = glob[1:]
        return basename(path).endswith(tail)
    if glob.endswith("*") and "*" not in glob[:-1] and "/" not in glob:
        return basename(path).startswith(glob[:-1])
    return path.rlike(f"(?:^|/){glob_pattern(glob)}$")


def complexity_rank(complexity: Column) -> Column:
    *bounded, (last, _, _) = fixed.COMPLEXITY_BINS
    rank = F.when(complexity.isNull(), F.lit(None).cast("string"))
    for letter, _, upper in bounded:
        rank = rank.when(complexity <= upper, letter)
    return rank.otherwise(last)


# --- lines of a file ------------------------------------------------------------------------------


def _file_lines(text: Column) -> Column:
    """Lines as a reader yields them: a final line feed opens no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        lines(F.regexp_replace(text, r"\n\z", ""))
    )


def physical_lines(text: Column) -> Column:
    return F.size(_file_lines(text))


def code_lines(text: Column, comment_marker: str | None = None) -> Column:
    """Non-blank lines, without those that start with the comment marker if one is given."""

    def counts(line: Column) -> Column:
        bare = strip(line)
        kept = bare != ""
        return kept & ~bare.startswith(comment_marker) if comment_marker else kept

    return F.size(F.filter(_file_lines(text), counts))


def blank_lines(text: Column) -> Column:
    return F.size(F.filter(_file_lines(text), lambda line: strip(line) == ""))


def comment_lines(text: Column, comment_marker: str = "#") -> Column:
    return F.size(F.filter(_file_lines(text), lambda line: strip(line).startswith(comment_marker)))


def line_counts(path: Column, text: Column) -> Column:
    """Line counts of a source file by the rule of its language, NULL for other files.

    Python files get all counts; for the others only the lines that count as code are known.
    """
    name = language(path)
    python = name == "Python"
    loc = (
        F.when(python, physical_lines(text))
        .when(name.isin("JavaScript", "TypeScript"), code_lines(text))
        .when(name.isin("Go", "Java"), code_lines(text, "//"))
    )
    counts = F.struct(
        name.alias("language"),
        loc.alias("loc"),
        F.when(python, comment_lines(text)).alias("comments"),
        F.when(python, blank_lines(text)).alias("blank"),
    )
    return F.when(name.isin("Python", "JavaScript", "TypeScript", "Go", "Java"), counts)


def is_under_commented(comments: Column, sloc: Column) -> Column:
    """Fewer than one comment line in ten source lines; rows without counts are flagged."""
    return F.coalesce(comments, F.lit(0)) < F.coalesce(sloc, F.lit(1)) * F.lit(0.1)


# --- commits and tags -----------------------------------------------------------------------------


def commit_categories(subject: Column) -> dict[str, Column]:
    """Six independent flags; one commit may carry several."""
    message = F.lower(subject)
    flags = {}
    for name, words in fixed.COMMIT_CATEGORY_WORDS.items():
        pattern = f"{STARTS_WORD}(?:{'|'.join(words)}){ENDS_WORD}"
        if name == "breaking_changes":
            pattern += f"|{fixed.BREAKING_MARK}"
        flags[name] = message.rlike(pattern)
    return flags


def is_feature_commit(message: Column) -> Column:
    """Any-case substring match, so that "address" counts as well as "add"."""
    return message.rlike(f"(?i)(?:{'|'.join(fixed.FEATURE_COMMIT_PARTS)})")


def is_semver(tag: Column) -> Column:
    return tag.rlike(fixed.SEMVER)


# --- claims ---------------------------------------------------------------------------------------


def verification_method(claim_type: Column) -> Column:
    return _lookup(claim_type, {kind: method for kind, (method, _) in fixed.VERIFICATION_METHODS.items()})


def is_verifiable(claim_type: Column, related: Column) -> Column:
    """``related`` is the number of related code files; some types need at least one."""
    always = [kind for kind, (_, verifiable) in fixed.VERIFICATION_METHODS.items() if verifiable]
    return claim_type.isin(always) | (F.coalesce(related, F.lit(0)) > 0)


def claim_confidence(text: Column, claim_type: Column) -> Column:
    """0.5, moved by certain and hedging words, digits and the claim's type, within 0 and 1.

    The words are looked for as substrings, hence "mayor" hedges. The sums are taken in one fixed order
    so that equal claims get bit-equal scores.
    """
    lowered = F.lower(text)
    sure = any_of([lowered.contains(word) for word in fixed.CERTAIN_WORDS])
    hedged = any_of([lowered.contains(word) for word in fixed.HEDGING_WORDS])
    zero = F.lit(0.0)
    score = (
        F.lit(0.5)
        + F.when(sure, F.lit(0.2)).otherwise(zero)
        - F.when(hedged, F.lit(0.2)).otherwise(zero)
        + F.when(text.rlike(r"\p{Nd}"), F.lit(0.1)).otherwise(zero)
        + F.when(claim_type == "api", F.lit(0.1)).when(claim_type == "performance", F.lit(0.05)).otherwise(zero)
    )
    return F.least(F.greatest(score, zero), F.lit(1.0))


# --- findings, logs, gates ------------------------------------------------------------------------


def is_severe(severity: Column) -> Column:
    return F.upper(severity).isin("HIGH", "MEDIUM")


def kept_log(text: Column) -> Column:
    """The end of a log."""
    return F.right(text, F.lit(fixed.KEPT_LOG_CHARACTERS))


def process_status(tool: Column, exit_code: Column, stdout: Column, stderr: Column) -> Column:
    """What a checker's exit says: by exit code, or by a marker in its output."""
    verified = (
        F.when(tool == "cbmc", stdout.contains("VERIFICATION SUCCESSFUL"))
        .when(tool == "miri", F.lit(None).cast("boolean"))
        .otherwise(exit_code == 0)
    )
    undefined_behaviour = F.when(tool == "miri", F.lower(stderr).contains("undefined behavior"))
    return F.struct(verified.alias("verified"), undefined_behaviour.alias("ub_detected"))


def warning_lines(stdout: Column) -> Column:
    """Trimmed lines that hold a warning or an error."""
    hits = F.filter(lines(stdout), lambda line: line.contains("warning:") | line.contains("error:"))
    return F.transform(hits, strip)


def gate_status(failed_tests: Column, failed_claims: Column) -> Column:
    """Exit status of an audit: 1 for failed tests, else 2 for failed claims, else 0."""
    return (
        F.when(F.coalesce(failed_tests, F.lit(0)) > 0, 1)
        .when(F.coalesce(failed_claims, F.lit(0)) > 0, 2)
        .otherwise(0)
    )


def any_case(pattern: str) -> str:
    return ANY_CASE + pattern
