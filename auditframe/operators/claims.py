"""Claims, references and code examples in documentation, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import documents
from auditframe.functions.classify import claim_confidence
from auditframe.functions.text import strip, suffix
from auditframe.operators.facts import fact
from auditframe.operators.grouping import By
from auditframe.sources.files import documentation_files

REPO = ("repo_id",)


def document_units(files: DataFrame, by: By = REPO) -> DataFrame:
    """Units of documentation files, each by the rule of its type, in one pass over the texts."""
    units = documents.document_units(F.col("path"), F.col("text"))
    return documentation_files(files).select(*by, "path", F.inline(units))


def docstrings(files: DataFrame, by: By = REPO) -> DataFrame:
    python = files.filter(suffix(F.col("path")) == ".py")
    return python.select(*by, "path", F.inline(documents.docstring_units(F.col("text"))))


def extract_claims(units: DataFrame, text: str = "text") -> DataFrame:
    """One row per claim; a unit may hold many, of several types. No shuffle."""
    kept = [c for c in units.columns if c != text]
    found = units.select(*kept, F.inline(documents.claims_in(F.col(text))))
    return found.select(
        *kept,
        "claim_type",
        "pattern_no",
        "match_no",
        strip(F.col("raw")).alias("text"),
        claim_confidence(F.col("raw"), F.col("claim_type")).alias("confidence"),
    )


def all_claims(files: DataFrame, by: By = REPO) -> DataFrame:
    """Claims of docstrings, documentation texts and code examples, from one pass over the files."""
    return files.select(*by, "path", F.inline(fact(files, "claims")))


def code_blocks(files: DataFrame, by: By = REPO) -> DataFrame:
    """Bodies of fenced blocks, numbered from 0 within their file."""
    blocks = documents.code_blocks_in(F.col("text"))
    return files.select(*by, "path", F.posexplode(blocks).alias("block_no", "code"))


def code_example_claims(blocks: DataFrame) -> DataFrame:
    """Implicit API claims of code blocks: pattern 0 are function calls, pattern 1 method calls."""
    kept = [c for c in blocks.columns if c != "code"]
    return blocks.select(*kept, F.inline(documents.calls_in(F.col("code"))))


def code_references(files: DataFrame, by: By = REPO) -> DataFrame:
    """Names that documentation puts in back-ticks; a dotted name counts as a call and as a file."""
    return files.select(*by, "path", F.posexplode(fact(files, "references")).alias("ord", "ref"))


def flatten_claims_by_type(grouped: DataFrame, claims: str = "claims_by_type") -> DataFrame:
    """Rows from a map of claim type to a list of claims, each tagged with its type."""
    kept = [c for c in grouped.columns if c != claims]
    lists = grouped.select(*kept, F.explode(claims).alias("claim_type", "__list"))
    return lists.select(*kept, "claim_type", F.inline("__list"))


CLAIM_ORDER = ["path", "source", "section_no", "unit_no", "claim_type", "pattern_no", "match_no"]


def with_claim_id(claims: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A stable identifier from the claim's place in its repository's texts."""
    columns: list[Column] = [F.col(c).cast("string") for c in (order or CLAIM_ORDER) if c in claims.columns]
    return claims.withColumn("claim_id", F.concat_ws(":", *columns))
