"""Everything the audit wants to know of a file's text, from one pass over the texts.

Operators ask for a fact by name. On a table of files it is computed from the text; on a table of facts,
written once by an audit, it is read from its own column, and the texts are not touched again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import classify, code, documents
from auditframe.functions.fixed_values import FEATURE_KEYWORD_LENGTH

_FACTS: dict[str, Callable[[Column, Column], Column]] = {
    "claims": documents.claims_of_file,
    "references": lambda path, text: F.when(classify.is_documentation(path), documents.references_in(text)),
    "symbols": code.symbols_in,
    "security_keywords": lambda path, text: code.security_keywords_in(text),
    "word_pieces": lambda path, text: F.when(
        classify.is_correlated_code(path), code.word_pieces(text, FEATURE_KEYWORD_LENGTH)
    ),
    "secrets": code.secrets_in,
    "lint": code.lint_issues,
    "lines": classify.line_counts,
}

#: What claims are correlated with.
CODE_FACTS = ("symbols", "security_keywords", "word_pieces")


def fact(files: DataFrame, name: str) -> Column:
    if name in files.columns:
        return F.col(name)
    return _FACTS[name](F.col("path"), F.col("text"))


def file_facts(files: DataFrame, names: Sequence[str] = tuple(_FACTS)) -> DataFrame:
    """Facts of all files by name, all of them by default, without the texts."""
    kept = [c for c in files.columns if c != "text"]
    return files.select(*kept, *[fact(files, name).alias(name) for name in names])
