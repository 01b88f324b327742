"""Token counts by offset-mapped attribution (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.llm.common import FLUSH_BYTES, default_tokenizer, named, tokenizer

SPAN = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
#: Where a token that crosses a border of sections counts: wholly where its first character lies; wholly where its
#: middle lies, at a tie the earlier side; or on each side by the share of its bytes there.
RULES = ("first", "middle", "share")


@F.pandas_udf(T.ArrayType(SPAN))
def _lines(texts: pd.Series) -> pd.Series:
    def spans(text: str) -> list[dict]:
        out, start = [], 0
        for line in text.split("\n"):
            end = min(start + len(line) + 1, len(text))
            out.append({"name": None, "start": start, "end": end})
            start = end
        return out

    return texts.map(spans)


def line_sections(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text and ``sections``: each line with its line break, as an unnamed span of characters.

    The spans cover the text without gaps, ends are exclusive. A null or empty text has one empty line.
    """
    text = F.coalesce(named(text_column).cast("string"), F.lit(""))
    return docs.select(named(id_column).cast("long").alias("doc_id"), text.alias("text")).withColumn("sections", _lines("text"))


def field_sections(df: DataFrame, fields: Sequence[str], id_column: str, separator: str = "\n") -> DataFrame:
    """doc_id, text and ``sections``: several text fields joined by a separator that belongs to none of them.

    Null fields count as empty; an empty field is an empty section.
    """
    values = [F.coalesce(named(f).cast("string"), F.lit("")) for f in fields]
    spans, start = [], F.lit(0).cast("long")
    for name, value in zip(fields, values, strict=True):
        end = start + F.length(value)
        spans.append(F.struct(F.lit(name).alias("name"), start.alias("start"), end.alias("end")))
        start = end + len(separator)
    return df.select(
        named(id_column).cast("long").alias("doc_id"), F.concat_ws(separator, *values).alias("text"), F.array(*spans).alias("sections")
    )


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray:
    return np.array(tokenizer(path).token_bytes(), np.int64)


def spread(ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Tokens, given by their sorted end bytes, that count to the byte spans from ``low`` to ``high``."""
    starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else ends
    if rule == "first":
        before = lambda x: np.searchsorted(starts, x, side="left")
    elif rule == "middle":
        before = lambda x: np.searchsorted(starts + ends, 2 * x, side="right")
    else:

        def before(x: np.ndarray) -> np.ndarray:
            if not len(ends):
                return np.zeros(len(x))
            whole = np.searchsorted(ends, x, side="right")
            at = np.minimum(whole, len(ends) - 1)
            return whole + np.where(whole < len(ends), (x - starts[at]) / (ends[at] - starts[at]), 0.0)

    return (before(high) - before(low)).astype(np.float64)


def attribute(sectioned: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """Tokens of each section: doc_id, section (from 0), name, start, end, tokens, doc_tokens.

    ``sectioned`` has doc_id, text and ``sections`` (array<struct<name, start, end>>, spans of characters, which
    may leave gaps, nest and overlap). Each whole text is encoded once, as a text cut at its borders would give
    other tokens; the tokens' spans are then joined with those of the sections by sorted search and ``rule``
    (one of RULES) says where tokens on a border count. Tokens in no section of a document whose sections do not
    overlap are reported in a row with section null, if there are any, so that its rows add up to ``doc_tokens``.

    Null texts count as empty; null sections as none; borders outside the text are moved to its ends and a span
    that ends before its start is empty. Repeated rows are documents of their own. Other columns are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_tokenizer()
    names = ["doc_id", "section", "name", "start", "end", "tokens", "doc_tokens"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = tokenizer(path).ids, _token_bytes(path)
        columns: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            out = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            for doc, text, sections in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text, sections = text.as_py() or "", sections.as_py() or []
                raw = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(sizes[np.array(encode(text), np.int64)])
                characters = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]
                limit = len(characters) - 1
                first = np.array([min(max(s["start"] or 0, 0), limit) for s in sections], np.int64)
                last = np.array([limit if s["end"] is None else min(max(s["end"], 0), limit) for s in sections], np.int64)
                last = np.maximum(first, last)
                tokens = spread(ends, characters[first], characters[last], rule)
                disjoint = bool(np.all(np.sort(first)[1:] >= np.sort(last)[:-1]))
                rows = [[doc, i, s["name"], int(first[i]), int(last[i]), tokens[i], len(ends)] for i, s in enumerate(sections)]
                outside = len(ends) - tokens.sum()
                if disjoint and outside > 1e-6:
                    rows.append([doc, None, None, None, None, outside, len(ends)])
                for row in rows:
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                if len(columns[0]) * 64 > FLUSH_BYTES:
                    yield flush()
        yield flush()

    rows = sectioned.select("doc_id", "text", F.col("sections").cast(T.ArrayType(SPAN)).alias("sections"))
    return rows.mapInArrow(run, "doc_id long, section int, name string, start long, end long, tokens double, doc_tokens long")
