from __future__ import annotations

import numpy as np
import pytest

from auditframe.llm import attribution
from auditframe.llm.common import default_tokenizer, tokenizer
from auditframe.llm.queries import op1_token_attribution


def by_hand(text: str, sections: list[tuple[int, int]], rule: str) -> list[float]:
    encoding = tokenizer(default_tokenizer())
    raw, at, spans = text.encode(), 0, []
    sizes = encoding.token_bytes()
    for token in encoding.ids(text):
        n = sizes[token]
        spans.append((at, at + n))
        at += n
    assert at == len(raw)
    out = []
    for start, end in sections:
        low, high = len(text[:start].encode()), len(text[:end].encode())
        if rule == "first":
            out.append(sum(low <= s < high for s, _ in spans))
        elif rule == "middle":
            out.append(sum(2 * low < s + e <= 2 * high for s, e in spans))
        else:
            out.append(sum(max(0, min(e, high) - max(s, low)) / (e - s) for s, e in spans))
    return out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_against_token_by_token(spark, rule):
    text = "Hello wonderful world, où est l'été?\n\U0001f600\U0001f600 done   \n\nend"
    sections = [(0, 7), (7, 20), (20, 38), (38, 41), (30, 50)]
    rows = [(1, text, [{"name": str(i), "start": s, "end": e} for i, (s, e) in enumerate(sections)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<name:string,start:long,end:long>>")
    found = sorted((r for r in attribution.attribute(df, rule=rule).collect() if r["section"] is not None), key=lambda r: r["section"])
    assert np.allclose([r["tokens"] for r in found], by_hand(text, sections, rule))


@pytest.mark.parametrize("rule", attribution.RULES)
def test_lines_add_up(spark, edge, rule):
    rows = attribution.attribute(attribution.line_sections(edge), rule=rule).toPandas()
    assert set(rows["doc_id"].dropna()) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    sums = rows.groupby("doc_id").agg(tokens=("tokens", "sum"), total=("doc_tokens", "first"))
    sums = sums.drop(index=2)  # a repeated row counts twice
    assert np.allclose(sums["tokens"], sums["total"])
    assert rows[rows["doc_id"] == 3]["tokens"].tolist() == [0.0]


def test_gaps_fields_and_bad_borders(spark, empty):
    df = spark.createDataFrame([(1, "alpha beta", None), (2, None, "x")], "k long, a string, b string")
    rows = {(r["doc_id"], r["section"]): r for r in attribution.attribute(attribution.field_sections(df, ["a", "b"], "k")).collect()}
    assert rows[1, 0]["tokens"] == 2 and rows[1, 1]["tokens"] == 0 and rows[1, None]["tokens"] == 1
    assert rows[2, 1]["name"] == "b" and rows[2, 1]["tokens"] == 1
    odd = spark.createDataFrame([(1, "alpha", [("x", -5, 99), ("y", 4, 2), ("z", None, None)])], "doc_id long, text string, sections array<struct<name:string,start:long,end:long>>")
    found = {r["name"]: (r["start"], r["end"]) for r in attribution.attribute(odd).collect()}
    assert found == {"x": (0, 5), "y": (4, 4), "z": (0, 5)}
    assert attribution.attribute(attribution.line_sections(empty)).count() == 0


def test_query_covers_all_documents(spark, folder):
    rows = op1_token_attribution(spark, folder)
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{folder}/documents.parquet").count()
