from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from auditframe.llm import winnowing
from auditframe.llm.queries import op7_winnowing


def by_hand(text, k, window):
    """Every window in turn: its least hash, the rightmost of equal ones."""
    codes = [ord(c) for c in text]
    if not codes:
        return []
    k = min(k, len(codes))
    mask = 2**64 - 1
    hashes = []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * winnowing.BASE + c + 1) & mask
        hashes.append((((h ^ (h >> 32)) * winnowing.MIX) & mask) >> 32)
    span, chosen = min(window, len(hashes)), []
    for i in range(len(hashes) - span + 1):
        least = min(hashes[i : i + span])
        at = max(j for j in range(i, i + span) if hashes[j] == least)
        if not chosen or chosen[-1] != (least, at):
            chosen.append((least, at))
    return chosen


@settings(max_examples=120, deadline=None)
@given(st.text(st.sampled_from("abé\U0001f600 "), max_size=60), st.integers(1, 9), st.integers(1, 8))
def test_against_window_by_window(text, k, window):
    hashes, positions = winnowing.winnow(text, k, window)
    assert list(zip(hashes.tolist(), positions.tolist(), strict=True)) == by_hand(text, k, window)


def test_shared_passages_are_found():
    passage = "a passage that is just long enough"
    one, other = winnowing.winnow("x" * 50 + passage + "y" * 9)[0], winnowing.winnow("other words " + passage + " and more of it")[0]
    assert len(passage) >= winnowing.K + winnowing.WINDOW - 1 and np.intersect1d(one, other).size


def test_query(spark, folder):
    rows = {r["doc_id"]: r for r in op7_winnowing(spark, folder).collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert len(rows) == len(docs)
    for at, (doc, text) in enumerate(docs):
        following = docs[(at + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints = {name: winnowing.winnow(t) for name, t in (("own", text), ("edited", edited), ("next", following))}
        assert r["fingerprint"] == winnowing.digest(*prints["own"]) and r["edited_fingerprint"] == winnowing.digest(*prints["edited"])
        assert r["near_edited"] == winnowing.likeness(prints["own"][0], prints["edited"][0])
        assert r["near_next"] == winnowing.likeness(prints["own"][0], prints["next"][0])


def test_next_with_ties_and_edge_cases(spark, edge, empty):
    rows = winnowing.with_next(edge).collect()
    docs = sorted(((r["doc_id"], r["text"] or "") for r in edge.collect()), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    expected = sorted(((d[0], d[1], docs[(i + 1) % len(docs)][1]) for i, d in enumerate(docs)), key=str)
    assert sorted(map(tuple, rows), key=str) == expected
    assert winnowing.with_next(empty).count() == 0
    alone = spark.createDataFrame([(7, "abc")], "doc_id long, text string")
    assert [tuple(r) for r in winnowing.with_next(alone).collect()] == [(7, "abc", "abc")]


def test_ranges_count_the_cuts(spark):
    from pyspark.sql import functions as F

    cuts = [-5, 0, 3, 4, 9, 10, 11, 40]
    df = spark.range(-8, 45).select(F.col("id"), winnowing.range_of(F.col("id"), cuts).alias("n"))
    assert all(r["n"] == sum(c <= r["id"] for c in cuts) for r in df.collect())


def test_spans_are_kept(spark):
    df = spark.createDataFrame([(1, "some words " * 9, None)], "doc_id long, text string, other string")
    r = winnowing.fingerprints(df, ("text", "other"), (("text", "other"),), ("doc_id",)).first()
    hashes, positions = winnowing.winnow("some words " * 9)
    assert (r["hashes_text"], r["positions_text"]) == (hashes.tolist(), positions.tolist())
    assert r["hashes_other"] == [] and r["likeness_text_other"] == 0.0
