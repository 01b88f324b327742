from __future__ import annotations

from collections import defaultdict

import pytest

from auditframe.llm import radix


def by_hand(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return groups


@pytest.mark.parametrize(("first", "growth"), [(32, 8), (1, 2), (4, 1)])
def test_against_a_dictionary(spark, first, growth):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "abcd" * 9, "abcd" * 9 + "x", "é", "è", None, "a\0", "a\0\0"]
    rows = [(n, texts[(n * n + n // 3) % len(texts)]) for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = radix.groups_of_equals(df, first=first, growth=growth).collect()
    groups = by_hand(rows)
    assert len(found) == len(rows)
    for r in found:
        own = groups[r["text"] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))


def test_edge_cases(spark, edge, empty):
    found = radix.groups_of_equals(edge)
    assert found.columns == [c for c in edge.columns if c != "kept"] + ["keep_id", "group_size", "kept"]
    rows = found.collect()
    assert len(rows) == edge.count()
    same = [r for r in rows if r["group_size"] == 4]
    # Two rows have the largest id; one of them stays. The row without an id is the smallest.
    assert len(same) == 4 and sum(r["kept"] for r in same) == 1 and {r["keep_id"] for r in same} == {2}
    assert sorted(r["doc_id"] for r in rows if r["group_size"] == 2) == [3, 4]
    assert radix.groups_of_equals(empty).count() == 0


def test_only_carried_columns_leave(spark, edge):
    assert radix.groups_of_equals(edge, carry=["doc_id"]).columns == ["doc_id", "keep_id", "group_size", "kept"]


def test_long_common_prefix(spark):
    base = "x" * 50_000
    rows = [(1, base + "a"), (2, base + "b"), (3, base + "a"), (4, base)]
    found = {r["doc_id"]: r["keep_id"] for r in radix.groups_of_equals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 3, 2: 2, 3: 3, 4: 4}
