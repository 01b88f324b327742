from __future__ import annotations

from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditframe.llm import mixing
from auditframe.llm.queries import op5_mixing


def best_by_hand(lengths, counts, budget):
    sums = {sum(n * x for n, x in zip(c, lengths, strict=True)) for c in product(*[range(k + 1) for k in counts])}
    return min(sums, key=lambda s: (abs(s - budget), s))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 80))
def test_fit_is_the_best_when_all_is_in_the_window(pairs, budget):
    lengths, counts = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    take = mixing.fit(lengths, counts, budget)
    assert np.all(take >= 0) and np.all(take <= counts)
    reached = int((take * lengths).sum())
    # The proportional part is fixed before the knapsack; what remains is solved exactly.
    total = int((lengths * counts).sum())
    start = np.array([int(c) * min(budget, total) // total if total else 0 for c in counts])
    start[lengths == 0] = 0
    rest = min(budget, total) - int((start * lengths).sum())
    assert reached == int((start * lengths).sum()) + (best_by_hand(lengths.tolist(), (counts - start).tolist(), rest) if rest > 0 else 0)


def test_fit_with_a_small_window_and_large_counts():
    lengths, counts = np.array([7, 113, 1009, 20_011]), np.array([10**9, 10**8, 10**7, 10**6])
    budget = int((lengths * counts).sum()) * 3 // 7
    take = mixing.fit(lengths, counts, budget, window=4096)
    assert np.all(take <= counts) and abs(budget - int((take * lengths).sum())) <= 7


def level_by_hand(sizes, weights, share, most):
    """Deal the budget by weight again and again until no target is above its limit."""
    budget = share * sum(sizes)
    target, fixed = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        open_ = [i for i, f in enumerate(fixed) if not f]
        rest = budget - sum(target[i] for i, f in enumerate(fixed) if f)
        over = False
        for i in open_:
            target[i] = rest * weights[i] / sum(weights[j] for j in open_)
        for i in open_:
            if target[i] > most * sizes[i] + 1e-9:
                target[i], fixed[i], over = float(most * sizes[i]), True, True
        if not over:
            return target


def test_targets_against_repeated_dealing(spark):
    rng = np.random.default_rng(5)
    for _ in range(4):
        sizes = [int(x) for x in rng.integers(0, 1000, 8)] + [9000]
        names = [f"s{i}" for i in range(8)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        expected = level_by_hand(sizes, [(5, 2, 1)[i % 3] for i in range(9)], 1.5, 2)
        assert np.allclose([found[n] for n in names], expected)


def test_query(spark, folder):
    rows = op5_mixing(spark, folder).toPandas()
    again = op5_mixing(spark, folder).toPandas()
    key = ["doc_id"]
    assert rows.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert (rows["taken"] <= 2 * rows["size"]).all()
    for _, part in rows.groupby("source", dropna=False):
        assert part["size"].sum() == part["source_size"].iloc[0]
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= max(2, part["size"].min(), part["target"].iloc[0] / 500)


def test_edge_cases(spark, edge, empty):
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    found = mixing.mix(edge, size)
    assert found.columns == [c for c in edge.columns if c not in ("size", "copies")] + ["size", "source_size", "target", "copies"]
    rows = found.collect()
    assert len(rows) == edge.count() and all(0 <= r["copies"] <= 2 for r in rows)
    assert {r["source"]: r["source_size"] for r in rows} == {"a": 40_032, "b": 10, "c": 10, None: 1}
    assert mixing.mix(empty, size).count() == 0
