"""The set join against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from auditframe.llm import set_join
from auditframe.llm.sets import common


def shingle_set(text, words=3):
    found = (text or "").encode().lower().split()
    n = min(words, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()


def brute_force(rows, similarity=90):
    """(doc_id, n, component) of (doc_id, text): all pairs of rows."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            linked = both and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both)
            # Rows of one id are one document.
            if linked or (rows[i][0] == rows[j][0] and sets[i] and sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), own), own)
    return sorted(((own, len(sets[i]), least.get(root(i), own) if sets[i] and own is not None else own) for i, (own, _) in enumerate(rows)), key=repr)


def measured(docs, **options):
    return sorted((tuple(r) for r in set_join.linked_sets(docs, **options).collect()), key=repr)


def text_of(rng, n, vocabulary=4000):
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"e{rng.randrange(300)}"
        elif kind == 1:
            out.insert(at, f"e{rng.randrange(300)}")
        elif len(out) > 1:
            del out[at]
    return out


def test_families_of_near_copies(spark, documents):
    rng = random.Random(11)
    rows = []
    for _ in range(12):
        base = text_of(rng, rng.choice([9, 12, 30, 80, 150, 300]))
        chain = base
        for _ in range(12):
            chain = edited(rng, chain, rng.choice([0, 1, 1, 2]))
            rows.append(" ".join(chain))
            rows.append(" ".join(edited(rng, base, rng.randrange(6))).upper())
    rows += [" ".join(text_of(rng, 60)) for _ in range(40)]
    # A passage that many otherwise different texts share.
    passage = text_of(rng, 40)
    rows += [" ".join(passage + text_of(rng, rng.randrange(1, 30))) for _ in range(60)]
    table = [(i * 7 % 1009, text) for i, text in enumerate(rows)]
    rng.shuffle(table)
    got = measured(documents([(i, t, "en", "s") for i, t in table]).repartition(6))
    assert got == brute_force(table)


def test_one_hot_family(spark, documents):
    """Many near copies of one text, most of them linked only through others."""
    rng = random.Random(5)
    base = text_of(rng, 120)
    table = [(i, " ".join(edited(rng, base, rng.randrange(5)))) for i in range(250)]
    assert measured(documents([(i, t, "en", "s") for i, t in table])) == brute_force(table)


def test_edge_cases(spark, edge):
    plain = [(r.doc_id, r.text) for r in edge.collect()]
    assert measured(edge) == brute_force(plain)


def test_rows_of_one_id_are_one_document_in_every_order(spark, documents):
    a, b = ([f"{c}{i}" for i in range(40)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (4, " ".join(a[:20]))]
    expected = {1: 1, 2: 1, 3: 1, 4: 4}
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        assert {i: c for i, _, c in measured(documents([(i, t, "en", "s") for i, t in order]))} == expected


def test_empty_table(spark, empty):
    assert measured(empty) == []
    assert set_join.linked_sets(empty).columns == ["doc_id", "n_shingles", "component_id"]


def test_answers_follow_from_differences_to_a_leader(spark):
    rng = np.random.default_rng(2)
    leader = np.unique(rng.integers(0, 2**63, 200, np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(leader, 180, False), rng.integers(0, 40, 8, np.uint64)])) for _ in range(6)]
    rows = [(i, 0, bytearray(x.tobytes()), len(x)) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "class long, leader long, own binary, n long").withColumn("led", F.lit(bytearray(leader.tobytes())))
    answers = df.select("class", "leader", F.lit(len(leader)).alias("n_leader"), set_join.differences("led", "own").alias("d"))
    answers = answers.select("class", "leader", "n_leader", "d.minus", "d.plus")
    x, y = (df.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("own").alias(f"own_{c}")) for c in "xy")
    pairs = x.join(y, F.col("x") < F.col("y"))
    direct = pairs.withColumn("overlap", common("own_x", "own_y")).select("x", "y", "overlap").collect()
    assert sorted(map(tuple, direct)) == sorted((r.x, r.y, r.overlap) for r in set_join.derived(pairs.select("x", "y", "n_x", "n_y"), answers).collect())
