from __future__ import annotations

import random

import numpy as np
import pytest

from auditframe.llm import minhash, set_join
from auditframe.llm.sets import components

WORDS = [f"w{i}" for i in range(500)]


def sets(rows, words):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        out[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    return out


def by_hand(rows, words, similarity=80):
    found = sets(rows, words)
    label = {i: i for i in found}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(found)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(found[a] & found[b])
            if found[a] and found[b] and 100 * common >= similarity * len(found[a] | found[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(found[i]), root(i)) for i in ids}


def variants(seed):
    """Copies of copies with few words changed, so that chains of links arise, and unrelated texts."""
    rng, rows, i = random.Random(seed), [], 0
    for _ in range(8):
        text = rng.choices(WORDS, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 12)):
            rows.append((i, " ".join(text)))
            i += 1
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "words"), [(1, 2), (2, 5)])
def test_against_all_pairs(spark, seed, words):
    rows = variants(seed)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == by_hand(rows, words)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_members_of_a_bucket_beyond_the_centre(spark, monkeypatch):
    """Without rounds of stars all pairs of different components are compared."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    rows = variants(3)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == by_hand(rows, 2)


def test_edge_cases(spark, edge, empty):
    found = minhash.near_duplicates(edge, words=2).collect()
    assert len(found) == edge.count()
    by = {r["doc_id"]: r for r in found}
    assert by[9]["component_id"] == 1 and by[2]["component_id"] == 1 and by[1]["kept"]
    for i in (3, 4, 6):
        assert by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"]
    assert by[5]["n_shingles"] == 1 and by[7]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}}


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = minhash.coefficients(512)
    keys = rng.integers(0, 2**64, 1200, np.uint64)
    one, other = minhash.signature(keys[:1000], a, b), minhash.signature(keys[200:], a, b)
    assert abs((one == other).mean() - 800 / 1200) < 0.08


def test_whole_texts_in_chunks():
    a, b = minhash.coefficients(8)
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64)
    low = (keys >> np.uint64(32)).astype(np.uint32)
    assert minhash.signature(keys, a, b).tolist() == [int((low * x + y).min()) for x, y in zip(a, b, strict=True)]


def test_rows_of_one_id_keep_the_links_of_all_their_texts(spark):
    a, x = ([f"{c}{i}" for i in range(12)] for c in "ax")
    rows = [(1, " ".join(a[:10])), (1, " ".join(x[:8])), (2, " ".join(a[:11])), (3, " ".join(x[1:8]))]
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]], [rows[2], rows[1], rows[3], rows[0]]):
        found = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), words=2).collect()
        assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 1}


def test_a_shared_rare_passage_makes_no_pairs_in_the_square(spark, monkeypatch):
    """Many texts on one template, hardly any linked: the pairs that are left to compare stay few."""
    rng = random.Random(9)
    template = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(template + [f"o{rng.randrange(10**6)}" for _ in range(40)])) for i in range(300)]
    counted, plain = [], set_join.open_pairs

    def counting(*args):
        pairs = plain(*args)
        counted.append(pairs.count())
        return pairs

    monkeypatch.setattr(set_join, "open_pairs", counting)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert all(r.kept for r in found)
    assert sum(counted) <= len(rows)
