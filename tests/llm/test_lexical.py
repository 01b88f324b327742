"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from auditframe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def found_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_force(docs, items, k=10):
    """(item, rank, doc_id, score) by the definition; docs and items are (id, text)."""
    counted = [(i, Counter(found_terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, length = len(counted), sum(x for *_, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(found_terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c, own in counted:
            m = 100 - 90 + (90 * own * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i, score))
        out += [(item, rank, i, score) for rank, (*_, i, score) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def measured(docs, items, **options):
    return sorted((tuple(r) for r in lexical.search(docs, items, **options).collect()), key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_terms():
    text = "Über-Straße 9x_Z ÄÖ\n\tA1`b{c}~d\x7fe f"
    assert [t.decode() for t in lexical.terms(text)] == found_terms(text)


def test_random_texts(spark, documents, monkeypatch):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40))), "en", "s") for i in range(400)]
    # Ties in score across documents, and one word that nearly all hold.
    rows += [(1000 + i, "w3 w50 W0", "en", "s") for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    expected = brute_force([(i, t) for i, t, *_ in rows], items)
    assert measured(documents(rows), items_of(spark, items)) == expected
    assert measured(documents(rows).repartition(9), items_of(spark, items), block_terms=5) == expected


def test_edge_cases(spark, edge):
    plain = [(r.doc_id, r.text) for r in edge.collect()]
    items = [(1, "one TWO long"), (2, None), (3, ""), (4, "nowhere"), (5, "word"), (5, "ten word"), (None, "é three"), (6, "one two " * 5000)]
    assert measured(edge, items_of(spark, items)) == brute_force(plain, items)


def test_empty_tables(spark, edge, empty):
    assert measured(empty, items_of(spark, [(1, "one")])) == []
    assert measured(edge, items_of(spark, [])) == []
    assert lexical.search(edge, items_of(spark, [])).columns == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_stop_without_changing_the_best():
    """Frequent lists only add to what rarer ones created, and create nothing once they cannot matter."""
    rng = np.random.default_rng(3)
    size, k = 5000, 10
    lists = [(np.sort(rng.choice(size, n, False)), g) for n, g in ((12, 900), (40, 700), (3000, 50), (4500, 3))]
    numbers = np.repeat(np.arange(4), [len(d) for d, _ in lists])
    docs = np.concatenate([d for d, _ in lists])
    gains = np.concatenate([np.full(len(d), g) - rng.integers(0, 3, len(d)) for d, g in lists])
    postings = lexical.Postings(numbers, docs, gains)
    total, full = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(full, docs, gains)
    may = lexical.accumulate(postings, np.arange(4), total, k, 0)
    assert len(may) < 60
    assert set(np.flatnonzero(full >= lexical.kth(full, k))) <= set(may)
    assert (total[may] == full[may]).all()
