from __future__ import annotations

import numpy as np
import pytest

from auditframe.llm import language
from auditframe.llm.queries import op3_language_id


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(0)
    words = {"xx": ["zug", "zag", "zot"], "yy": ["lala", "lelo", "mimo"], "zz": ["été", "où", "ça"]}
    pairs = [(" ".join(rng.choice(words[lang], 20)), lang) for lang in words for _ in range(60)]
    return language.train([p[0] for p in pairs], [p[1] for p in pairs], steps=60)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    shapes = {"table": (2, 9, 256), "loop": (2, 3, 9), "out": (6, 3), "bias": (3,)}
    net = language.Network(list("abc"), **{n: rng.normal(size=s).astype(np.float32) for n, s in shapes.items()})
    rows, sizes, goal = rng.integers(0, 5, (4, 6)).astype(np.uint8), np.array([6, 6, 3, 5]), np.array([0, 1, 2, 0])

    def loss():
        codes = np.ascontiguousarray(rows.T).astype(np.intp)
        p = language.probabilities(net, language.states(net, codes, sizes, 0), language.states(net, codes, sizes, 1))
        return -(np.log(p[goal, :, np.arange(4)].T) * (np.arange(6)[:, None] < sizes)).sum() / sizes.sum()

    found = language.gradients(net, rows, sizes, goal)
    for name in shapes:
        weights = getattr(net, name)
        for at in np.argsort(-np.abs(found[name]).ravel())[:3]:
            at = np.unravel_index(at, weights.shape)
            old, step = weights[at], 1e-2
            weights[at] = old + step
            high = loss()
            weights[at] = old - step
            low = loss()
            weights[at] = old
            assert abs((high - low) / (2 * step) - found[name][at]) < 2e-3


def test_labels_against_one_position_at_a_time(net):
    """The network by its definition, byte by byte."""
    soft = lambda x: x / (1 + np.abs(x))
    raw = "zug été lala".encode()

    def run(d):
        h, out, k = np.zeros(net.loop.shape[1]), {}, net.loop.shape[1]
        for t in range(len(raw)) if d == 0 else reversed(range(len(raw))):
            x, u = net.table[d][:, raw[t]], h @ net.loop[d]
            z, r = (soft(x[: 2 * k] + u[: 2 * k]) + 1)[:k] / 2, (soft(x[: 2 * k] + u[: 2 * k]) + 1)[k:] / 2
            c = soft(x[2 * k :] + r * u[2 * k :])
            h = out[t] = z * h + (1 - z) * c
        return out

    forward, backward = run(0), run(1)
    scores = [np.concatenate([forward[t], backward[t]]) @ net.out + net.bias for t in range(len(raw))]
    expected = sum(np.exp(s - s.max()) / np.exp(s - s.max()).sum() for s in scores)
    rows, sizes = language.segments(raw)
    assert np.allclose(language.label(net, rows, sizes)[0], expected, atol=1e-3)


def test_edge_cases(net, spark, edge, empty):
    found = language.identify(edge, net)
    assert found.columns == [c for c in edge.columns if c != "score"] + ["lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 6)) and by[8]["lang_pred"] == "zz"
    assert language.identify(empty, net).count() == 0
    assert {r["lang_pred"] for r in language.identify(edge, language.learn(empty)).collect()} == {"und"}
    one = language.learn(edge.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language.identify(edge, one).collect()} == {"en", "und"}


def test_whole_texts_are_read(net, spark):
    """A text whose language shows only beyond its first half is labelled by the larger part."""
    text = "zug " * 200 + "été où ça " * 2000
    df = spark.createDataFrame([(1, text), (2, "zug " * 40_000)], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, net).collect()}
    assert found == {1: "zz", 2: "xx"}


def test_held_out_accuracy(spark):
    rows = op3_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = rows[rows["held_out"]].merge(truth, on="doc_id")
    assert 100 < len(held) < 300 and (held["lang"] == held["lang_pred"]).mean() > 0.95
