from __future__ import annotations

import numpy as np
import pandas as pd

from auditframe.llm import weak_labels
from auditframe.llm.queries import op8_quality


def test_accuracies_are_recovered():
    """Votes drawn from known accuracies: which labellers are good, and which documents, is found again."""
    rng = np.random.default_rng(1)
    n, right = 20_000, np.array([0.95, 0.9, 0.65, 0.8, 0.75, 0.9, 0.7, 0.85, 0.9, 0.8])
    good = rng.random(n) < 0.7
    correct = rng.random((n, len(right))) < right
    votes = np.where(correct == good[:, None], weak_labels.GOOD, weak_labels.BAD)
    votes[rng.random(votes.shape) < 0.3] = weak_labels.ABSTAIN
    keys, counts = np.unique(votes @ 3 ** np.arange(len(right)), return_counts=True)
    posterior, found = weak_labels.accuracies(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert np.abs(found - right).max() < 0.03
    sure = np.array([posterior[k] for k in (votes @ 3 ** np.arange(len(right))).tolist()])
    assert ((sure >= 0.5) == good).mean() > 0.95
    assert weak_labels.accuracies({})[0] == {}


def test_scorer_learns_and_uses_whole_texts():
    good = [f"the cat number {i} sat on the mat. it was fine." for i in range(40)]
    bad = [f"buy$$$ now### {i}%%% win&&&" for i in range(40)]
    goals = np.r_[np.ones(40), np.zeros(40)]
    scorer = weak_labels.fit([weak_labels.hashed(t) for t in good + bad], goals)
    known = weak_labels.Known(scorer.weights)
    scores = scorer(pd.Series(good + bad), known)
    assert scores[:40].min() > 0.8 and scores[40:].max() < 0.2
    assert scorer(pd.Series([good[0] + " win$$$ now###" * 500]), known)[0] < 0.5
    at, share = weak_labels.hashed(good[0])
    direct = share @ scorer.weights[at] + scorer.bias
    assert np.isclose(scorer(pd.Series(good[:1]), known)[0], 1 / (1 + np.exp(-direct)))


def test_measures():
    odd, again, ends, letters, upper, length, lines, digits = weak_labels.measures("Ab ab ab. 12 $$\nx\nx")
    assert np.isclose(again, 1 / 7) and np.isclose(ends, 1 / 7) and np.isclose(lines, 1 / 3)
    assert np.isclose(odd, 2 / 13) and np.isclose(letters, 8 / 13) and np.isclose(digits, 2 / 13) and np.isclose(upper, 1 / 8) and np.isclose(length, 13 / 7)
    assert weak_labels.measures("") == weak_labels.measures(" \n") == (0.0,) * 8


def test_edge_cases(spark, edge, empty):
    found = weak_labels.quality(edge)
    assert found.columns == [c for c in edge.columns if c not in ("kept", "score")] + ["posterior", "score", "kept"]
    rows = found.collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert weak_labels.quality(empty).count() == 0


def test_query_against_labels(spark):
    """The labels take no part in the fit; they only show whether it was any good."""
    folder = "/root/testdata/sf0.01"
    rows = op8_quality(spark, folder).toPandas()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    known = spark.read.parquet(f"{folder}/labels.parquet").toPandas().merge(rows, on="doc_id")
    assert known[known["quality"] == 1]["kept"].mean() > 0.98
    assert (~known[known["quality"] == 0]["kept"]).mean() > 0.6


def slow_votes(text: str | None) -> list[int]:
    """Votes on one document, character by character."""
    text = text or ""
    words, values = text.split(), dict.fromkeys(weak_labels.MEASURES, 0.0)
    if words:
        spaces = "\t\n\v\f\r "
        visible = [c for c in text if c not in spaces]
        letters = [c for c in visible if (c.isascii() and c.isalpha()) or ord(c) >= 0xC0]
        digits = [c for c in visible if c in "0123456789"]
        plain = [c for c in visible if c in ".,;:!?'\"()-" or 0x80 <= ord(c) < 0xC0]
        filled = [line for line in text.split("\n") if line != ""]
        seen = max(1, len(visible))
        values = {
            "odd": (seen - len(letters) - len(digits) - len(plain)) / seen,
            "again": sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / len(words),
            "ends": sum(1 for a, b in zip(text, text[1:] + " ", strict=True) if a in ".!?" and b in spaces) / len(words),
            "letters": len(letters) / seen,
            "upper": sum(1 for c in letters if "A" <= c <= "Z") / max(1, len(letters)),
            "length": len(visible) / len(words),
            "lines": 1 - len(set(filled)) / max(1, len(filled)),
            "digits": len(digits) / seen,
        }
    votes = []
    for name, (low, high) in weak_labels.FAULTS.items():
        votes.append(weak_labels.ABSTAIN if low <= values[name] <= high else weak_labels.BAD)
    for ranges in weak_labels.VIRTUES.values():
        inside = all(low <= values[name] <= high for name, (low, high) in ranges.items())
        votes.append(weak_labels.GOOD if inside else weak_labels.ABSTAIN)
    return votes


def slow_posteriors(votes: list[list[int]]) -> list[float]:
    """Expectation-maximisation document by document, without patterns or counts."""
    labellers = range(len(weak_labels.LABELLERS))
    right, prior, good = [0.9 for _ in labellers], 0.5, []
    for _ in range(weak_labels.ROUNDS):
        good = []
        for row in votes:
            yes, no = prior, 1 - prior
            for i in labellers:
                if row[i] != weak_labels.ABSTAIN:
                    yes *= right[i] if row[i] == weak_labels.GOOD else 1 - right[i]
                    no *= right[i] if row[i] == weak_labels.BAD else 1 - right[i]
            good.append(yes / (yes + no))
        for i in labellers:
            cast = [(row[i], g) for row, g in zip(votes, good, strict=True) if row[i] != weak_labels.ABSTAIN]
            correct = sum(g if v == weak_labels.GOOD else 1 - g for v, g in cast)
            right[i] = min(0.999, max(0.6, (correct + 0.9) / (len(cast) + 1.0)))
        prior = min(0.95, max(0.05, sum(good) / len(good)))
    return good


def test_against_brute_force(spark):
    """All documents of a small table: the posterior of each equals that of a loop over the documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(1).selectExpr("-1L as doc_id", "* except (doc_id, text)", "string(null) as text"), allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    wanted = dict(zip([r["doc_id"] for r in rows], slow_posteriors([slow_votes(r["text"]) for r in rows]), strict=True))
    found = {r["doc_id"]: r["posterior"] for r in weak_labels.quality(docs).collect()}
    assert found.keys() == wanted.keys()
    assert max(abs(found[k] - wanted[k]) for k in wanted) < 1e-6


def test_scorer_against_brute_force():
    """Each score is the mean of the fitted weights over the words of the whole text, taken one by one."""
    texts = ["Some words here. AGAIN again 12!", "x" * 5_000, "a b a b b b", "ÄÖ ünï 中文 ...", "", None]
    scorer = weak_labels.fit([weak_labels.hashed(t or "") for t in texts], np.array([1.0, 0.0, 0.0, 1.0, 0.0, 0.0]))
    scores = scorer(pd.Series(texts), weak_labels.Known(scorer.weights))
    for text, score in zip(texts, scores, strict=True):
        words, total = (text or "").split(), 0.0
        for before, word in zip([None, *words], words, strict=False):
            total += sum(scorer.weights[b] for b in weak_labels.buckets(word))
            total += scorer.weights[weak_labels.AGAIN] if word == before else 0.0
        direct = scorer.bias + weak_labels.SCALE * total / max(1, len(words))
        assert np.isclose(score, 1 / (1 + np.exp(-direct)), atol=1e-9)
