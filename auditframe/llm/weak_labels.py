"""Quality classifier from weak labels (operator 8)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.llm.common import early, named, seeded, unwrapped, wrapped

#: Votes of a labeller on a document.
BAD, GOOD, ABSTAIN = 0, 1, 2
#: What ``measures`` gives, in this order.
MEASURES = ("odd", "again", "ends", "letters", "upper", "length", "lines", "digits")
#: Labellers that vote bad on what lies outside of a range of their measure and abstain on the rest.
FAULTS = {
    "odd": (0.0, 0.04), "again": (0.0, 0.25), "ends": (0.015, 0.45), "letters": (0.9, 1.0), "upper": (0.0, 0.35),
    "length": (2.5, 9.0), "lines": (0.0, 0.5), "digits": (0.0, 0.25),
}
#: Labellers that vote good on what lies within all of their ranges and abstain on the rest.
VIRTUES = {
    "prose": {"ends": (0.04, 0.25), "letters": (0.93, 1.0), "upper": (0.0, 0.15), "again": (0.0, 0.1), "odd": (0.0, 0.02)},
    "plain": {"odd": (0.0, 0.01), "again": (0.0, 0.05), "letters": (0.93, 1.0), "lines": (0.0, 0.3), "length": (3.5, 7.5)},
}
LABELLERS = (*FAULTS, *VIRTUES)
#: Buckets of the hashed features, and the documents that the scorer is fitted on.
BUCKETS, SAMPLE = 1 << 15, 4000
ROUNDS, EPOCHS, RATE, SCALE = 60, 80, 0.3, 10.0
#: The score from which a document is kept: low, as a good document lost costs more than a bad one kept.
LEAST = 0.25

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Plain punctuation and continuation bytes; what is none of all these counts as odd.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*b""".,;:!?'"()-""", *range(0x80, 0xC3)]] = True
_END = np.zeros(256, bool)
_END[[*b".!?"]] = True


def measures(text: str) -> tuple[float, ...]:
    """What the labellers look at, of a whole text, in their order; a text without words measures 0 throughout.

    Shares: of odd characters among the visible ones, of words equal to the word before, of words that end a
    sentence, of letters among the visible characters, of capitals among the letters; the mean length of words in
    characters; the share of lines that repeat another; the share of digits among the visible characters.
    """
    words = text.split()
    if not words:
        return (0.0,) * len(MEASURES)
    raw = np.frombuffer(text.encode(), np.uint8)
    seen = np.bincount(raw, minlength=256)
    n, continued = len(words), int(seen[0x80:0xC0].sum())
    visible = max(1, len(raw) - int(seen[_SPACE].sum()) - continued)
    letters, digits, plain = (int(seen[c].sum()) for c in (_LETTER, _DIGIT, _PLAIN))
    again = sum(map(str.__eq__, words, words[1:]))
    ends = int((_END[raw[:-1]] & _SPACE[raw[1:]]).sum()) + int(_END[raw[-1]])
    lines = [line for line in text.split("\n") if line]
    odd = visible - letters - digits - (plain - continued)
    return (
        max(0, odd) / visible, again / n, ends / n, letters / visible, int(seen[_UPPER].sum()) / max(1, letters), visible / n,
        1 - len(set(lines)) / max(1, len(lines)), digits / visible,
    )


def vote(values: np.ndarray) -> np.ndarray:
    """Votes of all labellers on documents given by their measures."""
    column = dict(zip(MEASURES, values.T, strict=True))
    within = lambda name, ends: (column[name] >= ends[0]) & (column[name] <= ends[1])
    faults = [np.where(within(name, ends), ABSTAIN, BAD) for name, ends in FAULTS.items()]
    virtues = [np.where(np.all([within(*x) for x in ranges.items()], axis=0), GOOD, ABSTAIN) for ranges in VIRTUES.values()]
    return np.stack([*faults, *virtues], axis=1)


def patterns(texts: pd.Series) -> np.ndarray:
    """Per text the votes of all labellers as one number to the base of 3."""
    if not len(texts):
        return np.zeros(0, np.int64)
    votes = vote(np.array([measures(t or "") for t in texts]))
    return votes @ 3 ** np.arange(len(LABELLERS))


@F.pandas_udf(T.LongType())
def vote_pattern(texts: pd.Series) -> pd.Series:
    return pd.Series(patterns(texts))


def accuracies(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """The probability of each vote pattern to be of a good document, and the accuracy of each labeller.

    Expectation-maximisation over the counted patterns, of which there are at most 3 ** labellers however many
    documents there are. A labeller that votes is right with its accuracy, whatever the others say; one that
    abstains says nothing. Accuracies start equal, and stay better than chance, which tells good from bad.
    """
    right = np.full(len(LABELLERS), 0.9)
    if not counts:
        return {}, right
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([[k // 3**i % 3 for i in range(len(LABELLERS))] for k in keys])
    sides = (votes == GOOD).astype(float) - (votes == BAD)
    prior = 0.5
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + sides @ np.log(right / (1 - right))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        correct = np.where(votes == GOOD, good[:, None], np.where(votes == BAD, 1 - good[:, None], 0.0))
        right = np.clip((n @ correct + 0.9) / (n @ (votes != ABSTAIN) + 1.0), 0.6, 0.999)
        prior = float(np.clip(n @ good / n.sum(), 0.05, 0.95))
    return dict(zip(keys, good.tolist(), strict=True)), right


def bucket(kind: str, value: object) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % (BUCKETS - 1)


def outline(word: str) -> tuple[str, bool, bool, bool]:
    return word[-1:], word.isalpha(), word.isupper(), word.islower()


def buckets(word: str) -> tuple[int, int, int]:
    """The hashed features of a word: itself in lower case, its ending, and its outline."""
    return bucket("word", word.lower()), bucket("end", word[-3:]), bucket("outline", outline(word))


#: The bucket of words that repeat the word before.
AGAIN = BUCKETS - 1


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares, whole text."""
    words = text.split()
    share: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for bucket in buckets(word):
            share[bucket] += n
    share[AGAIN] += sum(map(str.__eq__, words, words[1:]))
    at = np.fromiter(share.keys(), np.int64, len(share))
    return at, np.fromiter(share.values(), float, len(share)) * (SCALE / max(1, len(words)))


@dataclass
class Scorer:
    """A linear scorer on hashed features."""

    weights: np.ndarray
    bias: float

    def __call__(self, texts: pd.Series, known: Known) -> np.ndarray:
        """Scores from 0 to 1, from whole texts."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = (text or "").split()
            again = float(self.weights[AGAIN]) * sum(map(str.__eq__, words, words[1:]))
            out[i] = (sum(map(known.__getitem__, words)) + again) * SCALE / max(1, len(words)) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


class Known(dict):
    """The summed weights of the features of words, kept for words met before."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()
        self.parts: dict = {}

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
            self.parts.clear()
        parts, weights, end, form = self.parts, self.weights, word[-3:], outline(word)
        if end not in parts:
            parts[end] = weights[bucket("end", end)]
        if form not in parts:
            parts[form] = weights[bucket("outline", form)]
        self[word] = found = weights[bucket("word", word.lower())] + parts[end] + parts[form]
        return found


def fit(rows: list[tuple[np.ndarray, np.ndarray]], goals: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Scorer:
    """Logistic regression on hashed shares towards posterior labels, by full gradients with adaptive steps.

    Both classes weigh the same. Without rows, or rows of one class only, the scorer is sure of that class (good
    without any).
    """
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return Scorer(weights, 3.0)
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    if goals.max() < 0.5 or goals.min() >= 0.5:
        return Scorer(weights, 3.0 if goals.max() >= 0.5 else -3.0)
    weight = goals / goals.sum() + (1 - goals) / (1 - goals).sum()
    weight /= weight.sum()
    first, second, bias_grad = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0
    for step in range(1, epochs + 1):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * weights[at], len(rows)) + bias, -50, 50)))
        error = (score - goals) * weight
        grad = np.bincount(at, value * error[row], BUCKETS) + 1e-5 * weights
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        bias_grad = 0.9 * bias_grad + float(error.sum())
        bias -= rate * bias_grad
    return Scorer(weights, bias)


def quality(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """Every input column with ``posterior``, ``score`` and ``kept`` (score at least ``least``).

    Heuristic labellers vote on every document (LABELLERS). Their votes are counted by pattern over the whole
    table; expectation-maximisation estimates from these counts how accurate each labeller is, which gives every
    pattern its posterior. A hashed linear scorer is then fitted to the posteriors of ``sample`` documents, the
    first in a seeded order of ids, and scores all documents from their whole texts.

    Null and empty texts: all measures are 0, the score is that of no features, kept is decided alike. Rows of
    equal text get equal results. An empty table gives an empty table. Input columns named like the results are
    replaced.
    """
    rows = wrapped(docs, text=F.coalesce(named(text_column).cast("string"), F.lit("")), order=seeded(8, named(id_column)))
    counted = rows.groupBy(vote_pattern("text").alias("pattern")).count().collect()
    posteriors, _ = accuracies({r["pattern"]: r["count"] for r in counted})
    table = np.full(3 ** len(LABELLERS), 0.5)
    table[list(posteriors)] = list(posteriors.values())

    @F.pandas_udf("at array<long>, share array<double>, posterior double")
    def features(texts: pd.Series) -> pd.DataFrame:
        found = [hashed(t) for t in texts]
        return pd.DataFrame({"at": [f[0] for f in found], "share": [f[1] for f in found], "posterior": table[patterns(texts)]})

    # A few times the sample passes by its place in the order, so tasks send on few texts however large the table.
    share = F.lit(4.0 * sample / max(1, sum(r["count"] for r in counted)))
    chosen = rows.filter(early(F.col("order"), share)).select("order", features("text").alias("f"))
    fitted = chosen.select("order", "f.*").orderBy("order", "posterior", "at").limit(sample).collect()
    scorer = fit([(np.array(r["at"]), np.array(r["share"])) for r in fitted], np.array([r["posterior"] for r in fitted]))

    @F.pandas_udf("posterior double, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known(scorer.weights)
        for texts in batches:
            yield pd.DataFrame({"posterior": table[patterns(texts)], "score": scorer(texts, known)})

    judged = rows.withColumn("found", judge("text"))
    score = F.col("found.score")
    return unwrapped(judged, docs.columns, posterior=F.col("found.posterior"), score=score, kept=score >= least)
