"""Language identification by a bidirectional gated recurrent network over bytes (operator 3)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import early, in_small_batches, named, seeded, unwrapped, wrapped

UNKNOWN = "und"
#: State units per direction, bytes per segment, segments read at once.
UNITS, SEGMENT, LANES = 8, 128, 2048
#: The training sample: documents per language, excerpts per document, characters per excerpt.
DOCS, EXCERPTS, EXCERPT = 300, 4, 96
STEPS, BATCH, RATE = 260, 192, 0.02


@dataclass
class Network:
    """Weights of both directions (first axis: forward, backward) and of the labelling layer, as float32.

    ``table[d, :, b]`` holds what byte b adds to the three gates, ``loop[d]`` what the state adds.
    """

    languages: list[str]
    table: np.ndarray
    loop: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def segments(raw: bytes, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """A text's bytes in rows of ``size``, the last one padded, and how many bytes of each row count."""
    n = max(1, -(-len(raw) // size))
    rows = np.zeros(n * size, np.uint8)
    rows[: len(raw)] = np.frombuffer(raw, np.uint8)
    sizes = np.full(n, size)
    sizes[-1] = len(raw) - (n - 1) * size
    return rows.reshape(n, size), sizes


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): the bounded function of gates and candidate; like tanh in shape, a fraction of its cost."""
    low = np.abs(x)
    low += 1
    return np.divide(x, low, out=low)


def _gates(x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Update gate and reset gate, both (1 + soft) / 2, and candidate."""
    k = len(x) // 3
    g = soft(x[: 2 * k] + u[: 2 * k])
    g += 1
    g *= np.float32(0.5)
    return g[:k], g[k:], soft(x[2 * k :] + g[k:] * u[2 * k :])


def states(net: Network, codes: np.ndarray, sizes: np.ndarray, direction: int) -> np.ndarray:
    """The state at each position: (unit, time, lane). ``codes`` is (time, lane). Padding keeps the state at zero."""
    steps, lanes = codes.shape
    table, loop = net.table[direction], np.ascontiguousarray(net.loop[direction].T)
    k = loop.shape[1]
    out = np.empty((k, steps, lanes), np.float32)
    h = np.zeros((k, lanes), np.float32)
    partial = int(sizes.min())
    x, u = np.empty((3 * k, lanes), np.float32), np.empty((3 * k, lanes), np.float32)
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        np.take(table, codes[t], axis=1, out=x, mode="clip")
        z, _, c = _gates(x, np.matmul(loop, h, out=u))
        h -= c
        h *= z
        h += c
        if t >= partial:
            h *= t < sizes
        out[:, t] = h
    return out


def probabilities(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """The label of every position, as probabilities: (language, time, lane)."""
    k, steps, lanes = forward.shape
    score = net.out[:k].T @ forward.reshape(k, -1)
    score += net.out[k:].T @ backward.reshape(k, -1)
    score += net.bias[:, None]
    score -= score.max(axis=0)
    np.exp(score, out=score)
    score /= score.sum(axis=0)
    return score.reshape(-1, steps, lanes)


def label(net: Network, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Summed probabilities of the labels of all positions of each segment: (segment, language)."""
    codes = np.ascontiguousarray(rows.T).astype(np.intp)
    forward, backward = states(net, codes, sizes, 0), states(net, codes, sizes, 1)
    total = np.zeros((len(net.languages), len(sizes)), np.float32)
    for t in range(0, len(codes), 4):
        found = probabilities(net, np.ascontiguousarray(forward[:, t : t + 4]), np.ascontiguousarray(backward[:, t : t + 4]))
        found *= np.arange(t, t + found.shape[1])[:, None] < sizes
        total += found.sum(axis=1)
    return total.T


def train(
    texts: list[str], languages: list[str], units: int = UNITS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, size: int = 64, seed: int = 3
) -> Network:
    """Fit the network by backpropagation through time: every byte of a text is to be labelled with its language.

    The order of the texts must be fixed for runs to agree; no text or one language give a network that is sure
    of it (or knows none).
    """
    known = sorted(set(languages))
    rng = np.random.default_rng(seed)
    k, n = units, len(known)
    w = {
        "table": rng.normal(0, 0.3, (2, 3 * k, 256)), "loop": rng.normal(0, 1 / np.sqrt(k), (2, k, 3 * k)),
        "out": rng.normal(0, 1 / np.sqrt(2 * k), (2 * k, n)), "bias": np.zeros(n),
    }
    w["table"][:, :k] += 1.0  # gates that remember, at first
    w = {name: x.astype(np.float32) for name, x in w.items()}
    net = lambda: Network(known, w["table"], w["loop"], w["out"], w["bias"])
    cut = [(row, m, known.index(lang)) for text, lang in zip(texts, languages, strict=True) for row, m in zip(*segments(text.encode(), size), strict=True) if m >= size // 2]
    if n < 2 or not cut:
        return net()
    rows, sizes, goal = np.array([c[0] for c in cut]), np.array([c[1] for c in cut]), np.array([c[2] for c in cut])
    weight = len(goal) / (n * np.maximum(1, np.bincount(goal, minlength=n)))
    first = {name: np.zeros_like(x) for name, x in w.items()}
    second = {name: np.zeros_like(x) for name, x in w.items()}
    for step in range(1, steps + 1):
        pick = rng.choice(len(goal), batch, p=weight[goal] / weight[goal].sum())
        grad = gradients(net(), rows[pick], sizes[pick], goal[pick])
        now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for name, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            w[name] -= (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net()


def gradients(net: Network, rows: np.ndarray, sizes: np.ndarray, goal: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of all labels, by backpropagation through time in both directions."""
    codes = np.ascontiguousarray(rows.T).astype(np.intp)
    steps, lanes = codes.shape
    k = net.loop.shape[1]
    both = [states(net, codes, sizes, 0), states(net, codes, sizes, 1)]
    error = probabilities(net, *both)
    error[goal, :, np.arange(lanes)] -= 1
    error *= ((np.arange(steps)[:, None] < sizes) / np.float32(sizes.sum())).astype(np.float32)
    flat = error.reshape(len(error), -1)
    grad = {"out": np.concatenate([h.reshape(k, -1) @ flat.T for h in both]), "bias": flat.sum(axis=1)}
    table, loop = np.zeros_like(net.table), np.zeros_like(net.loop)
    for d, own in enumerate(both):
        held = (net.out[d * k : (d + 1) * k] @ flat).reshape(own.shape)
        order = list(range(steps)) if d == 0 else list(range(steps - 1, -1, -1))
        carry = np.zeros((k, lanes), np.float32)
        for i in range(steps - 1, -1, -1):
            t = order[i]
            h = own[:, order[i - 1]] if i else np.zeros((k, lanes), np.float32)
            u = net.loop[d].T @ h
            z, r, c = _gates(net.table[d][:, codes[t]], u)
            g = (held[:, t] + carry) * (t < sizes)
            # Slopes of soft(x) = s and of (1 + s) / 2 = p: (1 - |s|)**2 and (1 - |2 p - 1|)**2 / 2.
            dc = g * (1 - z) * (1 - np.abs(c)) ** 2
            dz = g * (h - c) * (1 - np.abs(2 * z - 1)) ** 2 / 2
            dr = dc * u[2 * k :] * (1 - np.abs(2 * r - 1)) ** 2 / 2
            dx = np.concatenate([dz, dr, dc])
            du = np.concatenate([dz, dr, dc * r])
            carry = g * z + net.loop[d] @ du
            loop[d] += h @ du.T
            for row, values in zip(table[d], dx, strict=True):
                row += np.bincount(codes[t], values, 256)
    return grad | {"table": table, "loop": loop}


def sample(labelled: DataFrame, text_column: str, lang_column: str, order: str, docs: int = DOCS) -> tuple[list[str], list[str]]:
    """Excerpts of at most ``docs`` documents per language, early ones in a seeded order, and their languages.

    The sample is bounded as only the weights are learnt from it; predictions read whole texts.
    """
    n = F.length("text")
    starts = [F.greatest(F.lit(1), F.floor((n - EXCERPT) * i / max(1, EXCERPTS - 1)).cast("int") + 1) for i in range(EXCERPTS)]
    cuts = F.array_distinct(F.array(*[F.substring(F.col("text"), s, F.lit(EXCERPT)) for s in starts]))
    rows = labelled.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"), F.col(order).alias("order"))
    # A few times as many rows as are wanted pass by their place in the order, whatever the table's size; these
    # are ranked. The driver learns one count per language, of which the network has one output each; no text is
    # shuffled, and of texts only the excerpts of rows that pass.
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return [], []
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 4.0 * docs / r["count"])])
    passed = rows.filter(early(F.col("order"), shares[F.col("lang")]))
    first = Window.partitionBy("lang").orderBy("order", "cuts")
    numbered = passed.select("lang", "order", cuts.alias("cuts")).withColumn("nth", F.row_number().over(first))
    found = numbered.filter(F.col("nth") <= docs).select("lang", "nth", "cuts").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["nth"]))
    pairs = [(cut, r["lang"]) for r in found for cut in r["cuts"] if cut]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def learn(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", docs: int = DOCS) -> Network:
    """A network from the labelled rows (text and language not null) of a table; an empty one knows no language."""
    rows = labelled.filter(named(text_column).isNotNull() & named(lang_column).isNotNull())
    rows = rows.select(named(text_column).alias("text"), named(lang_column).cast("string").alias("lang"), seeded(3, named(id_column)).alias("order"))
    return train(*sample(rows, "text", "lang", "order", docs))


def identify(docs: DataFrame, net: Network, text_column: str = "text") -> DataFrame:
    """Every input column with ``lang_pred`` and ``score``, the pooled probability of that language.

    All bytes of the whole text are labelled: the text is read in segments, by both directions, and the mean of
    the label probabilities of all positions is the document's. ``und`` with score 0 where the text is null or
    has no letter, or where the network knows no language. Ties go to the first language by name. Repeated rows
    get equal results; input columns named like the results are replaced.
    """
    @F.pandas_udf("best int, share double")
    def pooled_label(texts: pd.Series) -> pd.DataFrame:
        pooled = np.zeros((len(texts), max(1, len(net.languages))), np.float64)
        cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def drain() -> None:
            rows, sizes, owners = (np.concatenate(x) for x in zip(*cuts, strict=True))
            np.add.at(pooled, owners, label(net, rows, sizes))
            cuts.clear()

        held = 0
        for i, text in enumerate(texts):
            if not text or not net.languages:
                continue
            rows, sizes = segments(text.encode())
            for at in range(0, len(sizes), LANES):
                cut = rows[at : at + LANES], sizes[at : at + LANES], np.full(len(sizes[at : at + LANES]), i)
                if held + len(cut[1]) > LANES:
                    drain()
                    held = 0
                cuts.append(cut)
                held += len(cut[1])
        if cuts:
            drain()
        best = pooled.argmax(axis=1)
        share = pooled[np.arange(len(texts)), best] / np.maximum(pooled.sum(axis=1), 1e-12)
        return pd.DataFrame({"best": best.astype(np.int32), "share": np.minimum(share, 1.0)})

    rows = in_small_batches(wrapped(docs, text=named(text_column).cast("string"))).withColumn("label", pooled_label("text"))
    sure = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(net.languages))
    known = F.array(*[F.lit(lang) for lang in net.languages or [UNKNOWN]])
    lang = F.when(sure, F.element_at(known, F.col("label.best") + 1)).otherwise(F.lit(UNKNOWN))
    return unwrapped(rows, docs.columns, lang_pred=lang, score=F.when(sure, F.col("label.share")).otherwise(F.lit(0.0)))
