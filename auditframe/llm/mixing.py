"""Mixing sources to target weights by subset-sum budget fitting (operator 5)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import blocks, hash_block, ranked, seeded, unwrapped, wrapped

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words that the exact knapsack decides on; whatever the budget beyond is met by counts first.
WINDOW = 1 << 16


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take, so that their lengths sum up to ``budget`` as nearly as can be.

    First every length gives its share of the documents, rounded down, so that the take resembles the source.
    Then, longest first, documents are added while more than ``window`` words are missing. The rest is a bounded
    knapsack over the documents not yet taken, solved exactly by dynamic programming over all sums up to twice what
    is missing: of each length, powers of two of the documents left (at most those that fit) are single items. The
    nearest sum is taken, of two equally near ones the smaller.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    budget = min(budget, total)
    # Exact integers: a product of two large totals does not fit 64 bits.
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    take[lengths == 0] = 0
    missing = budget - int((lengths * take).sum())
    order = [i for i in np.argsort(-lengths, kind="stable") if lengths[i] > 0]
    for i in order:
        more = min(int(counts[i] - take[i]), max(0, (missing - window) // int(lengths[i])))
        take[i] += more
        missing -= more * int(lengths[i])
    # Sums a little beyond what is missing may come nearer to it than any below.
    goal, top = missing, 2 * missing
    # first[s]: the item by which sum s was first reached, -1 if it was not; items are (length index, how many).
    first = np.full(top + 1, -1, np.int32)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in order:
        length, left, k = int(lengths[i]), min(int(counts[i] - take[i]), top // int(lengths[i])), 1
        while left > 0 and not reached[goal]:
            n = min(k, left)
            left, k, step = left - n, 2 * k, n * length
            if step <= top:
                new = np.zeros(top + 1, bool)
                new[step:] = reached[:-step]
                new &= ~reached
                first[new] = len(items)
                reached |= new
                items.append((i, n))
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at:
        i, n = items[first[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets from (source, source_size): weights in the order of sources, null last, over ``share`` of all words.

    No target exceeds ``most`` times its source; what is over is dealt again by weight until none is above. That
    is the level at which sum(min(most * size, level * weight)) meets the budget, found from running sums over
    the sources sorted by most * size / weight. The table has one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    limit = F.col("source_size") * float(most)
    rows = sizes.withColumn("weight", weight).withColumn("limit", limit).withColumn("level", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * float(share)
    rows = rows.withColumn("open", (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source, by level, whose limit is not below the level that the open ones would get.
    fixed = F.min(F.when(F.col("open") <= F.col("level"), F.struct("level", "open"))).over(every)["open"]
    target = F.least(F.col("limit"), F.coalesce(fixed * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 5,
    source_column: str = "source", id_column: str = "doc_id",
) -> DataFrame:
    """Every input column, ``size``, ``source_size``, ``target`` and ``copies``: how often the mix takes a row.

    Each source is taken whole as often as its target allows; for the rest of its budget ``fit`` decides on the
    histogram of exact lengths how many documents of each length to add, and the seeded order of (id) decides
    which. One task sees a source's histogram, at most as many rows as the source has different lengths; no task
    sees its documents. Ranks within a length are made in blocks, so a hot source or length is no hot task.

    Null source: a source of its own, last in order. Null size counts as 0; rows of size 0 are taken as often as
    the source is taken whole. Rows with equal ids are ordered by size; such that are equal are interchangeable.
    An empty table gives an empty table, and sources without words a target of 0. Input columns named like the
    four results are replaced.
    """
    spark = docs.sparkSession
    rows = wrapped(
        docs, own=F.coalesce(size.cast("long"), F.lit(0).cast("long")), source=F.col(f"`{source_column}`").cast("string"),
        order=seeded(seed, F.col(f"`{id_column}`")),
    )
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    lengths = rows.groupBy("key", "source", F.col("own").alias("length")).agg(F.count("*").alias("n"))
    sizes = lengths.groupBy("key", "source").agg(F.sum(F.col("length") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("length")
        whole_size, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        whole = int(target // whole_size) if whole_size else 0
        extra = fit(part["length"].to_numpy(), part["n"].to_numpy(), round(target - whole * whole_size))
        return part.assign(own=part["length"], whole=whole, extra=extra)[["key", "own", "source_size", "target", "whole", "extra"]]

    decided = lengths.select("key", "length", "n").join(targets, "key").groupBy("key").applyInPandas(
        decide, "key string, own long, source_size long, target double, whole int, extra long"
    )
    n = blocks(spark)
    numbered = ranked(rows.withColumn("block", hash_block(F.col("order"), n)), ["key", "own"], "block", ["order"])
    taken = numbered.join(decided, ["key", "own"])
    return unwrapped(
        taken, docs.columns, size=F.col("own"), source_size=F.col("source_size"), target=F.col("target"),
        copies=(F.col("whole") + (F.col("rank") < F.col("extra")).cast("int")),
    )
