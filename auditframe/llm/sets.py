"""Word shingle sets as sorted arrays of hashes, their intersections, and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.session import discard, stage

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread evenly over all 64."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; with fewer words than a shingle has, the sequence as one.

    Lower-casing and splitting bytes touch only the letters A-Z and the six ASCII white-space characters.
    """
    found = (text or "").encode().lower().split()
    n = min(words, len(found))
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    whole = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        whole = mixed(whole * ODD + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(whole)


@F.pandas_udf(T.LongType())
def common(one: pd.Series, other: pd.Series) -> pd.Series:
    """The size of the intersection of two sorted sets."""
    out = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(one, other, strict=True)]
    return pd.Series(out, dtype="int64")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every node on an edge (a, b): the smallest node it is connected with.

    Alternating large-star and small-star: every node ties its larger neighbours, then itself and its smaller
    ones, to the smallest node it knows of, until nothing changes. Minima are found with partial aggregates,
    written, and handed out by joins of two scans, whose hot keys Spark splits, so a node of any degree is no hot
    task; each round is written, which cuts its lineage.
    """
    current = stage(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct(), name)
    before = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        # Large-star: m is the least of u and its neighbours; each neighbour above u is tied to m.
        around = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = around.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # Small-star: of a node's smaller neighbours the least takes the node and the others.
        large = stage(large, f"{name}-large")
        low = stage(large.groupBy("v").agg(F.min("u").alias("m")), f"{name}-low")
        small = large.join(low, "v").select(F.explode(F.array(F.struct("m", F.col("u").alias("w")), F.struct("m", F.col("v").alias("w")))).alias("e"))
        tied = stage(small.select(F.col("e.m").alias("u"), F.col("e.w").alias("v")).filter("u < v").distinct(), name)
        discard(current, least, large, low)
        current = tied
    roots = current.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id"))
    return current.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)
