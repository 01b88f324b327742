"""Near-duplicates by MinHash, banding and connected components (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.llm.common import in_small_batches, named
from auditframe.llm.set_join import by_component, classes_of, connected, labelled, labels_of, links_by_lists, whole_sets
from auditframe.llm.sets import MIX, ODD, WordHashes, common, mixed, shingles
from auditframe.session import discard, stage

#: Minima per document, in bands of ROWS; a pair of similarity 0.8 shares no band once in 20 million times.
BANDS, ROWS = 32, 4
#: Words per shingle and the similarity of links, in hundredths.
WORDS, SIMILARITY = 5, 80
#: Minima of two signatures that must agree for a link to be looked at: 0.8 of 128 less seven standard deviations.
AGREEING = 70
#: Shingles hashed at once, which bounds a task's memory for very long texts.
CHUNK = 1024
#: Rounds in which one member of each bucket is compared with the others, before one with leaders of lists.
STAR_ROUNDS = 1


def coefficients(count: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Of ``count`` universal hash functions (a * x + b) mod 2**32 on 32-bit keys, a odd."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**31, count, np.uint32) * 2 + 1).astype(np.uint32), rng.integers(0, 2**32, count, np.uint32)


def signature(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over all shingles."""
    low = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), CHUNK):
        hashed = low[at : at + CHUNK] * a[:, None]
        hashed += b[:, None]
        np.minimum(out, hashed.min(axis=1), out=out)
    return out


def features(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """From (id, text_key, text): id, text_key, n, set_hi, set_lo (128 bits that stand for the set), signature, band_keys.

    The set's 128 bits are two sums of independently mixed shingle hashes; equal sets have equal sums. The
    signature holds the low byte of every minimum.
    """
    a, b = coefficients(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            counts, hi, lo, signatures, keys = [], [], [], [], []
            for x in batch.column(2):
                found = shingles(x.as_py(), words, known)
                counts.append(len(found))
                hi.append(int(mixed(found ^ MIX).sum(dtype=np.uint64).astype(np.int64)))
                lo.append(int(mixed(found ^ ODD).sum(dtype=np.uint64).astype(np.int64)))
                if not len(found):
                    signatures.append(b"")
                    keys.append(np.zeros(0, np.int64))
                    continue
                minima = signature(found, a, b)
                signatures.append(minima.astype(np.uint8).tobytes())
                key = salt
                for column in minima.reshape(bands, rows).T:
                    key = mixed(key * ODD + column.astype(np.uint64))
                keys.append(key.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                 pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "text_key", "n", "set_hi", "set_lo", "signature", "band_keys"],
            )

    return in_small_batches(docs).mapInArrow(run, "id long, text_key long, n long, set_hi long, set_lo long, signature binary, band_keys array<long>")


@F.pandas_udf(T.IntegerType())
def agreeing(one: pd.Series, other: pd.Series) -> pd.Series:
    """How many minima of two signatures agree."""
    if not len(one):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (one, other))
    return pd.Series((a == b).sum(axis=1).astype(np.int32))


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar as asked: by size and signature first, then by the sets."""
    one = nodes.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    other = nodes.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    sized = pairs.join(one, "a").join(other, "b").filter(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    likely = sized.withColumn("agree", agreeing("s_a", "s_b")).filter(F.col("agree") >= AGREEING).select("a", "b", "n_a", "n_b")
    first = sets.select(F.col("class").alias("a"), F.col("tokens").alias("x"))
    second = sets.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
    both = likely.join(first, "a").join(second, "b").withColumn("common", common("x", "y"))
    return both.filter(100 * F.col("common") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, text_column: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of the input.

    Documents whose shingle sets have 100 * intersection >= similarity * union are linked; component_id is the
    smallest id that is reachable by links, kept marks the document that has it. Candidates come from bands of
    MinHash signatures; a link counts only after the whole sets were compared. No link between documents of a
    bucket is lost, though not all pairs are made:

    1. Documents of equal sets form one class, which goes on as one node.
    2. In every bucket of at least two, one member is compared with the others; confirmed links make components.
       Repeated with other members, this joins most of what belongs together at a cost in line with the buckets.
    3. The members of buckets that still hold several components enter lists of their rarest shingles, which no
       pair that is similar enough escapes; leaders of the lists, then the pairs that places, sizes and sketches do not
       exclude are compared (``set_join.links_by_lists``). Nothing is capped.

    Letters A-Z count as a-z; words are divided by ASCII white space. A text with fewer words than a shingle has
    one shingle, its whole sequence; without words or text it has none, is linked with nothing and kept. Rows of
    equal id count as one document with the links of all its texts, in whatever order they come. A row without an id is
    linked with nothing and kept; its component is null. Other columns are left out. An empty table gives an empty table.
    """
    text = named(text_column).cast("string")
    rows = docs.select(named(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    seen = stage(features(rows, words), "features")
    same = ["set_hi", "set_lo", "n"]
    linkable = seen.filter("n > 0 and id is not null")
    classes, members, links = classes_of(linkable, "minhash")
    reps = linkable.join(classes.select("class", "id", "text_key", *same), ["id", "text_key", *same]).dropDuplicates(["class"])
    reps = reps.select("class", "n", "signature", "band_keys")
    # What entries are joined with is written before: Spark splits the hot keys of a join of two scans, but not of one
    # whose other side an aggregate has just made by the same key.
    entries = stage(reps.select(F.explode("band_keys").alias("key"), "class"), "entries")
    full = stage(entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), "full")
    shared = stage(entries.join(full, "key"), "buckets")
    discard(entries, full)
    active = shared.select("class").distinct()
    nodes = stage(reps.join(active, "class", "left_semi").select("class", "n", "signature"), "nodes")
    texts = rows.join(classes.join(active, "class", "left_semi").select("class", "n", "id", "text_key"), ["id", "text_key"])
    whole = stage(whole_sets(texts.select("class", "n", "text"), words).dropDuplicates(["class"]), "sets")
    others = seen.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    others = stage(others, "unlinked")
    discard(seen)
    tried, labels, spent = None, labels_of(links, "components"), [shared, nodes, whole]
    for round_ in range(STAR_ROUNDS + 1):
        current = labelled(shared, labels)
        first = F.min(F.struct(F.xxhash64("class", F.lit(round_)).alias("order"), F.col("class").alias("centre"), F.col("component").alias("of")))
        spread = F.min("component") != F.max("component")
        open_ = current.groupBy("key").agg(first.alias("first"), spread.alias("open")).filter("open")
        open_ = stage(open_.select("key", "first.centre", "first.of"), f"open-{round_}")
        spent.append(open_)
        if round_ == STAR_ROUNDS:
            left = current.join(open_.select("key"), "key").select("class").distinct()
            left = stage(whole.join(left, "class", "left_semi"), "left")
            labels, more = links_by_lists(left, links, labels, similarity, rounds=1)
            spent += [left, *more]
            break
        found = current.join(open_, "key").filter("component <> of")
        pairs = found.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        tried = stage(pairs, f"pairs-{round_}")
        known = stage(confirmed(tried, nodes, whole, similarity), f"links-{round_}")
        spent += [tried, known]
        links, labels = connected(links, labels, known, f"components-{round_}")
    every = by_component(classes, members, labels, "minhash").unionByName(others)
    discard(*spent, classes)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return every.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
