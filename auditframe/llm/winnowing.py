"""Document fingerprints by winnowing (operator 7)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.llm.common import FLUSH_BYTES, blocks, named

#: Code points hashed together, and hashes per window: any stretch of K + WINDOW - 1 equal code points is found.
K, WINDOW = 16, 16
#: Ranges of ids per shuffle partition, for an even load.
RANGES = 4
BASE = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of every k-gram, 32 well-mixed bits each, by joining stretches of doubling length."""
    # grams[i] covers `done` code points from i; the binary digits of k tell which stretches make up k.
    power, part, width = BASE, codes.astype(np.uint64) + np.uint64(1), 1
    whole, done = None, 0
    while width <= k:
        if k & width:
            n = len(codes) - done - width + 1
            whole = part[:n].copy() if whole is None else whole[:n] * np.uint64(power) + part[done : done + n]
            done += width
        if 2 * width <= k:
            part = part[:-width] * np.uint64(power) + part[width:]
            power = power * power % 2**64
        width *= 2
    mixed = whole ^ (whole >> np.uint64(32))
    return (mixed * np.uint64(MIX)) >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions (code points) of the fingerprint of a text.

    Of every ``window`` consecutive k-gram hashes the smallest is chosen, the rightmost of equal ones, and each
    choice is kept once with its position. So any passage of k + window - 1 code points that two texts share
    gives them a common hash. Texts with fewer grams than a window have one window; a text shorter than k is one
    gram as a whole; an empty text has no fingerprint.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes = rolling(codes, min(k, len(codes)))
    # The position, reversed, below the hash: the least key is the smallest hash and, among equals, the rightmost.
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    span, width = min(window, len(keys)), 1
    while 2 * width <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if width < span:
        keys = np.minimum(keys[: -(span - width)], keys[span - width :])
    chosen = keys[np.r_[True, keys[1:] != keys[:-1]]]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as a short name: equal for equal fingerprints."""
    return hashlib.blake2b(hashes.astype("<u4").tobytes() + positions.astype("<i8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common hashes over all hashes of two fingerprints; two without any are alike."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - common
    return common / every if every else 1.0


def fingerprints(
    df: DataFrame, texts: Sequence[str], pairs: Sequence[tuple[str, str]] = (), keep: Sequence[str] = (), spans: bool = True,
    k: int = K, window: int = WINDOW,
) -> DataFrame:
    """Fingerprints of text columns, and how alike those of pairs of them are, row by row.

    Gives the columns ``keep``; for each text column t ``fingerprint_t`` (a name of it) and, with ``spans``,
    ``hashes_t`` and ``positions_t``; for each pair ``likeness_a_b``. Null texts count as empty. Positions of
    texts beyond 2**32 code points would wrap; Spark's own limit on strings is lower.
    """
    carried = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType(list(carried))
    for t in texts:
        schema.add(f"fingerprint_{t}", "string")
        if spans:
            schema.add(f"hashes_{t}", T.ArrayType(T.LongType())).add(f"positions_{t}", T.ArrayType(T.LongType()))
    for a, b in pairs:
        schema.add(f"likeness_{a}_{b}", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One row at a time: only what leaves the task is kept for the whole batch.
            made: dict[str, list] = {f.name: [] for f in schema.fields if f not in carried}
            for row in zip(*(batch.column(t) for t in texts), strict=True):
                found = {t: winnow(x.as_py() or "", k, window) for t, x in zip(texts, row, strict=True)}
                for t, (hashes, positions) in found.items():
                    made[f"fingerprint_{t}"].append(digest(hashes, positions))
                    if spans:
                        made[f"hashes_{t}"].append(hashes.astype(np.int64))
                        made[f"positions_{t}"].append(positions)
                for a, b in pairs:
                    made[f"likeness_{a}_{b}"].append(likeness(found[a][0], found[b][0]))
            kinds = {"fingerprint": pa.string(), "likeness": pa.float64(), "hashes": pa.list_(pa.int64()), "positions": pa.list_(pa.int64())}
            columns = {f.name: batch.column(f.name) for f in carried}
            columns |= {name: pa.array(values, kinds[name.split("_")[0]]) for name, values in made.items()}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], [f.name for f in schema.fields])

    return df.select(*[named(c) for c in dict.fromkeys([*[f.name for f in carried], *texts])]).mapInArrow(run, schema)


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text and ``next``: the text of the document with the next larger id, for the last that of the first.

    Ids are cut into ranges, by quantiles of which the session's shuffle partitions fix the number. One shuffle
    brings each range together with the first document of the following range; then every task reads its range in
    order and needs one row at a time. Null texts count as empty. Null ids come first; documents of equal id are
    ordered by text. A single document follows itself.
    """
    n = blocks(docs.sparkSession)
    key = F.coalesce(named(id_column).cast("long"), F.lit(-(2**63)))
    rows = docs.select(
        named(id_column).cast("long").alias("doc_id"), F.coalesce(named(text_column).cast("string"), F.lit("")).alias("text"), key.alias("key")
    )
    shares = [i / (RANGES * n) for i in range(1, RANGES * n)]
    cuts = rows.select(F.percentile_approx("key", shares, 10 * RANGES * n).alias("cuts")).first()["cuts"] or []
    ranges = rows.withColumn("range", range_of(F.col("key"), sorted(set(cuts))))
    heads = ranges.groupBy("range").agg(F.min("key").alias("key"))
    order = Window.orderBy("range")
    heads = heads.withColumn("before", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())))
    # One row per range, so its size is bounded by the number of ranges.
    first = ranges.join(F.broadcast(heads), ["range", "key"]).groupBy("before").agg(F.min("text").alias("text"))
    closing = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("key"), F.col("before").alias("range"))
    every = ranges.withColumn("closing", F.lit(False)).unionByName(closing.withColumn("closing", F.lit(True)))
    dealt = every.repartition(n, "range").sortWithinPartitions("range", "closing", "key", "text").select("doc_id", "text", "closing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, ids, own, following, held = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            out = [pa.array(ids, pa.int64()), pa.array(own, pa.string()), pa.array(following, pa.string())]
            for c in (ids, own, following):
                c.clear()
            return pa.RecordBatch.from_arrays(out, ["doc_id", "text", "next"])

        for batch in batches:
            for doc, text, ends in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                if waiting:
                    ids.append(waiting[0])
                    own.append(waiting[1])
                    following.append(text)
                    held += len(waiting[1]) + len(text)
                    if held > FLUSH_BYTES:
                        held = 0
                        yield flush()
                waiting = None if ends else (doc, text)
        yield flush()

    return dealt.mapInArrow(run, "doc_id long, text string, next string")


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` a key has reached, looked up in two steps of about the square root of all."""
    step = max(1, math.isqrt(len(cuts)))
    fine = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not fine:
        return F.lit(0)
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    row = F.greatest(F.size(F.filter(longs([f[0] for f in fine]), lambda c: c <= key)), F.lit(1))
    return (row - 1) * step + F.size(F.filter(F.element_at(F.array(*map(longs, fine)), row), lambda c: c <= key))
