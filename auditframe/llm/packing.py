"""Best-fit packing by exact-complement hashing (operator 2)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import FLUSH_BYTES, blocks, default_tokenizer, hash_block, in_small_batches, named, ranked, seeded, tokenizer, unwrapped, wrapped
from auditframe.session import stage

CAPACITY = 2048
END_ID = 0


@dataclass(frozen=True)
class Slot:
    """Pieces of ``length`` with ranks from ``first``: ``repeat`` of them go into each of ``sequences`` sequences."""

    length: int
    first: int
    sequences: int
    repeat: int
    base: int
    offset: int


class Complements:
    """Index of which lengths, pairs and triples of lengths sum up to a gap, under availability counts.

    ``left[l]`` pieces of length l are available. Pairs are kept by their sum, largest member first, in flat arrays
    of at most capacity**2 / 4 entries; a pair of which a member ran out is skipped for good, as counts only fall.
    """

    def __init__(self, left: np.ndarray):
        self.left = left.tolist()
        capacity = len(self.left) - 1
        present = np.flatnonzero(left)
        larger, smaller = [], []
        for a in present[::-1].tolist():
            b = present[(present <= a) & (present + a <= capacity)]
            larger.append(np.full(len(b), a, np.int32))
            smaller.append(b.astype(np.int32))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (larger, smaller))
        order = np.argsort(a + b, kind="stable")
        self.a, self.b = a[order], b[order]
        self.start = np.searchsorted((a + b)[order], np.arange(capacity + 2)).tolist()
        self.next = self.start[:-1].copy()

    def largest(self, gap: int) -> int:
        """The largest available length of at most ``gap``, 0 if none."""
        while gap and not self.left[gap]:
            gap -= 1
        return gap

    def pair(self, total: int, third: int = 0) -> tuple[int, ...]:
        left, at, end = self.left, self.next[total], self.start[total + 1]
        advancing = True
        while at < end:
            a, b = int(self.a[at]), int(self.b[at])
            if left[a] and left[b] and (a != b or left[a] > 1):
                if left[a] > (a == third) + (a == b) and left[b] > (b == third) + (a == b):
                    return a, b
                advancing = False
            at += 1
            if advancing:
                self.next[total] = at
        return ()

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that fill ``gap`` exactly, the fewest and largest first."""
        if self.left[gap]:
            return (gap,)
        if found := self.pair(gap):
            return found
        c = self.largest(gap - 2) if gap > 2 else 0
        while 3 * c >= gap > 0 and c:
            if found := self.pair(gap - c, c):
                return (c, *found)
            c = self.largest(c - 1)
        return ()


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Which ranks of which length go where, from nothing but how many pieces there are of each length.

    The longest length left opens a sequence. Its gap is filled exactly by one, two or three lengths if the index
    has such a complement, else the longest length that fits goes in and the rest of the gap is tried again. The
    pattern found is used as often as the counts allow, so the work depends on the capacity, not on the pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index = Complements(left)
    left = index.left
    used: Counter[int] = Counter()
    slots: list[Slot] = []
    base = 0
    for opener in range(capacity, 0, -1):
        while left[opener]:
            left[opener] -= 1
            pattern, gap = Counter({opener: 1}), capacity - opener
            while gap:
                found = index.exact(gap)
                if not found:
                    best = index.largest(gap)
                    if not best:
                        break
                    found = (best,)
                for length in found:
                    left[length] -= 1
                    pattern[length] += 1
                    gap -= length
            more = min(left[length] // k for length, k in pattern.items())
            offset = 0
            for length, k in pattern.items():
                left[length] -= more * k
                slots.append(Slot(length, used[length], more + 1, k, base, offset))
                used[length] += (more + 1) * k
                offset += length * k
            base += more + 1
    return slots


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: Sequence[str] = ("doc_id", "piece"), seed: int = 2
) -> DataFrame:
    """Places for pieces of 1 to ``capacity`` tokens: every column of ``pieces``, ``sequence_id`` and ``offset``.

    Only the number of pieces of each length, at most ``capacity`` rows, reaches the driver, which plans patterns
    of lengths (``plan``). Each piece then finds its place from its length and its rank among the pieces of that
    length; ranks are made in blocks, so that a hot length is no hot task. Sequences are gapless from offset 0.

    ``order`` names the columns that tell pieces apart; repeated rows are interchangeable. Pieces without a length, or one outside 1 to
    ``capacity``, are refused with an error. An empty table gives an empty table. Input columns named
    ``sequence_id`` or ``offset`` are replaced.
    """
    spark = pieces.sparkSession
    size = F.col(length)
    checked = F.when(size.between(1, capacity), size).otherwise(F.raise_error(F.lit(f"piece length outside 1..{capacity}")))
    rows = wrapped(pieces, size=checked.cast("int"), order=seeded(seed, *[named(c) for c in order]))
    counts = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}
    slots = sorted(plan(counts, capacity), key=lambda s: (s.length, s.first))
    lengths, firsts, sequences, bases, offsets = (
        np.array([getattr(s, f) for s in slots], np.int64) for f in ("length", "first", "sequences", "base", "offset")
    )
    starts = np.searchsorted(lengths, np.arange(capacity + 2))

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        own, at = size.to_numpy(np.int64), np.zeros(len(size), np.int64)
        for each in np.unique(own):
            where = own == each
            low, high = starts[each], starts[each + 1]
            at[where] = low + np.searchsorted(firsts[low:high], rank.to_numpy()[where], side="right") - 1
        nth, among = np.divmod(rank.to_numpy(np.int64) - firsts[at], sequences[at])
        return pd.DataFrame({"sequence_id": bases[at] + among, "offset": offsets[at] + nth * own})

    n = blocks(spark)
    numbered = ranked(rows.withColumn("block", hash_block(F.col("order"), n)), ["size"], "block", ["order"])
    placed = numbered.withColumn("place", place("size", "rank"))
    return unwrapped(placed, pieces.columns, sequence_id=F.col("place.sequence_id"), offset=F.col("place.offset"))


def token_pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Token ids of whole texts and an end id, cut into pieces of at most ``capacity`` where they are longer.

    Per piece: doc_id, piece (from 0), start (ids of the document before it), length, ids (little-endian unsigned
    32-bit). A longer document gives one shorter piece, the first, and then full ones. Null texts count as empty:
    one piece of the end id alone. Repeated rows are documents of their own.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).ids
        columns: tuple[list, ...] = ([], [], [], [], [])
        held = 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            out = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                ids = np.array(ids, "<u4")
                cut = len(ids) % capacity or capacity
                for piece, end in enumerate(range(cut, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    part = ids[start:end].tobytes()
                    for column, value in zip(columns, (doc, piece, start, end - start, part), strict=True):
                        column.append(value)
                    held += len(part) + 64
                    if held > FLUSH_BYTES:
                        held = 0
                        yield flush()
        yield flush()

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return in_small_batches(rows).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences, for training: sequence_id, length, ids of its pieces in order; each holds a capacity at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    whole = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit("").cast("binary"), lambda x, p: F.concat(x, p["ids"])).alias("ids"),
    )


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, then pack: doc_id, piece, start, length, ids_crc32 of the piece's ids, sequence_id, offset.

    The ids are read once for their checksum and stay where they are; only the slim rows are written between the
    two steps, as both the counts and the ranks read them.
    """
    pieces = token_pieces(docs, path, capacity)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stage(slim, "pieces"), capacity)
