"""Ranked lexical search, term at a time with limited accumulators (operator 13)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import named
from auditframe.session import discard, stage

#: Distinct terms of the items of one block, the size of what tasks are sent. Each block is one job over the index.
BLOCK_TERMS = 100_000
#: Documents whose postings a task holds at once.
CHUNK = 8192

#: Bytes of terms: digits, letters and all of characters beyond ASCII; A-Z become a-z, everything else ends a term.
_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return text.encode().translate(_BYTES).split() if text else []


def blocks_of_items(items: DataFrame, most: int) -> Iterator[tuple[list[int | None], list[list[int]], dict[bytes, int]]]:
    """Item ids, the numbers of their terms and the terms' numbers, in blocks of about ``most`` distinct terms.

    The driver streams through the items in the order of their ids and holds one block.
    """
    ids: list[int | None] = []
    found: list[dict[int, None]] = []
    vocabulary: dict[bytes, int] = {}
    for item, text in items.distinct().orderBy("item").toLocalIterator():
        if not ids or ids[-1] != item:
            if len(vocabulary) >= most:
                yield ids, [list(x) for x in found], vocabulary
                ids, found, vocabulary = [], [], {}
            ids.append(item)
            found.append({})
        for term in terms(text):
            found[-1][vocabulary.setdefault(term, len(vocabulary))] = None
    if ids:
        yield ids, [list(x) for x in found], vocabulary


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, text) to (id, n, terms, counts) of every text with at least one term; other terms only count in n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, numbers, counts = [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                held = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                ids.append(doc.as_py())
                lengths.append(len(words))
                numbers.append(np.array([t for t, _ in held], np.int32).tobytes())
                counts.append(np.array([c for _, c in held], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())],
                ["id", "n", "terms", "counts"],
            )

    return docs.mapInArrow(run, "id long, n long, terms binary, counts binary")


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of ``size`` terms is found; tasks count, only their counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), np.int32)
            total += np.bincount(held, minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["term", "df"])

    counted = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for term, df in counted.toLocalIterator():
        out[term] = df
    return out


class Ranking:
    """The k best documents of one item so far: by score, then the smaller id, those without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach to enter; 0 while there is room."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class Postings:
    """The postings of a chunk of documents: per term the documents and their contributions, ascending by document."""

    def __init__(self, numbers: np.ndarray, docs: np.ndarray, gains: np.ndarray):
        order = np.argsort(numbers, kind="stable")
        self.numbers, starts = np.unique(numbers[order], return_index=True)
        self.docs, self.gains = docs[order], gains[order]
        self.starts = np.append(starts, len(order))
        self.bounds = np.maximum.reduceat(self.gains, starts) if len(order) else np.zeros(0, np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of those ``wanted`` terms that have postings, in their order."""
        if not len(self.numbers):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.numbers, wanted), len(self.numbers) - 1)
        return at[self.numbers[at] == wanted]

    def list(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[at], self.starts[at + 1])
        return self.docs[part], self.gains[part]


def accumulate(postings: Postings, wanted: np.ndarray, total: np.ndarray, k: int, least: int) -> np.ndarray:
    """Documents that may be among the k best, their scores being left in ``total`` (zeros before).

    ``wanted`` are an item's terms, rarest first. A list may create accumulators as long as the lists from it on
    could together lift a new document to the k-th best score known: ``least`` of earlier chunks, or the k-th
    partial score of this one. A document that ties is still created. Afterwards lists only add to the
    accumulators there are, exactly.
    """
    places = postings.find(wanted)
    remaining = np.cumsum(postings.bounds[places][::-1])[::-1]
    survivors: np.ndarray | None = None
    for at, rest in zip(places, remaining, strict=True):
        docs, gains = postings.list(at)
        if survivors is None and (rest < least or (total.max(initial=0) > rest and rest < kth(total, k))):
            survivors = np.flatnonzero(total)
        if survivors is None:
            total[docs] += gains
        elif len(survivors):
            found = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
            hit = docs[found] == survivors
            total[survivors[hit]] += gains[found[hit]]
    return np.flatnonzero(total) if survivors is None else survivors


def local_rankings(index: DataFrame, ids: list[int | None], wanted: list[np.ndarray], weights: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """Each task's k best documents per item: (item, id, score)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                held.append(tuple(x.as_py() for x in row))
                if len(held) == CHUNK:
                    yield held
                    held = []
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankings = [Ranking(k) for _ in ids]
        for held in chunks(batches):
            keys = np.array([_NO_ID if doc is None else doc for doc, *_ in held], np.int64)
            lengths = np.array([words for _, words, _, _ in held], np.int64)
            numbers = np.frombuffer(b"".join(x for *_, x, _ in held), np.int32)
            counts = np.frombuffer(b"".join(x for *_, x in held), np.int32).astype(np.int64)
            docs = np.repeat(np.arange(len(held)), [len(x) // 4 for *_, x, _ in held])
            damped = 100 - 90 + (90 * lengths * n) // length
            gains = weights[numbers] * ((1_000_000_000 * counts) // (1000 * counts + 8 * damped[docs]))
            postings = Postings(numbers, docs, gains)
            total = np.zeros(len(held), np.int64)
            for ranking, numbers_of_item in zip(rankings, wanted, strict=True):
                may = accumulate(postings, numbers_of_item, total, k, ranking.least)
                best = may[total[may] >= max(1, ranking.least, kth(total[may], k))]
                ranking.add(total[best], keys[best])
                total[may] = 0
        out = [(item, doc, score) for item, r in zip(ids, rankings, strict=True) for doc, score in zip(r.ids.tolist(), r.scores.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        found = [None if doc == _NO_ID else doc for doc in columns[1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (columns[0], found, columns[2])], ["item", "id", "score"])

    return index.mapInArrow(run, "item long, id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z as a-z. A term's weight is
    floor(1000 * ln((2N + 2) / (2df + 1))); a document with tf occurrences adds weight * (10^9 tf div
    (1000 tf + 8m)), m = 10 + 90 n N div L, for each distinct term of the item. Only scores above 0 are ranked;
    ties go to the smaller id.

    The items of a block (``block_terms`` bounds what tasks are sent) meet all documents: texts are read once
    into a forward index of the block's terms, which is written; frequencies and lengths are counted over it; then each
    task ranks its own documents chunk by chunk, term at a time, and only its k best per item are shuffled.

    A null text has no terms. Rows of equal item id are one item with the terms of all its texts; items without
    terms, and items no document answers, have no rows. Every row of ``docs`` is a document of its own, also with an
    id that others have, or none, which ties last. Empty tables give an empty table.
    """
    rows = docs.select(named(id_column).cast("long").alias("id"), named(text_column).cast("string").alias("text"))
    asked = items.select(named(item_column).cast("long").alias("item"), named(item_text).cast("string").alias("text"))
    results: list[DataFrame] = []
    for ids, found, vocabulary in blocks_of_items(asked, block_terms):
        index = stage(forward_index(rows, vocabulary), "lexical-index")
        n, length = index.agg(F.count("*"), F.sum("n")).first()
        if n and vocabulary:
            df = document_frequencies(index, len(vocabulary))
            weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
            # Rarest first; equally rare ones in a fixed order.
            wanted = [np.array(sorted(x, key=lambda t: (df[t], t)), np.int64) for x in found]
            local = local_rankings(index, ids, wanted, weights, n, length, k)
            results.append(stage(best(local, k), "lexical-ranks"))
        discard(index)
    return union(results) if results else best(asked.select("item", F.col("item").alias("id"), F.col("item").alias("score")).limit(0), k)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    numbered = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return numbered.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def union(frames: Iterable[DataFrame]) -> DataFrame:
    first, *others = frames
    for more in others:
        first = first.unionByName(more)
    return first
