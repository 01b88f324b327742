"""What several operators share: input rows, whole-row payloads, tokenizers, ranks that no group concentrates."""

from __future__ import annotations

import atexit
import base64
import json
import os
import shutil
import tempfile
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import auditframe

#: Words are runs of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of results that a task gathers before it hands them to Spark.
FLUSH_BYTES = 4 << 20
#: Session setting of Spark: bytes of rows that a task hands to Python at once, 64 MB where nobody sets it.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless they find it as this process does.

    Spark hands workers the driver's PYTHONPATH and working folder, but not what was added to ``sys.path``.
    """
    context, root = spark.sparkContext, Path(auditframe.__file__).resolve().parent.parent
    found = {str(Path(p or ".").resolve()) for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if str(root) in found or root.name.endswith("-packages") or f"{auditframe.__name__}.zip" in context._python_includes:
        return
    folder = tempfile.mkdtemp(prefix="package-")
    # The driver serves the file to executors as long as it lives.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/{auditframe.__name__}", "zip", root, auditframe.__name__))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def in_small_batches(texts: DataFrame) -> DataFrame:
    """The rows as they are; from now on the session hands them to Python in batches of about ``FLUSH_BYTES``.

    Spark's batches of 64 MB lie in the executor several times, outside its heap and in each worker. Functions over
    texts go from row to row, so they lose nothing by smaller ones. A limit that the session was given stays.
    """
    settings = texts.sparkSession.conf
    if settings.get(BATCH_BYTES, None) is None:
        settings.set(BATCH_BYTES, str(FLUSH_BYTES))
    return texts


def blocks(spark: SparkSession) -> int:
    """Into how many parts groups are split for ranking; follows the session's partitions, hence the data."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def named(column: str) -> Column:
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def wrapped(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole input row as one struct ``row`` beside working columns, so that no name of the input can clash."""
    row = F.struct(*[named(c) for c in df.columns]) if df.columns else F.struct(F.lit(None).alias("none"))
    return df.select(row.alias("row"), *[value.alias(name) for name, value in columns.items()])


def unwrapped(df: DataFrame, names: Iterable[str], **columns: Column) -> DataFrame:
    """The input columns again, then ``columns``; an input column of the same name gives way to the operator's."""
    taken = {c.lower() for c in columns}
    kept = [F.col("row").getField(c).alias(c) for c in names if c.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def ranked(df: DataFrame, keys: list[str], block: str, order: list[Column | str], rank: str = "rank") -> DataFrame:
    """Rank from 0 within ``keys`` by (``block``, ``order``), with no whole group in one task.

    A group is split by ``block``: rows are numbered within (keys, block), the sizes of the blocks are summed up
    before them, and the sum is added. ``keys`` and ``block`` must not be null. Only the counts, one row per key
    and block, meet by key.
    """
    counts = df.groupBy(*keys, block).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, block, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order)) - 1
    numbered = df.withColumn("__inside", inside).join(starts, [*keys, block])
    return numbered.withColumn(rank, (F.col("__start") + F.col("__inside")).cast("long")).drop("__start", "__inside")


def seeded(seed: int, *columns: Column) -> Column:
    """32 hexadecimal digits that order rows at random, the same in every run and engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hash_block(digits: Column, count: int) -> Column:
    """Which of ``count`` equal ranges of the seeded order a row falls into; blocks follow that order."""
    return F.floor(F.conv(F.substring(digits, 1, 8), 16, 10).cast("long") * count / F.lit(2**32)).cast("int")


def early(digits: Column, share: Column) -> Column:
    """Whether a row is within the first ``share`` of the seeded order: about that part of any table."""
    return hash_block(digits, 2**31 - 1) <= share * (2**31 - 1)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the tokenizer file at ``path``, its special tokens read as such and none added.

    Where the vocabulary also lies beside it as ranks (``.tiktoken``), texts below LONG characters are encoded
    from these, at a quarter of the cost. That encoder ends the process on white space of about a million
    characters, so longer texts take the other one. Both give the same ids (tests compare them).
    """

    LONG = 200_000

    def __init__(self, path: str):
        self.path = path
        ranks = Path(path).with_suffix(".tiktoken")
        self._ranked = self._from_ranks(ranks) if ranks.exists() else None
        self._published = None

    def _from_ranks(self, path: Path):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        special = {t["content"]: t["id"] for t in json.loads(Path(self.path).read_text())["added_tokens"]}
        return tiktoken.Encoding(str(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @property
    def published(self):
        if self._published is None:
            from tokenizers import Tokenizer

            self._published = Tokenizer.from_file(self.path)
        return self._published

    def ids(self, text: str) -> list[int]:
        if self._ranked is None or len(text) >= self.LONG:
            return self.published.encode(text, add_special_tokens=False).ids
        return self._ranked.encode(text, allowed_special="all")

    def token_bytes(self) -> list[int]:
        """How many bytes of text each id stands for."""
        if self._ranked is None:
            raise ValueError(f"{self.path} needs its ranks beside it")
        return [len(self._ranked.decode_single_token_bytes(i)) for i in range(self._ranked.n_vocab)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Encoder:
    """One per process."""
    return Encoder(path)
