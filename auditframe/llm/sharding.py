"""Sharding by proportional stratified interleaving (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import blocks, hash_block, ranked, seeded, unwrapped, wrapped

SHARDS = 24


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: int = 10, source_column: str = "source", id_column: str = "doc_id",
    tie: Column | None = None,
) -> DataFrame:
    """Every input column, ``shard`` (from 0) and ``slot`` (gapless from 0 within its shard).

    Rows of a source are shuffled by a seeded hash of the id and ranked; a row's place in the corpus is its rank
    over the size of its source. Sorted by that fraction the corpus is an even interleaving of its sources, and
    any cut of it has their mixture: shards are cuts of equal length, row counts differ by one at most.

    Neither the ranks of a hot source nor the global order pass through one task: ranks are made within blocks of
    the hash, the order within blocks of the fraction, and only the sizes of blocks meet. Null sources form a
    source. ``tie`` orders rows of equal id; rows equal in it too are interchangeable. An empty table gives an
    empty table. Equal texts are rows like any other: no group of them is kept together, so a group of any size spreads
    over the shards and none grows by it. Input columns named ``shard`` or ``slot`` are replaced.
    """
    n = blocks(docs.sparkSession)
    source = F.col(f"`{source_column}`").cast("string")
    rows = wrapped(
        docs, key=F.coalesce(F.concat(F.lit("="), source), F.lit("")), order=seeded(seed, F.col(f"`{id_column}`")),
        tie=F.lit(0) if tie is None else tie,
    )
    sizes = rows.groupBy("key").agg(F.count("*").alias("source_rows"))
    sizes = sizes.withColumn("total", F.sum("source_rows").over(Window.partitionBy()))
    within = ranked(rows.withColumn("block", hash_block(F.col("order"), n)), ["key"], "block", ["order", "tie"]).drop("block")
    within = within.join(sizes, "key").withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("source_rows")))
    cut = F.least(F.floor(F.col("fraction") * n), F.lit(n - 1)).cast("int")
    spread = within.drop("rank").withColumn("cut", cut).withColumn("all", F.lit(0))
    placed = ranked(spread, ["all"], "cut", ["fraction", "key", "order", "tie"], "place")
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards} div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return unwrapped(placed, docs.columns, shard=F.col("shard"), slot=F.col("place") - first)


def write_shards(sharded: DataFrame, path: str, **options: str) -> None:
    """One folder per shard under ``path``, rows in the order of their slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.options(**options).partitionBy("shard").parquet(path)
