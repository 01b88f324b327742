"""Exact dedup by distributed radix partitioning on the most significant bytes (operator 9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import named, unwrapped, wrapped
from auditframe.session import discard, stage

#: Bytes of the first split; each further one looks at GROWTH times as many of the bytes that follow.
FIRST, GROWTH = 32, 64


def groups_of_equals(
    docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", carry: Sequence[str] | None = None,
    first: int = FIRST, growth: int = GROWTH,
) -> DataFrame:
    """The columns ``carry`` (default: all) with ``keep_id``, ``group_size`` and ``kept``, for every row.

    Documents are split by their length and first bytes, each group by the bytes that follow, and so on, until a
    group has one member or its texts have ended. Members of a group that ended agree in every byte, so no digest
    takes part. Texts of equal length and beginning are nearly always copies, so after the first split hardly any but these move. Documents leave as their groups settle; the table of the others is written between two splits, the one
    before it deleted, and shrinks, while the stretch of bytes looked at grows, so there are few splits even for very long texts.

    Groups are counted with partial sums before the shuffle. Those of several members are written, so that rows
    learn their group by a join of two scans, whose hot keys Spark splits. A group with a third of all rows is neither collected nor sorted in one task.

    Of equal texts the row with the largest id stays, a null id being the smallest; of several rows with that id
    one stays. Null texts count as empty. An empty table gives an empty table. Input columns named like the
    results are replaced.
    """
    names = list(docs.columns if carry is None else carry)
    held = list(dict.fromkeys([*names, text_column]))
    rows = wrapped(docs.select(*[named(c) for c in dict.fromkeys([*held, id_column])]))
    text = F.coalesce(F.col("row").getField(text_column).cast("string"), F.lit("")).cast("binary")
    active = rows.select("row", F.col("row").getField(id_column).cast("long").alias("id"), F.octet_length(text).cast("long").alias("group"))
    start, width, done, last = 0, first, [], None
    while True:
        piece = F.substring(text, start + 1, width)
        keyed = active.withColumn("piece", piece)
        members = [F.count("*").alias("members"), F.lit(None).cast("struct<id:bigint,back:bigint>").alias("best")]
        if done:
            members[1] = F.max(F.struct("id", (-F.col("number")).alias("back"))).alias("best")
        groups = keyed.groupBy("group", "piece").agg(*members).filter("members > 1")
        groups = stage(groups.withColumn("next", F.monotonically_increasing_id()), f"radix-groups-{start}")
        # Merged at every size: the plan, and what it moves, follow the input alone.
        joined = keyed.join(groups.hint("merge"), ["group", "piece"], "left").withColumn("members", F.coalesce("members", F.lit(1).cast("long")))
        # Rows get their numbers when the first split is written, so only single members can leave before.
        over = F.length("piece") < width if done else F.lit(False)
        settled = (F.col("members") == 1) | over
        row = F.col("row")
        if text_column not in names:
            row = row.withField(text_column, F.when(settled, F.lit(None)).otherwise(row.getField(text_column)))
        table = stage(
            joined.select(
                row.alias("row"), "id", F.col("next").alias("group"), "members", settled.alias("settled"),
                (F.col("number") if done else F.monotonically_increasing_id()).alias("number"),
                F.col("best.id").alias("best_id"), (-F.col("best.back")).alias("best_number"),
            ),
            f"radix-{start}", ["settled"],
        )
        # The rows that went on to this split now lie in its table.
        discard(groups)
        if last is not None:
            discard(last, part="settled=false")
        last = table
        done.append(table.filter("settled"))
        start, width = start + width, width * growth
        active = table.filter("not settled").select("row", "id", "number", "group")
        if active.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    alone = F.col("members") == 1
    return unwrapped(
        every.withColumn("row", F.struct(*[F.col("row").getField(c).alias(c) for c in names])), names,
        keep_id=F.when(alone, F.col("id")).otherwise(F.col("best_id")), group_size=F.col("members"),
        kept=alone | (F.col("number") == F.col("best_number")),
    )
