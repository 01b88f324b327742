"""Grouping helpers. ``by`` names the optional repository columns; ``()`` means one repository.

One repository may hold a third of all rows, so nothing here brings a whole group into one task:
aggregates combine before they shuffle, rankings cut to k rows before they shuffle, totals are joined
back instead of being spread by a window, and forward fills go by blocks of lines.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.session import stage, task_count

By = Sequence[str]


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: By = (), rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their rank.

    Without groups this plans as a bounded heap per task. With groups Spark limits each group to k rows
    per task before the shuffle (``WindowGroupLimit``), so a hot group costs no more than any other.
    """
    if not by:
        df = df.orderBy(*order).limit(k)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_k_distinct(df: DataFrame, k: int, value: str, by: By, rank: str = "rank") -> DataFrame:
    """The first k distinct values of each group, with their rank; ``df`` has no other columns.

    Each task drops the rows beyond its own first k values before the shuffle (``WindowGroupLimit``), so distinct
    values are not shuffled to be counted. Repeated rows of these k do pass: make values that repeat by construction
    distinct before.
    """
    window = Window.partitionBy(*by).orderBy(F.asc(value))
    return df.withColumn(rank, F.dense_rank().over(window)).filter(F.col(rank) <= k).distinct()


def join_on(left: DataFrame, right: DataFrame, keys: By, how: str = "inner") -> DataFrame:
    """Equi-join on columns both sides have; keys are never NULL (see ``schemas``).

    Plain equality lets a side that was grouped by the same keys keep its partitioning, where a
    NULL-safe comparison would shuffle it once more.
    """
    return left.join(right, list(keys), how)


def join_large(left: DataFrame, right: DataFrame, keys: By, how: str = "inner") -> DataFrame:
    """``join_on`` for two sides that both grow with the input: neither passes the driver whole.

    Spark judges a side by the compressed bytes of the files behind it, which say nothing of the texts that a view
    makes of its rows or the rows that a text explodes into, and sends what looks small to every task.
    """
    return join_on(left, right.hint("merge"), keys, how)


#: Left rows that ``join_product`` lays side by side: a multiple of eight, so that the packed numbers of one run are the
#: same bytes as those of the next, and short, so that many runs lie in what a Parquet page's codec looks back on.
RUN = 64
#: Pairs of one cell of ``join_product``, and of one of its tasks. The values of a task's cells fit a Parquet dictionary.
CELL_PAIRS, TASK_PAIRS = 1 << 22, 1 << 25


def join_product(left: DataFrame, right: DataFrame, keys: By, value: str, spread_by: str) -> DataFrame:
    """Inner equi-join of sides that share few keys, all pairs of a key; ``value``, never NULL, is what ``left`` adds.

    The pairs are far more than the rows of the sides, which are staged to count them. The bytes of the sides do not tell
    the work, and one key may hold most of it: both sides of a key are cut into slices, the left by ``value`` and the right
    by ``spread_by``, and each pair of slices is a cell that is joined on its own, by tasks as many as the pairs ask for.
    And the rows should be small where they are written: runs of left rows are joined as one and unfolded last, so that a
    right row comes ``RUN`` times and the next one with the same run, which columnar files hold in a fraction of a byte.
    """
    left, right = stage(left.select(*keys, value), "product-left"), stage(right, "product-right")
    counts = [side.groupBy(*keys).agg(F.count("*").alias(name)) for side, name in ((left, "__l"), (right, "__r"))]
    pairs = stage(join_large(*counts, keys).select(*keys, (F.col("__l") * F.col("__r")).alias("__pairs")), "product-pairs")
    wanted = math.ceil((pairs.agg(F.sum("__pairs")).first()[0] or 0) / TASK_PAIRS)
    tasks = max(task_count(left.sparkSession), wanted)
    slices = pairs.select(*keys, F.ceil(F.sqrt(F.col("__pairs") / CELL_PAIRS)).cast("int").alias("__slices"))

    def cut(side: DataFrame, column: str, name: str) -> DataFrame:
        own = F.pmod(F.xxhash64(column), F.col("__slices")).cast("int")
        return join_large(side, slices, keys).withColumn(name, own)

    others = F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))
    placed = cut(left, value, "__left")
    number = F.row_number().over(Window.partitionBy(*keys, "__left").orderBy(value))
    runs = placed.withColumn("__run", F.floor((number - 1) / RUN)).groupBy(*keys, "__left", "__run")
    runs = runs.agg(F.collect_list(value).alias("__values"), F.max("__slices").alias("__slices"))
    runs = runs.withColumn("__right", others).drop("__run", "__slices")
    rows = cut(right, spread_by, "__right").withColumn("__left", others).drop("__slices")
    cell = [*keys, "__left", "__right"]
    # A stated number of partitions stays; Spark would merge them by their bytes otherwise.
    joined = join_large(runs.repartition(tasks, *cell), rows.repartition(tasks, *cell), cell)
    return joined.withColumn(value, F.explode("__values")).drop("__values", "__left", "__right")


def join_groups(left: DataFrame, right: DataFrame, by: By, how: str = "left") -> DataFrame:
    """Add the columns of ``right``, which has one row per group, to ``left``.

    Without groups ``right`` is one row and becomes a scalar subquery rather than a join.
    """
    if by:
        return join_on(left, right, by, how)
    row = right.select(F.struct(*right.columns).alias("r")).scalar()
    added = [F.col(f"__row.{c}").alias(c) for c in right.columns]
    return left.withColumn("__row", row).select(*left.columns, *added)


def with_totals(df: DataFrame, sums: Mapping[str, str], by: By = ()) -> DataFrame:
    """Add sums of a group to each of its rows, by the name of the new column; ``df`` is a table of counts.

    Totals are joined back. Every row has its group's total, so the join is an inner one: both of its sides then ask
    for the same rows of ``df``, and Spark runs the aggregate that makes them, scan and shuffle, only once.
    """
    totals = df.groupBy(*by).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    return join_groups(df, totals, by, how="inner")


def with_total(df: DataFrame, value: str, by: By = (), name: str = "total") -> DataFrame:
    """Add the group's sum of ``value`` to every row."""
    return with_totals(df, {name: value}, by)


def share(part: Column, whole: Column) -> Column:
    """Percentage, 0 where there is nothing to share."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100


def forward_fill(
    df: DataFrame, value: str, order: str, by: By, filled: str, block: int = 100_000
) -> DataFrame:
    """Carry the last non-NULL ``value`` forward along ``order``, an integer, within each group.

    Two levels keep a long group apart: the last value of each block of lines is carried over the
    blocks, then each block is filled on its own.
    """
    df = df.withColumn("__block", F.floor(F.col(order) / block))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    blocks = df.groupBy(*by, "__block").agg(last.alias("__last"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "__block", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    within = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_groups(df, blocks, [*by, "__block"])
    return joined.withColumn(
        filled, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("__carried"))
    ).drop("__block", "__carried")
