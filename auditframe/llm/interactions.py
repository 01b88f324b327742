"""How filters applied one after another hide and repeat each other (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.session import discard, stage

#: What a leaf holds: rows, good rows, toxic rows.
Weight = tuple[int, int, int]
ZERO: Weight = (0, 0, 0)


def plain_changes(count: int) -> Iterator[int]:
    """Places i whose swap of i and i + 1 leads, one after another, through all orders of ``count`` things."""
    if count < 2:
        return
    inner, up = plain_changes(count - 1), False
    while True:
        # The last thing walks through the others; at each end they make one change of their own.
        yield from range(count - 1) if up else range(count - 2, -1, -1)
        change = next(inner, None)
        if change is None:
            return
        up = not up
        yield change + 1 if up else change


class Diagram:
    """A decision diagram over failure bits whose nodes carry the weight below them.

    A node is (passed, failed, weight); the leaves are weights. Equal nodes are one object, and what no row
    reaches is the empty node of its height. Each level tests one variable.
    """

    def __init__(self, variables: Sequence[str], leaves: Mapping[int, Weight]):
        self.order = list(variables)
        self.known: dict[tuple, tuple] = {}
        self.root = self._build(0, 0, leaves)

    def node(self, passed, failed) -> tuple:
        key = (id(passed), id(failed))
        if key not in self.known:
            weight = tuple(a + b for a, b in zip(self.weight(passed), self.weight(failed), strict=True))
            self.known[key] = ("node", passed, failed, weight)
        return self.known[key]

    def leaf(self, weight: Weight) -> tuple:
        return self.known.setdefault(("leaf", weight), ("leaf", weight))

    @staticmethod
    def weight(node: tuple) -> Weight:
        return node[-1]

    def _build(self, level: int, mask: int, leaves: Mapping[int, Weight]) -> tuple:
        if level == len(self.order):
            return self.leaf(leaves.get(mask, ZERO))
        return self.node(self._build(level + 1, mask, leaves), self._build(level + 1, mask | 1 << level, leaves))

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next one; only nodes of these two levels change."""
        done: dict[int, tuple] = {}

        def rebuilt(node: tuple, depth: int) -> tuple:
            if id(node) not in done:
                _, passed, failed, _ = node
                if depth < level:
                    done[id(node)] = self.node(rebuilt(passed, depth + 1), rebuilt(failed, depth + 1))
                else:
                    done[id(node)] = self.node(self.node(passed[1], failed[1]), self.node(passed[2], failed[2]))
            return done[id(node)]

        self.root = rebuilt(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, Weight, Weight, int]]:
        """Along the all-pass path: variable, weight kept, weight removed, rows that fail this variable only."""
        node = self.root
        while node[0] == "node":
            _, passed, failed, _ = node
            only = failed
            while only[0] == "node":
                only = only[1]
            yield self.order[self._depth(node)], self.weight(passed), self.weight(failed), self.weight(only)[0]
            node = passed

    def _depth(self, node: tuple) -> int:
        height = 0
        while node[0] == "node":
            node, height = node[1], height + 1
        return len(self.order) - height


STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def part_steps(part: str, variables: Sequence[str], leaves: Mapping[int, Weight]) -> pd.DataFrame:
    """All orders of the filters of one part, each reached from the one before by swapping two levels."""
    diagram, rows = Diagram(variables, leaves), []
    changes = plain_changes(len(variables))
    while True:
        name = "".join(diagram.order)
        for step, (letter, kept, removed, only) in enumerate(diagram.steps(), 1):
            rows.append((part, name, step, letter, kept[0], removed[0], only, removed[1], removed[2]))
        level = next(changes, None)
        if level is None:
            break
        diagram.swap(level)
    out = pd.DataFrame(rows, columns=["part", "filter_order", "step", "letter", "kept", "removed", "unique_fails", "good_lost", "toxic_lost"])
    # A filter in the first place removes all that fail it.
    failing = out[out.step == 1].groupby("letter").removed.first()
    out["redundant"] = out.letter.map(failing) - out.removed
    out["shapley"] = out.groupby("letter").removed.transform("sum")
    return out[[c.split()[0] for c in STEPS.split(", ")]]


def interactions(masks: DataFrame, variables: Sequence[str]) -> DataFrame:
    """From (part, mask, n, good, toxic) to one row per part, order of the filters and step.

    Bit i of ``mask`` says that rows fail filter ``variables[i]``; n, good and toxic count them, and rows of equal
    part and mask are added up. A part has at most 2 ** len(variables) masks, so each is one small group. Every
    order is there, with zeros. A null part is the empty string; without rows there are no parts.
    """
    names = list(variables)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")]
    counts = masks.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(*sums)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        leaves = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in group.itertuples()}
        return part_steps(group.part.iloc[0], names, leaves)

    return counts.groupBy("part").applyInPandas(run, STEPS)


def failure_masks(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], repeats: str, part_column: str = "lang",
    text_column: str = "text", id_column: str = "doc_id",
) -> tuple[DataFrame, list[str]]:
    """(part, mask, n, good, toxic) of all rows of ``docs``, and the filters' names by bit.

    ``filters`` are conditions on ``docs`` that are true (not null) where a row fails. One more filter of the name
    ``repeats`` fails for texts that are identical to the text of any smaller id, whatever their parts; a null
    text is an empty one. Texts are identical when SHA-256 and byte length agree. A row without an id is no
    repeat, and nothing repeats it; rows of equal id and text do not repeat each other. A row is good if any row of
    ``labels`` with its id has quality 1, toxic if any has toxic 1; without a label it is neither.

    Texts are read once and never shuffled: rows leave as (id, part, mask, digest), equal ones counted before the
    shuffle. Which rows of a group of copies are the first follows from minima with partial sums, so a group of a third of all
    rows meets in no task; only one row per text and part is compared afterwards.
    """
    names = [*filters, repeats]
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(filters.values())), F.lit(0))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("bytes"),
    )
    counted = slim.groupBy("id", "part", "mask", "digest", "bytes").agg(F.count("*").alias("n"))
    marks = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "is_good"), ("toxic", "is_toxic"))]
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*marks)
    with_id = counted.filter("id is not null").join(marked, "id", "left")
    without = counted.filter("id is null").withColumns({"is_good": F.lit(0), "is_toxic": F.lit(0)})
    rows = with_id.unionByName(without)
    rows = stage(rows.fillna(0, ["is_good", "is_toxic"]), "failures")
    totals = [F.sum(c).alias(name) for name, c in (("n", F.col("n")), ("good", F.col("n") * F.col("is_good")), ("toxic", F.col("n") * F.col("is_toxic")))]
    every = rows.groupBy("part", "mask").agg(*totals)
    # Equal texts of equal part differ only in their ids and what labels say of these.
    first = F.min(F.struct("id", "n", "is_good", "is_toxic")).alias("first")
    heads = rows.filter("id is not null").groupBy("digest", "bytes", "part", "mask").agg(first)
    heads = heads.withColumn("least", F.expr("min(first.id) over (partition by digest, bytes)")).filter("first.id = least")
    firsts = heads.select("part", "mask", "first.n", "first.is_good", "first.is_toxic")
    firsts = firsts.unionByName(rows.filter("id is null").select(*firsts.columns)).groupBy("part", "mask").agg(*totals)
    again = 1 << len(filters)
    minus = firsts.select("part", F.col("mask").bitwiseOR(F.lit(again)).alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    repeated = every.withColumn("mask", F.col("mask").bitwiseOR(F.lit(again)))
    counts = stage(firsts.unionByName(repeated).unionByName(minus), "failure-counts")
    discard(rows)
    return counts, names
