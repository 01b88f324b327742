"""Exact Jaccard join of word n-gram sets by set-relation skipping (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.llm.common import named
from auditframe.llm.sets import WordHashes, common, components, mixed, shingles
from auditframe.session import discard, stage

#: Words per shingle and the similarity of links, in hundredths.
WORDS, SIMILARITY = 3, 90
#: Part of the token order by whose frequencies sets are told apart that cannot have a partner: one in SPARSE hashes.
SPARSE = 4
#: Longs of a parity sketch of 64 bits each.
SKETCH = 8
#: Rounds in which sets are compared with a leader of their lists, and how similar a leader must be to answer for a set.
LEADER_ROUNDS, LEADING = 2, 70

_SALTS = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def prefix_length(n: Column, similarity: int) -> Column:
    """A set and one that is similar enough share a token among the first so many of each, in any order of all tokens."""
    return n - F.ceil(n * similarity / 100) + 1


def most_different(sizes: Column, similarity: int) -> Column:
    """The largest symmetric difference of linked sets by the sum of their sizes."""
    return F.floor(sizes * (100 - similarity) / (100 + similarity))


def digest(found: np.ndarray) -> list[int]:
    """128 bits that stand for a set: two sums of its independently mixed tokens."""
    return [int(mixed(found ^ salt).sum(dtype=np.uint64).astype(np.int64)) for salt in _SALTS]


def parity(found: np.ndarray) -> np.ndarray:
    """A bit per bucket, the parity of its tokens. Sketches differ in no more bits than sets differ in tokens."""
    buckets = (mixed(found) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(buckets, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def features(rows: DataFrame, words: int, similarity: int) -> DataFrame:
    """(id, text_key, text) to id, text_key, n, set_hi, set_lo and sparse: the tokens in the first part of the order."""
    edge = np.uint64(2**64 // SPARSE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            counts, his, los, sparse = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), words, known)
                hi, lo = digest(found)
                counts.append(len(found))
                his.append(hi)
                los.append(lo)
                # Smaller sets are linked with equal ones only.
                apart = len(found) * (100 - similarity) >= similarity
                sparse.append(found[: np.searchsorted(found, edge)].tobytes() if apart else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (counts, his, los)], pa.array(sparse, pa.binary())],
                ["id", "text_key", "n", "set_hi", "set_lo", "sparse"],
            )

    return rows.mapInArrow(run, "id long, text_key long, n long, set_hi long, set_lo long, sparse binary")


def token_rows(sets: DataFrame) -> DataFrame:
    """(class, n, tokens) to one row per token: class, n, token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, sizes = (batch.column(i).to_numpy() for i in range(2))
            held = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(2)]
            lengths = [len(x) for x in held]
            tokens = np.concatenate(held) if held else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(owners, lengths)), pa.array(np.repeat(sizes, lengths)), pa.array(tokens)], ["class", "n", "token"])

    return sets.mapInArrow(run, "class long, n long, token long")


def whole_sets(rows: DataFrame, words: int) -> DataFrame:
    """(class, n, text) to class, n, the whole sorted set and its parity sketch s0, s1, ..."""
    names = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingles(x.as_py(), words, known) for x in batch.column(2)]
            sketches = np.array([parity(x) for x in sets], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in sets], pa.binary()), *[pa.array(c) for c in sketches.T]],
                ["class", "n", "tokens", *names],
            )

    return rows.mapInArrow(run, "class long, n long, tokens binary, " + ", ".join(f"{x} long" for x in names))


@F.pandas_udf(T.StructType([T.StructField("minus", T.BinaryType()), T.StructField("plus", T.BinaryType())]))
def differences(leader: pd.Series, own: pd.Series) -> pd.DataFrame:
    """The tokens that the leader has and the set has not, and the other way round."""
    out = []
    for x, y in zip(leader, own, strict=True):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        out.append((np.setdiff1d(a, b, assume_unique=True).tobytes(), np.setdiff1d(b, a, assume_unique=True).tobytes()))
    return pd.DataFrame(out, columns=["minus", "plus"])


def alike(overlap: Column, n_a: Column, n_b: Column, similarity: int) -> Column:
    return 100 * overlap >= similarity * (n_a + n_b - overlap)


def possible_partners(reps: DataFrame, similarity: int) -> DataFrame:
    """The classes (of class, n, sparse) that may be linked with another one.

    All tokens have one order: those of the first part of the hashes by frequency, then the others. A class
    whose prefix holds only tokens that no other class has is linked with none. Rows of one partitioning serve
    the count of tokens and the join with it.
    """
    each = token_rows(reps.filter("length(sparse) > 0").select("class", "n", "sparse")).repartition("token")
    several = each.groupBy("token").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first < last")
    shared = each.join(several.select("token"), "token").groupBy("class").agg(F.count("*").alias("shared"))
    alone = F.length("sparse") / 8 - F.coalesce("shared", F.lit(0))
    apart = F.col("n") * (100 - similarity) >= similarity
    return reps.join(shared, "class", "left").filter(apart & (alone < prefix_length(F.col("n"), similarity)))


def index_lists(sets: DataFrame, similarity: int) -> DataFrame:
    """The lists of all tokens in prefixes that several classes have: token, the one before it, block, class, n and place.

    Tokens found in one class only come first, then the rarer before the more frequent. A list is cut into blocks of
    sizes, each ``similarity`` of the next: linked sets are in one or in neighbouring blocks.
    """
    each = token_rows(sets.select("class", "n", "tokens")).repartition("token")
    several = each.groupBy("token").agg(F.count("n").alias("frequency"), F.min("class").alias("first"), F.max("class").alias("last"))
    several = several.filter("first < last").select("token", "frequency")
    met = each.join(several, "token").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("frequency", "token"))).alias("met"))
    own = F.col("n") - F.size("met")
    first = (prefix_length(F.col("n"), similarity) - own).cast("int")
    prefix = F.slice("met", F.lit(1), first)["token"]
    follows = F.transform(prefix, lambda token, i: F.struct(token.alias("token"), F.get(prefix, i - 1).alias("before")))
    heads = met.withColumn("own", own).filter(first > 0).select("class", "n", "own", F.posexplode(follows))
    block = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity / 100)).cast("int")
    return heads.select("col.token", "col.before", block.alias("block"), "class", "n", (F.col("own") + F.col("pos")).alias("place"))


def distance(one: str = "", other: str = "") -> Column:
    """In how many bits two sketches differ: at most the tokens that their sets differ in."""
    return sum((F.bit_count(F.col(f"{one}s{i}").bitwiseXOR(F.col(f"{other}s{i}"))) for i in range(SKETCH)), F.lit(0))


def renamed(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(F.col("class").alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in nodes.columns if c != "class"])


def labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("component", F.col("class"))
    return lists.join(labels.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def led(lists: DataFrame, labels: DataFrame | None, nodes: DataFrame, sets: DataFrame, round_: int) -> DataFrame:
    """Every class with the nearest leader of its list blocks: class, leader, n_class, n_leader, minus, plus.

    One class leads each block of a list that still holds several components. A class goes to the leader whose
    sketch is nearest, if it may be similar by LEADING, so there is one comparison of whole sets per class.
    """
    current = labelled(lists, labels)
    first = F.min(F.struct(F.xxhash64("class", F.lit(round_)).alias("order"), F.col("class").alias("leader"), F.col("component").alias("of")))
    leaders = current.groupBy("token", "block").agg(first.alias("first"), F.min("component").alias("low"), F.max("component").alias("high"))
    leaders = stage(leaders.filter("low < high").select("token", "block", "first.leader", "first.of"), f"leaders-{round_}")
    met = current.join(leaders, ["token", "block"]).filter("component <> of").select("class", "leader").distinct()
    sketched = met.join(renamed(nodes, "a"), F.col("class") == F.col("a")).join(renamed(nodes, "b"), F.col("leader") == F.col("b"))
    sketched = sketched.withColumn("distance", distance("a_", "b_"))
    near = sketched.filter(F.col("distance") <= most_different(F.col("a_n") + F.col("b_n"), LEADING))
    nearest = F.min(F.struct((F.col("distance") / (F.col("a_n") + F.col("b_n"))).alias("share"), "leader", F.col("b_n").alias("n_leader"))).alias("best")
    chosen = near.groupBy("class", F.col("a_n").alias("n_class")).agg(nearest).select("class", "n_class", "best.leader", "best.n_leader")
    one = sets.select("class", F.col("tokens").alias("own"))
    other = sets.select(F.col("class").alias("leader"), F.col("tokens").alias("led"))
    both = chosen.join(one, "class").join(other, "leader").withColumn("d", differences("led", "own"))
    found = stage(both.select("class", "leader", "n_class", "n_leader", "d.minus", "d.plus"), f"led-{round_}")
    discard(leaders)
    return found


def open_pairs(lists: DataFrame, labels: DataFrame | None, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (x, y) of different components that lists, places, sizes and sketches do not exclude.

    The smaller set of a pair, x, must share a token so early that enough follow: later blocks of its places are
    skipped, before any pair is made. Of tokens that follow one another in both sets only the first makes a pair: what
    holds for it holds for the ones before. Every linked pair of different components is among the result.
    """
    current = labelled(lists, labels)
    several = current.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    current = current.join(several.select("token"), "token").join(nodes.drop("n"), "class")
    early = F.col("place") <= F.col("n") - F.ceil(2 * similarity * F.col("n") / (100 + similarity))
    # Places of the larger set may be later; its block is that of the smaller one or the next.
    smaller = renamed(current.filter(early).withColumn("block", F.explode(F.array("block", F.col("block") + 1))), "x")
    larger = renamed(current, "y")
    sizes = F.col("x_n") + F.col("y_n")
    rest = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    fits = (
        (F.struct("x_n", "x") < F.struct("y_n", "y")) & (F.col("x_component") != F.col("y_component"))
        & (100 * F.col("x_n") >= similarity * F.col("y_n")) & ((100 + similarity) * rest >= similarity * sizes)
        & F.coalesce(F.col("x_before") != F.col("y_before"), F.lit(True)) & (distance("x_", "y_") <= most_different(sizes, similarity))
    )
    on = (F.col("x_token") == F.col("y_token")) & (F.col("x_block") == F.col("y_block"))
    return smaller.join(larger, on & fits).select("x", "y", F.col("x_n").alias("n_x"), F.col("y_n").alias("n_y")).distinct()


def derived(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs with ``overlap`` where one leader answers for both: from their small differences to it, exactly.

    Of the leader's tokens both have those that neither lacks; beyond them, those that both have and it has not.
    """
    one = answers.select(F.col("class").alias("x"), "leader", "n_leader", F.col("minus").alias("minus_x"), F.col("plus").alias("plus_x"))
    other = answers.select(F.col("class").alias("y"), "leader", F.col("minus").alias("minus_y"), F.col("plus").alias("plus_y"))
    both = pairs.join(one, "x").join(other, ["y", "leader"]).dropDuplicates(["x", "y"])
    lacking = F.length("minus_x") / 8 + F.length("minus_y") / 8 - common("minus_x", "minus_y")
    return both.select("x", "y", "n_x", "n_y", (F.col("n_leader") - lacking + common("plus_x", "plus_y")).cast("long").alias("overlap"))


def labels_of(links: DataFrame, name: str) -> DataFrame | None:
    return None if links.isEmpty() else components(links, name)


def connected(links: DataFrame, labels: DataFrame | None, new: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Links and labels after ``new`` links (written); nothing is done where there are none."""
    if new.isEmpty():
        return links, labels
    links = links.unionByName(new)
    return links, components(links, name)


def links_by_lists(
    whole: DataFrame, links: DataFrame, labels: DataFrame | None, similarity: int, rounds: int = LEADER_ROUNDS
) -> tuple[DataFrame | None, list[DataFrame]]:
    """Labels (id, component) of the classes after all links among ``whole`` were found, and tables to discard.

    ``whole`` has class, n, tokens and the sketch; ``links`` (a, b) and ``labels`` are what is known before. No link
    between different components of the result exists.
    """
    if whole.isEmpty():
        return labels, []
    nodes, sets = whole.drop("tokens"), whole.select("class", "n", "tokens")
    lists = stage(index_lists(sets, similarity), "set-lists")
    spent, answers = [lists], None
    for round_ in range(rounds):
        found = led(lists, labels, nodes, sets, round_)
        spent.append(found)
        answers = found if answers is None else answers.unionByName(found)
        overlap = F.col("n_class") - F.length("plus") / 8
        new = found.filter(alike(overlap, F.col("n_class"), F.col("n_leader"), similarity))
        new = new.select(F.col("leader").alias("a"), F.col("class").alias("b"))
        links, labels = connected(links, labels, new, f"set-components-{round_}")
    pairs = stage(open_pairs(lists, labels, nodes, similarity), "set-pairs")
    spent.append(pairs)
    if pairs.isEmpty():
        return labels, spent
    known = stage(derived(pairs, answers), "set-derived")
    first, second = (sets.select(F.col("class").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in ("x", "y"))
    fetched = pairs.join(known.select("x", "y"), ["x", "y"], "left_anti").join(first, "x").join(second, "y")
    fetched = fetched.select("x", "y", "n_x", "n_y", common("tokens_x", "tokens_y").alias("overlap"))
    late = known.unionByName(fetched).filter(alike(F.col("overlap"), F.col("n_x"), F.col("n_y"), similarity))
    late = stage(late.select(F.col("x").alias("a"), F.col("y").alias("b")), "set-late")
    return connected(links, labels, late, "set-components-last")[1], [*spent, known, late]


def classes_of(linkable: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, text_key, n, set_hi, set_lo): classes of equal sets, the rows' classes, and links of classes of one id.

    A class is represented by its smallest id. Everything is written: Spark splits the hot keys of a join of two scans.
    """
    same = ["set_hi", "set_lo", "n"]
    rep = F.min(F.struct("id", "text_key")).alias("rep")
    classes = linkable.groupBy(*same).agg(rep).select(*same, "rep.*", F.monotonically_increasing_id().alias("class"))
    classes = stage(classes, f"{name}-classes")
    members = linkable.select("id", *same).join(classes.select(*same, "class"), same).select("id", "n", "class")
    members = stage(members, f"{name}-members")
    per_id = members.groupBy("id").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high")
    per_id = stage(per_id.select("id", "low"), f"{name}-ids")
    links = members.join(per_id, "id").filter("class > low").select(F.col("low").alias("a"), F.col("class").alias("b"))
    links = stage(links, f"{name}-links")
    discard(per_id)
    return classes, members, links


def by_component(classes: DataFrame, members: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
    """(id, n, component_id) of every row: the smallest id among the classes that are connected with its own."""
    of_class = labelled(classes.select("class", "id"), labels)
    least = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = stage(of_class.join(least, "component").select("class", "component_id"), f"{name}-labels")
    return members.join(of_class, "class").select("id", "n", "component_id")


def linked_sets(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, text_column: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of the input.

    Documents whose shingle sets have 100 * intersection >= similarity * union are linked; component_id is the
    smallest id reachable by links. Exact: no link between different components is missed, though not all pairs
    are made.

    1. Equal sets form a class. Classes that share no token of their prefixes are left out, by a part of the tokens.
    2. The others enter an index: lists of the tokens of their prefixes, rarest first, cut into blocks by size,
       with the token's place in each set.
    3. Some rounds compare every class with a leader of its list blocks, whose links make components. The
       differences to the leader are kept.
    4. What lists still hold of different components is paired, skipping blocks by place and size and pairs by
       sketch. Where both sets have the same leader, the answer follows from their differences to it; only for other
       pairs are whole sets fetched.

    Letters A-Z count as a-z; words are divided by ASCII white space. A text with fewer words than a shingle has
    one shingle, its whole sequence; without words or text it has none and is linked with nothing. Rows of equal id
    count as one document with the links of all its texts. A row without an id is linked with nothing; its component is
    null. Other columns are left out. An empty table gives an empty table.
    """
    text = named(text_column).cast("string")
    rows = docs.select(named(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    seen = stage(features(rows, words, similarity), "set-features")
    same = ["set_hi", "set_lo", "n"]
    linkable = seen.filter("n > 0 and id is not null")
    classes, members, links = classes_of(linkable, "set")
    # One shuffle serves both the removal of repeated rows and the join. What comes of it is written, so that the
    # two readers of its tokens have the same plan and share their partitioning.
    once = linkable.dropDuplicates(["id", "text_key", *same])
    sparse = once.join(classes.select("class", "id", "text_key", *same), ["id", "text_key", *same])
    sparse = stage(sparse.select("class", "n", "id", "text_key", "sparse"), "set-sparse")
    others = stage(seen.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")), "set-unlinked")
    active = stage(possible_partners(sparse, similarity).select("class", "n", "id", "text_key"), "set-active")
    discard(seen, sparse)
    whole = rows.join(active, ["id", "text_key"]).select("class", "n", "text")
    whole = stage(whole_sets(whole, words).dropDuplicates(["class"]), "whole-sets")
    labels, spent = links_by_lists(whole, links, labels_of(links, "set-components"), similarity)
    result = by_component(classes, members, labels, "set")
    discard(*spent, active, whole, classes)
    return result.unionByName(others).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
