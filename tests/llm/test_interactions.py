"""Filter interactions against counting row by row, in every order."""

from __future__ import annotations

from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from auditframe.llm import interactions


def filters():
    text = F.coalesce("text", F.lit(""))
    return {"A": F.length(text) < 10, "B": text.contains("one")}


def brute_force(rows, labels):
    """rows: (id, text, part); labels: id to (good, toxic). All orders of A, B and E, one document at a time."""
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    out, parts = {}, {part or "" for *_, part in rows}
    for part in parts:
        docs = []
        for i, text, own in rows:
            if (own or "") == part:
                text = text or ""
                fails = {c for c, bad in (("A", len(text) < 10), ("B", "one" in text), ("E", i is not None and i > smallest[text])) if bad}
                docs.append((fails, *labels.get(i, (0, 0))))
        shapley = defaultdict(int)
        for order in permutations("ABE"):
            left = docs
            for step, letter in enumerate(order, 1):
                gone, left = [d for d in left if letter in d[0]], [d for d in left if letter not in d[0]]
                shapley[letter] += len(gone)
                failing = sum(letter in d[0] for d in docs)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(d[0] == {letter} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)
                ]
        for (own, order, step), values in out.items():
            if own == part:
                values.append(shapley[order[step - 1]])
    return out


def measured(docs, labels):
    masks, names = interactions.failure_masks(docs, labels, filters(), repeats="E")
    assert names == ["A", "B", "E"]
    found = interactions.interactions(masks, names).collect()
    got = {(r.part, r.filter_order, r.step): [*r[3:]] for r in found}
    assert len(got) == len(found)
    return got


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_plain_changes_reach_every_order_by_neighbouring_swaps():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in interactions.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))


def test_swapped_diagram_equals_a_new_one():
    leaves = {m: (m * m % 7, m % 3, m % 2) for m in range(16)}
    diagram = interactions.Diagram("ABCD", leaves)
    for level in interactions.plain_changes(4):
        diagram.swap(level)
        moved = {
            sum(1 << diagram.order.index(v) for i, v in enumerate("ABCD") if m >> i & 1): weight for m, weight in leaves.items()
        }
        assert list(diagram.steps()) == list(interactions.Diagram(diagram.order, moved).steps())


def test_equal_parts_of_a_diagram_are_shared():
    diagram = interactions.Diagram("ABCDE", {0: (3, 0, 0)})
    assert len(diagram.known) == 2 + 5 + 4


def test_edge_cases_equal_brute_force(spark, edge):
    plain = [(r.doc_id, r.text, r.lang) for r in edge.collect()]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (None, 1, 1), (99, 1, 1), (7, 0, None)]
    marked = {1: (1, 0), 2: (1, 1), 4: (0, 1)}
    assert measured(edge, labels_of(spark, labels)) == brute_force(plain, marked)


def test_copies_across_parts_and_a_hot_text(spark, documents):
    rows = [(i, "one text that all share" if i % 3 else f"text of {i} alone", ("en", "de", None)[i % 3], "s") for i in range(120)]
    labels = labels_of(spark, [(i, i % 2, int(i % 5 == 0)) for i in range(120)])
    plain = [(i, text, lang) for i, text, lang, _ in rows]
    expected = brute_force(plain, {i: (i % 2, int(i % 5 == 0)) for i in range(120)})
    assert measured(documents(rows).repartition(7), labels) == expected
    # The smallest id of the shared text lies in one part; the copies of the other part are all repeats.
    assert expected["de", "EAB", 1][1] == len([i for i in range(120) if i % 3 == 1]) - 1
    assert expected["", "EAB", 1][1] == len([i for i in range(120) if i % 3 == 2])


def test_empty_tables(spark, empty, documents):
    assert measured(empty, labels_of(spark, [])) == {}
    assert measured(documents([(1, "one", None, None)]), labels_of(spark, []))["", "ABE", 1] == [0, 1, 0, 0, 0, 0, 3]
