from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditframe.llm import packing
from auditframe.llm.common import default_tokenizer, tokenizer
from auditframe.llm.queries import op2_best_fit_packing


def unfold(slots):
    """Every piece of a plan: (length, rank) to (sequence, offset)."""
    places = {}
    for s in slots:
        for j in range(s.sequences * s.repeat):
            nth, among = divmod(j, s.sequences)
            assert (s.length, s.first + j) not in places
            places[s.length, s.first + j] = (s.base + among, s.offset + nth * s.length)
    return places


def check(lengths, places, capacity):
    """All pieces placed, and sequences gapless within the capacity."""
    by = {}
    for (length, _), (sequence, offset) in places.items():
        by.setdefault(sequence, []).append((offset, length))
    assert sorted(length for length, _ in places) == sorted(lengths)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_whole(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    n = check(lengths, unfold(packing.plan(counts, 40)), 40)
    assert n >= -(-sum(lengths) // 40)


def test_exact_complements():
    assert check([30, 10], unfold(packing.plan({30: 1, 10: 1}, 40)), 40) == 1
    assert check([30, 4, 6], unfold(packing.plan({30: 1, 4: 1, 6: 1}, 40)), 40) == 1
    assert check([30, 2, 3, 5], unfold(packing.plan({30: 1, 2: 1, 3: 1, 5: 1}, 40)), 40) == 1
    index = packing.Complements(np.array([0, 1, 0, 2, 0, 1]))
    assert index.exact(4) == (3, 1) and sorted(index.exact(5)) == [5] and index.exact(2) == ()


def test_near_the_bound():
    rng = random.Random(1)
    lengths = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    n = check(lengths, unfold(packing.plan(counts, 2048)), 2048)
    assert n <= -(-sum(lengths) // 2048) + 3


def test_edge_cases_and_clashes(spark, edge, empty):
    pieces = packing.token_pieces(edge)
    rows = packing.packed_documents(edge).toPandas()
    assert set(rows.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert rows[rows["doc_id"] == 3]["length"].tolist() == [1]
    assert pieces.count() == len(rows)
    assert packing.packed_documents(empty).count() == 0
    sized = edge.selectExpr("doc_id", "5 as length", "offset", "sequence_id")
    placed = packing.pack(sized, 8, order=["doc_id"])
    assert placed.columns == ["doc_id", "length", "sequence_id", "offset"] and placed.count() == edge.count()


def test_wrong_length_is_an_error(spark):
    with pytest.raises(Exception, match="piece length"):
        packing.pack(spark.createDataFrame([(1, 9)], "doc_id long, length int"), 8, order=["doc_id"]).count()


def test_query_and_sequences(spark, folder):
    rows = op2_best_fit_packing(spark, folder).toPandas()
    encode = tokenizer(default_tokenizer()).ids
    total = 0
    found = {(r.doc_id, r.piece): r for r in rows.itertuples()}
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.array([*encode(doc["text"] or ""), 0], "<u4")
        total += len(ids)
        pieces = [found[k] for k in sorted(k for k in found if k[0] == doc["doc_id"])]
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p.start == at and (p.length == 2048 or p.piece == 0)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    places = {(r.length, i): (r.sequence_id, r.offset) for i, r in enumerate(rows.itertuples())}
    assert check(rows["length"].tolist(), places, 2048) <= -(-total // 2048) + 3


def test_whole_sequences(spark, documents):
    docs = documents([(i, "a b c " * (i % 7), None, None) for i in range(40)])
    placed = packing.pack(packing.token_pieces(docs, capacity=32), 32)
    whole = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        own = whole[r["sequence_id"]]
        assert own["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole.values())


def test_same_ids_as_the_published_tokenizer():
    """The plain call: special tokens in a text are read as such, none is added."""
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokenizer(default_tokenizer()).ids
    step = 97
    for low in range(0, 0x20000, step):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)} .{chr(c)}." for c in range(low, low + step) if not 0xD800 <= c < 0xE000)
        assert other.encode(text, add_special_tokens=False).ids == encode(text)
    for text in ("<|endoftext|>", "a<|endoftext|>\n\n<|endoftext|>  b<|endoftext", "  x  \n\n y", "don't I'LL", "\x1c\x85  a"):
        assert other.encode(text, add_special_tokens=False).ids == encode(text)
    assert encode("hello <|endoftext|> x") == [31373, 220, 50256, 2124]


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "a" * 2_000_000, "word " * 60_000 + "<|endoftext|>"])
def test_very_long_runs(text):
    """A run of a million blanks once ended the process."""
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenizer(default_tokenizer()).ids(text) == other.encode(text, add_special_tokens=False).ids


def test_both_encoders_agree_around_the_bound():
    encoder = tokenizer(default_tokenizer())
    for tail in ("", " ", "x", "é", "\n\n", "<|endoftext|>"):
        text = ("Some words, 12 more;  and\tblanks " * 7_000)[: encoder.LONG - len(tail) - 1] + tail
        assert encoder.ids(text) == encoder.published.encode(text, add_special_tokens=False).ids


def test_documents_of_blanks_are_packed(spark, documents):
    rows = [(1, " " * 1_000_000, "en", "a"), (2, "\n" * 1_000_000, "en", "a"), (3, "x", "en", "a")]
    found = packing.packed_documents(documents(rows)).groupBy("doc_id").sum("length").collect()
    encode = tokenizer(default_tokenizer()).ids
    assert {r[0]: r[1] for r in found} == {i: len(encode(text)) + 1 for i, text, *_ in rows}
