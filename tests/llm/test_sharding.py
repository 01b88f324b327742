from __future__ import annotations

import hashlib
import zlib

import pandas as pd

from auditframe.llm import sharding
from auditframe.llm.queries import op10_sharding


def by_hand(docs: pd.DataFrame, shards: int, seed: int) -> dict:
    docs = docs.assign(key=[f"={s}" if s is not None else "" for s in docs["source"]], order=[hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in docs["doc_id"]])
    docs["rank"] = docs.groupby("key")["order"].rank(method="first").astype(int) - 1
    docs["n"] = docs.groupby("key")["order"].transform("size")
    docs["at"] = (2 * docs["rank"] + 1) / (2 * docs["n"])
    docs = docs.sort_values(["at", "key", "order"]).reset_index(drop=True)
    out, n = {}, len(docs)
    starts = [-(-s * n // shards) for s in range(shards)]
    for place, doc in enumerate(docs["doc_id"]):
        shard = place * shards // n
        out[doc] = (shard, place - starts[shard])
    return out


def test_query_against_sorting(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    rows = op10_sharding(spark, folder).toPandas()
    assert {r.doc_id: (r.shard, r.slot) for r in rows.itertuples()} == by_hand(docs, 24, 10)
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    for r in rows.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "rows") and pd.isna(r.grown_shard)
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    assert all(sorted(part) == list(range(len(part))) for _, part in rows.groupby("shard")["slot"])


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else None)) for i in range(3000)]
    found = sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string"), shards=10).toPandas()
    counts = found.groupby(["shard", found["source"].fillna("-")]).size().unstack()
    assert (counts.max() - counts.min() <= 2).all()


def test_edge_cases(spark, edge, empty, tmp_path):
    found = sharding.interleave(edge, shards=3)
    assert found.columns == [c for c in edge.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = found.toPandas()
    assert len(rows) == edge.count() and rows.groupby("shard").size().tolist() == [4, 4, 3]
    assert sharding.interleave(empty).count() == 0
    few = sharding.interleave(edge.limit(2), shards=24).toPandas()
    assert sorted(few["slot"]) == [0, 0]
    sharding.write_shards(found.select("doc_id", "shard", "slot"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
