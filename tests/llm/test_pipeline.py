from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from auditframe.llm import minhash
from test_minhash import by_hand

ROOT = Path(corpus_pipeline.__file__).parent
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"input": docs.toPandas()}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        seen[name] = docs.toPandas()
        docs = spark.createDataFrame(seen[name], docs.schema)
        if name != "packed":
            assert docs.columns == COLUMNS
    texts = lambda name: dict(zip(seen[name]["doc_id"], seen[name]["text"], strict=True))
    assert len(seen["language_id"]) >= 0.98 * len(seen["input"])
    best = {}
    for doc, text in texts("language_id").items():
        best[text] = max(best.get(text, doc), doc)
    assert sorted(texts("exact_dedup")) == sorted(best.values())
    labels = by_hand(list(texts("exact_dedup").items()), minhash.WORDS)
    assert sorted(texts("near_dedup")) == sorted(i for i, (_, root) in labels.items() if i == root)
    copies = seen["mixture"].groupby("doc_id").size()
    assert set(copies.index) <= set(texts("near_dedup")) and copies.max() <= 2
    packed = seen["packed"]
    assert packed[packed["piece"] == 0].groupby("doc_id").size().to_dict() == copies.to_dict()


def test_run_is_the_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns)
    assert found.count() > 100


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edge_cases(spark, edge, empty, name, folder):
    step = dict(corpus_pipeline.STAGES)[name]
    assert step(spark, empty, folder).count() == 0
    found = step(spark, edge, folder)
    if name != "packed":
        assert found.columns == edge.columns
    assert found.count() <= 2 * edge.count() + 60


def test_entry_without_the_subpackage():
    """With the subpackage out of reach the other queries are still there; an error inside it is not swallowed."""
    code = (
        "import sys\nclass Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('auditframe.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\nassert 'audit_flagship' in e.queries() and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
