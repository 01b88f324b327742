"""Every registered query against its ANSI twin on the given tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries, training_data

FOLDER = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = queries(), oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_twin_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()
    assert QUERIES.keys() - ORACLES.keys() - training_data()[0].keys() == {
        "k1_report_document", "k2_markdown_report", "audit_flagship",
    }


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["t4_html_sections", "k1_report_document", "k2_markdown_report"])
def test_query_without_twin_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert {"repo_id", "health_score", "gate_status", "verified"} <= set(df.columns)
    assert df.count() == 20
