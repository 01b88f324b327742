"""Claim statistics and the gate follow the correlated claims, counted again from the twin of the verdicts."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from compare import connect, difference

from __spark_entry__ import oracle_sql, queries

FOLDER = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.001")
VERDICTS = oracle_sql()["a12_verdicts"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


_COUNTS = "count(*) AS claims, CAST(count_if(verifiable) AS BIGINT) AS verifiable_claims"
EXPECTED = {
    "a15_claims_by_type": f"SELECT repo_id, claim_type, {_COUNTS} FROM ({VERDICTS}) GROUP BY repo_id, claim_type",
    "a15_claims_by_source": f"""
        SELECT repo_id, line_id, {_COUNTS}
        FROM (SELECT *, CAST(split_part(claim_id, ':', 1) AS BIGINT) AS line_id FROM ({VERDICTS})) GROUP BY repo_id, line_id""",
    "u4_unverifiable_claims": f"SELECT repo_id, claim_id FROM ({VERDICTS}) WHERE NOT verifiable",
    "p15_gate_status": f"""
        SELECT repo_id, count(*) AS failed_claims FROM ({VERDICTS}) WHERE status = 'failed' GROUP BY repo_id""",
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_follows_the_verdicts(spark, connection, name):
    df = queries()[name](spark, FOLDER)
    if name.startswith("a15"):
        df = df.drop("average_confidence")
    if name == "p15_gate_status":
        # The query has a row for each repository with files; the claims' other repositories are not its business.
        expected = {r[0]: r[1] for r in connection.sql(EXPECTED[name]).fetchall()}
        assert {r.repo_id: r.failed_claims for r in df.collect()} == {r.repo_id: expected.get(r.repo_id, 0) for r in df.collect()}
        return
    assert difference(df, connection, EXPECTED[name]) is None


def test_some_claims_are_backed_by_code(connection):
    """Otherwise the comparisons above would hold for the constant 0 too."""
    kinds = "('feature', 'behavior')"
    backed = f"SELECT count_if(related > 0) FROM ({VERDICTS}) WHERE claim_type IN {kinds}"
    assert connection.sql(backed).fetchall()[0][0] > 0


def test_every_gate_status_occurs(spark):
    """Packages with failed tests, with claims that no code backs, and with neither."""
    rows = queries()["p15_gate_of_packages"](spark, FOLDER).collect()
    by_status = {status: [r for r in rows if r.gate_status == status] for status in (0, 1, 2)}
    assert all(by_status.values())
    assert all(r.failed_tests == 0 and r.failed_claims > 0 for r in by_status[2])
    assert all(r.failed_tests == 0 == r.failed_claims for r in by_status[0])
