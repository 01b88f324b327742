"""Claims of an audit come from few of the bytes of its facts, and are made by many tasks all the same."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from auditframe.operators import claims
from auditframe.plans import audit

FOLDER = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


def test_claims_are_dealt_out(spark, monkeypatch):
    plain, staged, tables = audit.stage, {}, {}

    def stage(df, name, *args):
        staged[name] = df
        tables[name] = plain(df, name, *args)
        return tables[name]

    monkeypatch.setattr(audit, "stage", stage)
    contract.flagship(spark, FOLDER)
    dealt = staged["claims"]
    assert "RoundRobinPartitioning" in dealt._jdf.queryExecution().executedPlan().toString()
    # The same claims as without dealing, each once.
    kept = claims.with_claim_id(claims.all_claims(tables["file-facts"]))
    assert dealt.count() == kept.count() > 0
    assert dealt.exceptAll(kept).isEmpty() and kept.exceptAll(dealt).isEmpty()
