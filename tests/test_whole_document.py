"""The bounded blocks of the report document, counted again from twins of other queries and from the views."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from compare import connect

from __spark_entry__ import oracle_sql, queries
from auditframe.sources.bindings import VIEWS, as_ansi

FOLDER = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


def test_bounded_blocks(spark):
    rows = queries()["k1_report_document"](spark, FOLDER).collect()
    documents = {r.repo_id: json.loads(r.report) for r in rows}
    connection, twins = connect(FOLDER), oracle_sql()
    verdicts = connection.sql(f"SELECT repo_id, total_claims, verified, failed, inconclusive FROM ({twins['a13_verdict_summary']})")
    for repo, *counts in verdicts.fetchall():
        claims = documents[repo]["claim_summary"]
        assert [claims[c] for c in ("total_claims", "verified", "failed", "inconclusive")] == counts
    logs = connection.sql(f"SELECT repo_id, language, list_sort(list(DISTINCT tool)) FROM ({as_ansi(VIEWS['tool_logs'])}) GROUP BY ALL")
    for repo, language, tools in logs.fetchall():
        assert documents[repo]["verification_analysis"]["contracts_verified"][language]["tools_used"] == tools
    functions = f"SELECT repo_id, count_if(complexity > 10) FROM ({as_ansi(VIEWS['function_metrics'])}) GROUP BY repo_id"
    for repo, complex_ in connection.sql(functions).fetchall():
        assert documents[repo]["detailed_findings"]["complexity_issues"] == complex_
    summary = connection.sql(f"SELECT repo_id, security_issues, type_errors FROM ({twins['j8_summary_row']})")
    for repo, security, types in summary.fetchall():
        block = documents[repo]["verification_analysis"]
        assert block["security_summary"].get("bandit", 0) == security == documents[repo]["detailed_findings"]["security_issues"]
        assert block["type_checking_summary"].get("mypy", 0) == types
        assert "static_analysis_summary" in block
    assert any(d.get("recommendations") for d in documents.values())
