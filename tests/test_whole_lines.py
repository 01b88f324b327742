"""Reports count the lines of their repository's source files, as the twin of the line metrics does."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from compare import connect

from __spark_entry__ import oracle_sql, queries

FOLDER = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def lines():
    """Lines per repository; the reports have a row for repositories without any, too."""
    counted = f"SELECT repo_id, CAST(sum(loc) AS BIGINT) FROM ({oracle_sql()['p7_line_metrics']}) GROUP BY repo_id"
    found = dict(connect(FOLDER).sql(counted).fetchall())
    assert sum(found.values()) > 0
    return found


def of_markdown(rows):
    mark = "- **Total Lines**: "
    return {r.repo_id: int(r.line.removeprefix(mark)) for r in rows if r.line.startswith(mark)}


TOTALS = {
    "k1_report_document": lambda rows: {
        r.repo_id: json.loads(r.report)["complexity_analysis"]["metrics"]["total_lines"] for r in rows
    },
    "k2_markdown_report": of_markdown,
    "k3_console_summary": lambda rows: {r.repo_id: int(r.value) for r in rows if r.metric == "Total lines"},
}


@pytest.mark.parametrize("name", sorted(TOTALS))
def test_total_lines(spark, lines, name):
    got = TOTALS[name](queries()[name](spark, FOLDER).collect())
    assert got == {repo: lines.get(repo, 0) for repo in got}
    assert any(got.values())
