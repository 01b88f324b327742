"""What several blocks of a report ask for is made once."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest

from auditframe.catalog import reports
from auditframe.operators import history, metrics
from auditframe.sources.bindings import Bindings

FOLDER = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


def test_report_makes_shared_parts_once(spark, monkeypatch):
    """The summary and a block of its own both need the history, the line counts and the file metrics."""
    made = []

    def counted(module, name):
        plain = getattr(module, name)

        def count(*args, **options):
            made.append(name)
            return plain(*args, **options)

        monkeypatch.setattr(module, name, count)

    counted(history, "history_summary")
    counted(metrics, "line_metrics")
    counted(metrics, "file_metrics")
    b = Bindings(spark, FOLDER)
    document = reports.report_document(b).collect()
    assert sorted(made) == ["file_metrics", "history_summary", "line_metrics"]
    apart = {r["repo_id"]: r for r in reports.git_block(b).collect()}
    ages = {r["repo_id"]: json.loads(r["report"])["git_analysis"]["repository_info"]["repo_age_days"] for r in document}
    assert ages == {repo: apart[repo]["repository_info"]["repo_age_days"] for repo in ages}
