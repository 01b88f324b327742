from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import PYTHON_MAIN, README  # noqa: E402

from auditframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "auditframe-tests", "8g")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Build ``files(repo_id, path, text)`` of one repository from a mapping."""

    def build(texts: dict[str, str], repo: str | None = "r"):
        rows = [(repo, path, text) for path, text in texts.items()]
        return spark.createDataFrame(rows, "repo_id string, path string, text string")

    return build


@pytest.fixture
def project(files):
    return files(
        {
            "main.py": PYTHON_MAIN,
            "README.md": README,
            "test_main.py": '"""Tests."""\n',
            "pytest.ini": "[pytest]\n",
            "package.json": '{"devDependencies": {"jest": "1", "x": "0"}, "dependencies": {"x": "1"}}',
            "bench/perf_x.py": "x = 1\n",
            ".github/workflows/ci.yml": "on: push\n",
            "app/htmlcov/index.html": "",
            "coverage.xml": "",
            "spec/a.rb": "",
            "spec/b.rb": "",
        }
    )
