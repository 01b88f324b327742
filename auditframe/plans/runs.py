"""Report runs: all tables of a report become readable at once, by a manifest that is written last.

Below a report's folder each run has a folder of its own, ``runs/<run>/<table>``, and, once all of its tables are
written, an entry ``manifests/<run>.json``. Readers start from the manifests, so a run that was killed at any moment is
not seen and the run before it stays in force. Tables staged on the way belong to the run and are deleted at its end.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from auditframe.operators.grouping import By
from auditframe.plans.audit import AuditTables, audit
from auditframe.plans.report import write_report
from auditframe.session import owned_stages


def _file_system(spark: SparkSession, folder: str):
    context = spark.sparkContext
    new = context._jvm.org.apache.hadoop.fs.Path
    return new(folder).getFileSystem(context._jsc.hadoopConfiguration()), new


def _publish(spark: SparkSession, manifests: str, run: str, text: str) -> None:
    """The manifest in one step: written under a hidden name, then renamed, as a reader could see half of a file."""
    system, new = _file_system(spark, manifests)
    system.mkdirs(new(manifests))
    hidden, final = new(f"{manifests}/.{run}.tmp"), new(f"{manifests}/{run}.json")
    out = system.create(hidden, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    if not system.rename(hidden, final):
        raise OSError(f"manifest {final.toString()} could not be put in place")


def committed_runs(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished runs, oldest first; names begin with the time of the run."""
    manifests = f"{folder.rstrip('/')}/manifests"
    system, new = _file_system(spark, manifests)
    if not system.exists(new(manifests)):
        return []
    names = [status.getPath().getName() for status in system.listStatus(new(manifests))]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))


def write_run(
    spark: SparkSession, folder: str, build: Callable[[], dict[str, DataFrame]], partition_by: By = ()
) -> str:
    """Build the tables, write them and commit them as one run; its name.

    Tables that ``build`` stages, at once or through ``audit``, are deleted once all tables are written, and also if
    building or writing fails. A failed run keeps its folder, which no reader looks at; ``remove_unfinished`` deletes it.
    """
    folder = folder.rstrip("/")
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    with owned_stages():
        tables = build()
        write_report(tables, f"{folder}/runs/{run}", partition_by)
        entries = [{"table": name, "schema": table.schema.jsonValue()} for name, table in tables.items()]
    _publish(spark, f"{folder}/manifests", run, json.dumps({"run": run, "tables": entries}))
    return run


def audit_run(tables: AuditTables, folder: str, as_of: str, partition_by: By = (), **options) -> str:
    """A whole audit as one run: its facts, verdicts and summary are staged for it and gone once it is written."""
    return write_run(tables.files.sparkSession, folder, lambda: audit(tables, as_of, **options), partition_by)


def read_run(spark: SparkSession, folder: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of a finished run, by default of the newest, with the columns that were written."""
    folder = folder.rstrip("/")
    finished = committed_runs(spark, folder)
    if not finished or run not in (None, *finished):
        raise ValueError(f"no finished run {run or ''} in {folder}")
    run = run or finished[-1]
    # A manifest is one line with an entry per table of the report.
    manifest = json.loads(spark.read.text(f"{folder}/manifests/{run}.json", wholetext=True).first()["value"])
    read = spark.read
    return {
        entry["table"]: read.schema(T.StructType.fromJson(entry["schema"])).json(f"{folder}/runs/{run}/{entry['table']}")
        for entry in manifest["tables"]
    }


def remove_unfinished(spark: SparkSession, folder: str, older_than: float) -> list[str]:
    """Delete the folders of runs without a manifest that began before ``older_than``, in seconds since 1970.

    A run that is still being written has no manifest either, so the time has to lie before all runs in progress.
    """
    runs = f"{folder.rstrip('/')}/runs"
    system, new = _file_system(spark, runs)
    if not system.exists(new(runs)):
        return []
    finished = set(committed_runs(spark, folder))
    names = [status.getPath().getName() for status in system.listStatus(new(runs))]
    dead = sorted(n for n in names if n not in finished and int(n.split("-")[0]) < older_than * 1e9)
    for name in dead:
        system.delete(new(f"{runs}/{name}"), True)
    return dead
