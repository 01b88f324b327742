"""Row-wise operators over files as they arrive.

Units, claims, references, secrets, lint and redaction look at one row at a time, so they accept a
streaming frame unchanged; each micro-batch costs what its rows cost and keeps no state. Operators that
rank or join whole repositories are batch work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from auditframe.functions.redact import redact_frame
from auditframe.operators import claims, findings
from auditframe.session import checkpoint_folder

OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "claims": claims.all_claims,
    "references": claims.code_references,
    "secrets": findings.secret_findings,
    "lint": findings.lint_lines,
}


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a folder; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_stream(df: DataFrame, folder: str, name: str) -> StreamingQuery:
    """Append to parquet once for all that is there, exactly once across restarts.

    Progress is kept below the session's shared checkpoint folder under ``name``.
    """
    progress = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/streams/{name}"
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress)
    return writer.trigger(availableNow=True).start(folder)


def apply_stream(stream: DataFrame, operator: str, level: str | None = None) -> DataFrame:
    """One of the row-wise operators, its texts redacted if a level is given."""
    found = OPERATORS[operator](stream)
    return redact_frame(found, level) if level else found
