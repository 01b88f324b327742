"""Session settings, checkpoint folder and stage tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Session setting: into how many partitions text tables are dealt on reading. Unset, as on a cluster, they stay as
#: they lie; test tables of a single row group would otherwise keep one core busy.
SPREAD = "spark.auditframe.spread"


def local_session(cpus: int = 8, name: str = "auditframe", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config(SPREAD, str(cpus))
        # Looking up the caller of every column expression would dominate the building of large plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> SparkSession:
    """All times are UTC; months and days would otherwise depend on the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out anew where the session's setting asks for it, whatever the table's size."""
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts else df


def task_count(spark: SparkSession) -> int:
    """As many tasks as a shuffle has, for work that its bytes do not tell."""
    return int(spark.conf.get(SPREAD, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out to as many tasks as a shuffle has, for short rows that each become much work.

    Splits follow the bytes of a table, so a table of a few short columns is one task's however many rows it has.
    Rows dealt out by ``keys`` need no other shuffle to be joined on them, whatever is made of them in between.
    """
    return df.repartition(task_count(df.sparkSession), *keys)


_LOCAL_FOLDERS: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only on a local master without any."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="auditframe-")
    return _LOCAL_FOLDERS[application]


#: Where the tables lie that ``stage`` has written, by their frames.
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_OWNER: ContextVar[list[DataFrame] | None] = ContextVar("owner", default=None)


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it back.

    For results that several others consume: the lineage ends here, a lost executor costs no
    recomputation, and readers still prune columns and push filters down, which a cached or
    checkpointed frame of rows would not allow.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _STAGED[table] = path
    owner = _OWNER.get()
    if owner is not None:
        owner.append(table)
    return table


@contextmanager
def owned_stages() -> Iterator[None]:
    """Tables staged inside belong to this block and are deleted at its end, also if it fails.

    For work whose results are written inside the block; nothing may read the staged tables after it.
    """
    owned: list[DataFrame] = []
    token = _OWNER.set(owned)
    try:
        yield
    finally:
        _OWNER.reset(token)
        discard(*owned)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete staged tables, or one ``column=value`` part of them, that nothing will read any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{_STAGED[table]}/{part}".rstrip("/"))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
