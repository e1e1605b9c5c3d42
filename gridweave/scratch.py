"""Written tables in the scratch folder that all executors see.

Tables lie under <folder>/gridweave/<application id>/, so what a killed driver leaves can be told from what is in use.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = list[tuple[SparkSession, str]]

_session: Tables = []
_stages: list[Tables] = []
#: The innermost open scope of this thread, the one around it, and the tables of the stage that a pipeline in this thread has left.
_open: contextvars.ContextVar[Tables | None] = contextvars.ContextVar("open", default=None)
_around: contextvars.ContextVar[Tables | None] = contextvars.ContextVar("around", default=None)
_left: contextvars.ContextVar[Tables | None] = contextvars.ContextVar("left", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset: a temporary one in local mode, an error on a cluster,
    whose executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {context.master})")
            found = "file://" + tempfile.mkdtemp(prefix="gridweave-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark deletes a job's shuffle files when the job ends, as the written table takes their place.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, pinned: bool = False, outer: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns a reader of it: lineage ends here, and so do the shuffle files that led to it. pinned: kept until the session's end;
    outer: kept when the innermost scope ends, as a table of what is around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    tables = None if pinned else _around.get() if outer else _open.get()
    (_session if tables is None else tables).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column name as select() and col() take it literally, dots included."""
    return "`" + name.replace("`", "``") + "`"


def quotes(df: DataFrame) -> list[str]:
    return [quoted(c) for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written, with a number of each row, and the name of that column: decisions about rows that an id need not tell apart."""
    name = free_name(df, "__row")
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int):
    """Tables written inside give Python batches of at most about `size` bytes, not as many as 10,000 rows hold: for rows that may be large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Tasks for each core over which spread() deals rows.
WAVES = 4


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by keys: before work that takes long for rows of few bytes, of which one input split holds very many."""
    return rows.repartition(max(WAVES * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def release(tables: Tables) -> None:
    """Deletes tables that materialise() has written."""
    while tables:
        spark, path = tables.pop()
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_all() -> None:
    """Deletes all tables of the session that no scope holds; DataFrames over them end with it."""
    release(_session)


@contextlib.contextmanager
def scope():
    """Tables written inside are deleted at the end: for a caller that has used up or written the results by then."""
    tables: Tables = []
    around, token = _around.set(_open.get()), _open.set(tables)
    try:
        yield
    finally:
        _open.reset(token)
        _around.reset(around)
        release(tables)


@contextlib.contextmanager
def stage_tables(first: bool = False):
    """For a stage of a pipeline: drops what the stage before wrote for itself, as its result is written by now; a first stage drops nothing.

    Each call has a scope of its own, kept for the thread that runs the stages, so pipelines in different threads don't meet.
    """
    before, tables = _left.get(), []
    if before and first:
        _session.extend(before)
    elif before:
        release(before)
    _left.set(tables)
    _stages[:] = [*(x for x in _stages if x), tables]
    token = _open.set(tables)
    try:
        yield
    finally:
        _open.reset(token)


def _at_exit() -> None:
    try:
        for tables in (*_stages, _session):
            release(tables)
    except Exception:  # the JVM may have gone first
        _session.clear()


atexit.register(_at_exit)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder, deleted with the session's tables; it does not exist yet."""
    path = f"{shared_dir(spark)}/gridweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    tables = _open.get()
    (_session if tables is None else tables).append((spark, path))
    return path
