"""Session helpers: the shared work folder and tables that cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local_work: str | None = None


def work_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor share, from ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one process tree, may leave the
    setting out; it then gets a temporary folder.
    """
    global _local_work
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/fathom"
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_work is None:
        _local_work = tempfile.mkdtemp(prefix="fathom-")
    return f"file://{os.path.abspath(_local_work)}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Makes Spark delete the shuffles of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds the rows that a Python worker gets at once, by their bytes.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows with long arrays that a worker gets at once. It holds two batches, the next being read
#: before the last goes, and a freed one stays with the process.
BATCH_BYTES = 16 << 20
_setting: dict[tuple[int, str], tuple[int, str]] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting holds while any thread is within, and then is what it was before the first."""
    key = (id(spark._jsparkSession), name)
    with _lock:
        n, before = _setting.get(key, (0, None))
        before = spark.conf.get(name) if n == 0 else before
        _setting[key] = (n + 1, before)
        spark.conf.set(name, value)
    try:
        yield
    finally:
        with _lock:
            n, before = _setting.pop(key)
            if n > 1:
                _setting[key] = (n - 1, before)
            else:
                spark.conf.set(name, before)


def _shuffles_go(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """CLEANUP is set while a table is written. It must not stay: a query whose rows are fetched bit by
    bit would lose what it has shuffled."""
    return _set(spark, CLEANUP, "true")


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What runs within hands its workers BATCH_BYTES at once. Plans that run later don't."""
    return _set(spark, ARROW_BYTES, f"{BATCH_BYTES}b")


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a worker. What Arrow has freed goes back to the system after each, as it otherwise
    stays with the process, which outlives its task."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


#: Paths of the tables that each open scope has seen written.
_scopes: list[list[tuple[SparkSession, str]]] = []


def materialize(df: DataFrame, tag: str, small: bool = False, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from files that
    survive lost executors, and expensive columns are computed once. What was shuffled on the way
    goes as soon as the table is written. With ``small``, workers get small batches. ``options`` are
    the writer's."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, tag)
    with _shuffles_go(spark), small_batches(spark) if small else contextlib.nullcontext():
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table.work_path = path
    if _scopes:
        _scopes[-1].append((spark, path))
    return table


@contextlib.contextmanager
def work_scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialized within are deleted at its end, but for those given to ``keep``, which
    the scope yields. Results are lazy and read such tables, so write what is wanted and keep it.
    Scopes may lie in each other; each deletes its own."""
    own: list[tuple[SparkSession, str]] = []
    _scopes.append(own)

    def keep(table: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x[1] != table.work_path]
        return table

    try:
        yield keep
    finally:
        _scopes.pop()
        for spark, path in own:
            drop_table(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables once nothing that is still to run reads them."""
    for table in tables:
        drop_table(table.sparkSession, table.work_path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a work path on whatever file system it lies."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jpath, True)


#: Bytes of a table, as its files have them, that a shuffle of whole rows should bring to one task.
PART_BYTES = 64 << 20


def expected_bytes(df: DataFrame) -> int:
    """The size that the optimizer expects, from the sizes of files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts(df: DataFrame, size: int = PART_BYTES) -> int:
    """Parts of at most ``size`` bytes, one at least, that ``df`` makes."""
    return max(1, -(-expected_bytes(df) // size))


#: Splits a core should have; a table that makes fewer is dealt out before costly work on its rows.
SPLITS_PER_CORE = 2


def dealt_out(df: DataFrame) -> DataFrame:
    """``df``, spread over all cores if it is so small that its splits would leave some idle: moving its
    rows then costs less than waiting for one core. A larger table stays where it lies. The size is
    what the optimizer expects, from the sizes of files. Streams stay as they are."""
    spark = df.sparkSession
    if df.isStreaming:
        return df
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = expected_bytes(df)
    return df if size >= SPLITS_PER_CORE * cores * split else df.repartition(SPLITS_PER_CORE * cores)
