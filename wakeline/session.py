"""Session settings and the shared folder for checkpoints and hand-over tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method above 8000 bytes of bytecode.  Stages whose fused
    # method would be larger run as split projections instead, several times faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # sessions of one busy key are merged before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan here relies on (UTC clock, AQE, Arrow)."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


# The driver's file server sends the archive to executors as they join, so it stays while the driver runs.
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application.

    Functions that run in workers name their module; executors need not have it installed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = _SHIPPED[context.applicationId] = tempfile.TemporaryDirectory()
    target = Path(folder.name) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))


def local_session(cores: str = "8", app: str = "wakeline", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": "8",
        # capturing the Python call site of every column expression doubles plan-building time
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (all executors can reach it).

    Only a local session without the setting falls back to a temporary folder;
    on a cluster a machine-local folder would be invisible to other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/wakeline/{purpose}-{uuid.uuid4().hex}"


#: Whether the shuffle files of a query go as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of stored tables, and those that were stored since the innermost ``settled`` began.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_ON_THE_WAY: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def stored(df: DataFrame, purpose: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in folders ``by`` columns, and read it back.

    For results that several later steps read: they scan a column-pruned table
    instead of repeating the work, and a lost executor costs no recomputation.
    """
    path = shared_folder(df.sparkSession, purpose)
    if (way := _ON_THE_WAY.get()) is not None:
        way.append(path)
    df.write.partitionBy(*by).parquet(path)
    return _read_back(df.sparkSession, path, df)


def _read_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    out = spark.read.schema(like.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables; nothing may read them after, lazy results included."""
    for table in tables:
        _remove(table.sparkSession, _FOLDERS.pop(table))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that wrote them ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settled(spark: SparkSession, purpose: str, *builds: Callable[[], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One stored table of what the ``builds`` return, made one after another, in folders ``by`` columns.

    After each its shuffle files are gone, and the tables that were stored on its way are removed, so
    the disk holds what one of them needs.  What a build returns may read such tables, nothing else may.
    """
    path, outer, out = shared_folder(spark, purpose), _ON_THE_WAY.get(), None
    if outer is not None:
        outer.append(path)
    for build in builds:
        way: list[str] = []
        token = _ON_THE_WAY.set(way)
        try:
            with cleaned(spark):
                out = build()
                out.write.mode("append").partitionBy(*by).parquet(path)
        finally:
            _ON_THE_WAY.reset(token)
            for folder in way:
                _remove(spark, folder)
    return _read_back(spark, path, out)
