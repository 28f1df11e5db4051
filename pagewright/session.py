"""Session construction and durable materialisation."""

from __future__ import annotations

import atexit
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_FOLDERS: dict[str, SparkSession] = {}
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "pagewright", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the settings the operators assume.

    Only semantics-bearing or scale-neutral settings live here; executor sizing and
    shuffle width belong to the cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # HTML rows are wide: small Arrow batches bound Python worker memory.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    `spark.checkpoint.dir` of the session; where it is unset, a folder beside the managed
    tables in `spark.sql.warehouse.dir`, which a cluster shares as well. A warehouse on the driver's own disk
    is an error unless the session is a local one, since executors could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        check_shared(_scheme(spark, warehouse), spark.sparkContext.master, warehouse)
        root = f"{warehouse}/_intermediate"
    return root.rstrip("/")


def _scheme(spark: SparkSession, path: str) -> str:
    """File system of a path; one without scheme lies in the default one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()


def check_shared(scheme: str, master: str, path: str) -> None:
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"{path} is a local folder, which executors do not share: set spark.checkpoint.dir to a shared one")


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a fresh folder below `checkpoint_root`; it is removed when the driver ends."""
    path = f"{checkpoint_root(spark)}/tables/{label}-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_remove_all)
    _FOLDERS[path] = spark
    return path


def remove_folder(path: str) -> None:
    """Delete a folder made by `new_folder`, on whatever file system it lies."""
    spark = _FOLDERS.pop(path, None)
    if spark is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for path in list(_FOLDERS):
        try:
            remove_folder(path)
        except Exception:  # the JVM may have ended before
            return


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here are removed as it ends, not when the driver's JVM happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_END)
        else:
            spark.conf.set(_SHUFFLES_END, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts lineage durably (the files survive lost executors) and gives Catalyst
    true byte sizes, so that a later join is broadcast only if it is below
    `spark.sql.autoBroadcastJoinThreshold`. `release` removes the table earlier than the
    end of the driver; the shuffles that made it are removed at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with _shuffles_end(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STORED[stored] = path
    return stored


def release(df: DataFrame) -> None:
    """Remove what `materialize` wrote for `df`; nothing may read it afterwards."""
    path = _STORED.pop(df, None)
    if path:
        remove_folder(path)
