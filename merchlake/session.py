"""Session settings and the shared folder that jobs write to."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings that can be applied to a session already running.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; ``conf`` (dots as ``__``) overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, "spark.ui.showConsoleProgress": "false"}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session built elsewhere."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder visible to every executor, named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a temporary
    folder, one for the whole session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="merchlake-")


def run_folder(spark: SparkSession, label: str) -> str:
    """A new, unique folder for one run below the shared root."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def holds_data(spark: SparkSession, path: str) -> bool:
    """Whether a table written partitioned has any partition, that is any row."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath)
    return any("=" in status.getPath().getName() for status in found)


def keep(rows: DataFrame) -> DataFrame:
    """Persist rows that are read a few times and let go soon: looking for a compression of each column costs more."""
    with temporary_conf(rows.sparkSession, {"spark.sql.inMemoryColumnarStorage.compressed": "false"}):
        return rows.persist()


def together(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Run independent writes at the same time, so small ones fill the gaps large ones leave.

    Raises the first error once all of them have ended.
    """
    with ThreadPoolExecutor(len(writes)) as pool:
        pending = [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]
    for write in pending:
        write.result()


@contextlib.contextmanager
def temporary_conf(spark: SparkSession, conf: dict[str, str]):
    """Set session options for the duration of a block, then restore them."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield spark
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
