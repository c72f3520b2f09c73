"""Session settings and the shared scratch folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when that costs one more exchange above it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a lake write makes one file per folder however small, so few bytes may still
    # be much work: keep all cores busy before merging shuffle partitions
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Functions that run in Python workers travel by value, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the library relies on; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "millrace", cpus: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        # checkpoint files go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration step in the shared folder, so that a lost
    executor costs a re-read and not a replay of every earlier round."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None) -> Iterator[None]:
    """Start stateful streams inside this block. The number of state partitions is
    fixed for the life of a checkpoint, so it is chosen here, one per core unless
    given, and not left to the setting for batch shuffles."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Batch work inside ``foreachBatch``: a stream's session switches adaptive
    execution off, and with it the merging of small shuffle partitions and the
    splitting of skewed ones. Switch it on for the block."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none when it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return [status.getPath().getName() for status in fs.listStatus(target)]


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, bool, int, datetime]]:
    """What lies directly below a folder: name, whether it is a folder, size and time of
    the last change; nothing when it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return [(s.getPath().getName(), s.isDirectory(), s.getLen(),
             datetime.fromtimestamp(s.getModificationTime() / 1000, timezone.utc)) for s in fs.listStatus(target)]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file as a whole: it appears under its name when complete."""
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")


def get_text(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
