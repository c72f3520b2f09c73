"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # texts differ in length by thousands: what goes to a Python worker at once is bounded
    # by bytes, too
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the folder all executors share and read it back: what
    follows re-reads it when an executor is lost, and all of it sees the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the
    body names it."""
    return F.transform(F.array(value), body)[0]


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object kept for the life of a Python worker, until another one is asked for.
    Functions travel to workers by value, module globals with them, so it is kept under
    ``sys.modules``."""
    home = sys.modules.setdefault("_millrace_worker", types.ModuleType("_millrace_worker"))
    if getattr(home, "name", None) != name:
        home.name, home.held = None, None   # let go of the old one first
        home.held = make()
        home.name = name
    return home.held


def release_cache() -> None:
    """Let go of what ``worker_cache`` holds, before a step that needs the memory."""
    worker_cache("", dict)
    trim()


def trim() -> None:
    """Give memory that a worker has freed back to the system, at the end of a task:
    workers stay and are many on a machine."""
    import ctypes

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):   # another C library
        pass


def bit_filter(df: DataFrame, column: str, bits: int = 1 << 26) -> bytes:
    """The values of a long column as a bitmap of fixed size, ``bits / 8`` bytes
    whatever the input: bit ``value mod bits`` is set for every value."""
    slot = (F.pmod(F.col(column), F.lit(bits)) + 1).alias("slot")   # positions of a bitmap count from 1
    rows = (df.where(F.col(column).isNotNull()).select(slot)
            .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")).collect())
    whole = bytearray(bits // 8)
    for row in rows:
        at = (row["bucket"] - 1) * 4096   # a bitmap holds 32768 bits
        part = bytes(row["bitmap"])
        whole[at:at + len(part)] = part
    return bytes(whole)
