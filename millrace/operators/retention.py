"""Retention classes: which lake folders have expired, and storage tiers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import LAKE_PARTITIONS, RETENTION_DAYS
from ..session import child_names, delete_path
from ..sources.lake import DELETES, error_partitions, error_path, lake_partitions

# fixed values: classes kept longer than this are tiered, after these ages
TIERED_ABOVE_DAYS = 120
ARCHIVE_DAYS = 90
DEEP_ARCHIVE_DAYS = 180


def retention_days(retention: Column) -> Column:
    """Days kept; an unknown class is an error."""
    expr = None
    for name, days in RETENTION_DAYS.items():
        expr = F.when(retention == name, days) if expr is None else expr.when(retention == name, days)
    return expr.otherwise(F.raise_error(F.concat(F.lit("unknown retention "), retention)).cast("int"))


def partition_time() -> Column:
    return F.make_timestamp(*[F.col(c).cast("int") for c in ("year", "month", "day", "hour")],
                            F.lit(0), F.lit(0))


def expired_partitions(parts: DataFrame, now: Column) -> DataFrame:
    """Hour folders whose class's age has passed."""
    return (parts.withColumn("expires_at", partition_time()
                             + F.make_dt_interval(days=retention_days(F.col("retention"))))
            .where(F.col("expires_at") <= now))


def partition_path(path: str) -> Column:
    return F.concat(F.lit(path), *[x for c in LAKE_PARTITIONS for x in (F.lit(f"/{c}="), F.col(c))])


def expired_errors(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Hour folders of the error records whose age, that of class DAY, has passed."""
    parts = error_partitions(spark, path).withColumn("retention", F.lit("DAY"))
    folder = F.concat(F.lit(error_path(path)), *[
        x for c in ("result", "year", "month", "day", "hour") for x in (F.lit(f"/{c}="), F.col(c))])
    return expired_partitions(parts, now).withColumn("path", folder)


def expire(spark: SparkSession, path: str, now: Column, dry_run: bool = True) -> DataFrame:
    """The expired folders; with ``dry_run=False`` they are deleted too, and with them
    the expired error records. Folder names are streamed through the driver, which is
    where file system deletes are issued, several at a time; no data passes. A lake that a stream writes
    through the file sink cannot be expired: its commit log would still name the files."""
    gone = expired_partitions(lake_partitions(spark, path), now).withColumn("path", partition_path(path))
    if not dry_run:
        if "_spark_metadata" in child_names(spark, path):
            raise ValueError("this lake is written by a file sink, whose log names its files")
        rows = gone.select("path").unionByName(expired_errors(spark, path, now).select("path")).toLocalIterator()
        with ThreadPoolExecutor(DELETES) as pool:
            while some := [row.path for row in islice(rows, 64 * DELETES)]:
                list(pool.map(lambda folder: delete_path(spark, folder), some))
    return gone


def tier(parts: DataFrame, now: Column) -> DataFrame:
    """Size per storage tier. Age is that of the hour folder, as days without
    access are not recorded."""
    age = F.date_diff(F.to_date(now), F.to_date(partition_time()))
    tiered = retention_days(F.col("retention")) > TIERED_ABOVE_DAYS
    name = (F.when(tiered & (age >= DEEP_ARCHIVE_DAYS), "DEEP_ARCHIVE")
            .when(tiered & (age >= ARCHIVE_DAYS), "ARCHIVE").otherwise("STANDARD"))
    return (parts.groupBy("retention", name.alias("tier"))
            .agg(F.count("*").alias("partitions"), F.sum("files").alias("files"),
                 F.sum("bytes").alias("bytes")))
