"""The lake: gzip JSON lines, one folder per retention, org, topic and UTC hour."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import once
from ..functions.lakekey import parse_lake_key
from ..schemas import LAKE_PARTITIONS, META_ORG, META_RETENTION, META_TOPIC, small_df
from ..session import child_names, delete_path, list_folder, put_text

# fixed value: result type under which unroutable records are kept
EXTRACTION_FAILED = "metadata-extraction-failed"
MAX_RECORDS_PER_FILE = 1_000_000
DELETES = 16   # deletes at a time


def _time_parts(ts: Column) -> list[Column]:
    return [F.date_format(ts, f).alias(n)
            for n, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))]


def with_partitions(df: DataFrame) -> DataFrame:
    """Partition values, read from the metadata inside each ``line`` in one parse
    and from the arrival time."""
    meta = F.from_json(
        "line", f"{META_RETENTION} string, {META_ORG} string, {META_TOPIC} string")
    return once(df, "m", meta).select(
        "line", "received_at",
        F.col(f"m.{META_RETENTION}").alias("retention"),
        F.col(f"m.{META_ORG}").alias("organization"),
        F.col(f"m.{META_TOPIC}").alias("topic"),
        *_time_parts(F.col("received_at")))


def routable() -> Column:
    return (F.col("retention").isNotNull() & F.col("organization").isNotNull()
            & F.col("topic").isNotNull())


def write_lake(df: DataFrame, path: str) -> None:
    """Append rows of ``line, received_at``. The rebalance brings a folder's rows
    together for few large files, and AQE splits a folder that is too big for
    one task. Rows without metadata are left to :func:`write_errors`."""
    parts = with_partitions(df).where(routable())
    (parts.drop("received_at").hint("rebalance", *LAKE_PARTITIONS)
     .write.mode("append").partitionBy(*LAKE_PARTITIONS)
     .option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .text(path))


def write_lake_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """The same for a numbered batch, which may be written again: its files bear the
    batch's number, and a second try first removes what the first one has left in the
    batch's folders."""
    spark = df.sparkSession
    name, begun = f"batch-{batch_id}", f"{path}/_begun"
    parts = with_partitions(df).where(routable())
    if str(batch_id) in child_names(spark, begun):
        folders = parts.select(F.concat_ws("/", *[F.concat(F.lit(f"{c}="), c) for c in LAKE_PARTITIONS])).distinct()

        def clear(folder: str) -> None:
            for old in child_names(spark, f"{path}/{folder}"):
                if old.startswith(f"{name}-"):
                    delete_path(spark, f"{path}/{folder}/{old}")

        with ThreadPoolExecutor(DELETES) as pool:   # as many folders as one batch has
            list(pool.map(clear, [r[0] for r in folders.collect()]))
    put_text(spark, f"{begun}/{batch_id}", "")
    (parts.drop("received_at").hint("rebalance", *LAKE_PARTITIONS)
     .write.mode("append").partitionBy(*LAKE_PARTITIONS).option("mapreduce.output.basename", name)
     .option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .text(path))


def error_path(path: str) -> str:
    return f"{path}/retention=DAY/error"


def write_errors(df: DataFrame, path: str) -> None:
    """Append the rows whose metadata cannot be extracted to the error folder."""
    time_parts = ["year", "month", "day", "hour"]
    bad = (with_partitions(df).where(~routable())
           .select("line", F.lit(EXTRACTION_FAILED).alias("result"), *time_parts))
    (bad.hint("rebalance", "result", *time_parts)
     .write.mode("append").partitionBy("result", *time_parts)
     .option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .text(error_path(path)))


def topic_glob(path: str, org: str | None = None, topic: str | None = None) -> str:
    """Whole partition values only: topic ``a`` never matches ``ab``."""
    return f"{path}/retention=*/organization={org or '*'}/topic={topic or '*'}"


def _load(spark: SparkSession, path: str, reader, org: str | None, topic: str | None) -> DataFrame:
    """Load the folders of an org and topic. A lake written by a stream is loaded
    from its root, where Spark finds the list of committed files."""
    reader = reader.option("basePath", path)
    if "_spark_metadata" not in child_names(spark, path):
        return reader.load(topic_glob(path, org, topic))
    df = reader.load(path)
    for name, value in (("organization", org), ("topic", topic)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def _with_folders(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(c, T.StringType()) for c in LAKE_PARTITIONS])


def _hour_text() -> Column:
    return F.concat_ws("-", "year", "month", "day", "hour")


def in_hours(df: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Restrict to hours ``since <= h < until`` given as ``yyyy-MM-dd-HH``. The
    predicate uses partition columns only, so it prunes folders."""
    if since is not None:
        df = df.where(_hour_text() >= since)
    if until is not None:
        df = df.where(_hour_text() < until)
    return df


def read_lake(spark: SparkSession, path: str, schema: str | T.StructType, org: str | None = None,
              topic: str | None = None, since: str | None = None, until: str | None = None,
              drop_malformed: bool = False) -> DataFrame:
    """Read lake records with a registered schema, columns matched by name. A
    malformed line gives a row of nulls, or no row with ``drop_malformed``."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    reader = (spark.read.format("json").schema(_with_folders(schema))
              .option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE"))
    return in_hours(_load(spark, path, reader, org, topic), since, until)


def read_lines(spark: SparkSession, path: str, org: str | None = None,
               topic: str | None = None) -> DataFrame:
    """Lake lines as text with their file and a position that grows along each
    file (gzip files are never split, so one task reads a file in order)."""
    reader = spark.read.format("text").schema(_with_folders(T.StructType.fromDDL("value string")))
    return (_load(spark, path, reader, org, topic)
            .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                    F.monotonically_increasing_id().alias("pos")))


def _relative(path: str) -> Column:
    """The key below the lake's root, whatever the file system prefix."""
    root = path.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring_index(F.col("path"), root, -1).alias("key")


def all_files(spark: SparkSession, path: str, org: str | None = None,
              topic: str | None = None) -> DataFrame:
    """Inventory without file contents: key, size, last modified."""
    return (_load(spark, path, spark.read.format("binaryFile"), org, topic)
            .select(_relative(path), F.col("length").alias("size"),
                    F.col("modificationTime").alias("last_modified")))


def _walk(spark: SparkSession, path: str, folder: str, start: str, after: str) -> Iterator[dict]:
    """Files below a folder in key order whose key starts with ``start`` and lies behind
    ``after``. A folder is listed when the walk reaches it, and only if it can hold one."""
    found = list_folder(spark, f"{path}/{folder}")
    for name, is_folder, size, changed in sorted(found, key=lambda c: c[0] + "/" * c[1]):
        key = f"{folder}/{name}"
        if name.startswith(("_", ".")):
            continue
        if is_folder:
            below = f"{key}/"
            behind = below > after or after.startswith(below)
            if behind and (below.startswith(start) or start.startswith(below)):
                yield from _walk(spark, path, key, start, after)
        elif key > after and key.startswith(start):
            yield dict(key=key, size=size, last_modified=changed)


def lake_files(spark: SparkSession, path: str, org: str, topic: str, prefix: str | None = None,
               limit: int = 100, after: str | None = None) -> DataFrame:
    """One page of a topic's files in key order; pass the last key as ``after`` for the
    next page. The page size is held within 1..1000. Folders are walked in order from
    there on, so the cost follows the page and not the topic."""
    topics = [f"{r}/organization={org}/topic={topic}" for r in sorted(child_names(spark, path)) if r.startswith("retention=")]
    files = (row for t in topics for row in _walk(spark, path, t, f"{t}/{prefix or ''}", after or ""))
    page = list(islice(files, max(1, min(limit, 1000))))
    return small_df(spark, page, "key string, size long, last_modified timestamp")


def lake_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Partitions in use with file count, size and newest file."""
    return (all_files(spark, path).select(parse_lake_key(F.col("key")).alias("k"), "size", "last_modified")
            .where(F.col("k.retention").isNotNull())
            .groupBy(*[F.col(f"k.{c}").alias(c) for c in LAKE_PARTITIONS])
            .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"),
                 F.max("last_modified").alias("last_modified")))


def error_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Hour folders of the error records, with file count and size; none without any."""
    names = ["result", "year", "month", "day", "hour"]
    ddl = ", ".join(f"{c} string" for c in names) + ", files long, bytes long"
    if not child_names(spark, error_path(path)):
        return spark.createDataFrame([], ddl)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(error_path(path))
    part = lambda c: F.regexp_extract("path", rf"/{c}=([^/]+)/", 1).alias(c)
    return files.groupBy(*[part(c) for c in names]).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))
