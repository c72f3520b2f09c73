"""The key-value table: put whole items, the last write per key wins.

A table is a snapshot in buckets of its key. A batch of items is folded, merged with the
buckets it touches, and those are written anew as one version; a small pointer file,
written last, names the version that holds each bucket. Readers take the latest pointer,
so they see one version as a whole, and a read by key opens one bucket. The winner is
chosen by the items' own order, not by the order of arrival.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import child_names, delete_path, get_text, put_text

KEY = ["org", "pk", "sk"]
ORDER = ["received_at", "seq"]
BUCKETS = 64


def fold_kv(items: DataFrame) -> DataFrame:
    """Latest item per key. The aggregate combines before the shuffle, so a hot
    key sends one row per task."""
    rest = [c for c in items.columns if c not in KEY]
    return (items.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("item"))
            .select(*KEY, *[F.col(f"item.{c}").alias(c) for c in rest]))


def _bucket(n: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Version numbers and the batches they hold, from the pointers' names."""
    names = [n.removesuffix(".json").split("-", 1) for n in child_names(spark, f"{path}/_versions") if n.endswith(".json")]
    return sorted((int(v), batch) for v, batch in names)


def _pointer(spark: SparkSession, path: str) -> dict | None:
    """The latest pointer: ``buckets`` (how many), ``at`` (bucket -> version), ``schema``."""
    found = _versions(spark, path)
    return json.loads(get_text(spark, f"{path}/_versions/{found[-1][0]}-{found[-1][1]}.json")) if found else None


def _folders(path: str, at: dict, buckets) -> list[str]:
    return [f"{path}/version={at[str(b)]}/bucket={b}" for b in buckets if str(b) in at]


def _open(spark: SparkSession, path: str, pointer: dict, buckets) -> DataFrame:
    schema = T.StructType.fromJson(pointer["schema"])
    folders = _folders(path, pointer["at"], buckets)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_kv(items: DataFrame, path: str, batch_id: int | str, buckets: int = BUCKETS) -> None:
    """Merge one batch of items as a new version; a batch that is already in is left
    alone, so ``batch_id`` is for one batch only. One writer at a time. ``buckets`` counts
    when the table is new."""
    spark = items.sparkSession
    versions = _versions(spark, path)
    if any(batch == str(batch_id) for _, batch in versions):
        return
    pointer = _pointer(spark, path) or {"buckets": buckets, "at": {}, "schema": json.loads(items.schema.json())}
    version, n = (versions[-1][0] if versions else 0) + 1, pointer["buckets"]
    # as columns may be named like the folders, the bucket travels under its own name
    bucket = _bucket(n, *KEY)
    fresh = fold_kv(items).persist()   # the size of one batch, folded
    try:
        touched = [r[0] for r in fresh.select(bucket).distinct().collect()]   # ``n`` numbers at most
        if touched:
            merged = fold_kv(_open(spark, path, pointer, touched).unionByName(fresh.select(
                *T.StructType.fromJson(pointer["schema"]).fieldNames())))
            # a version that was not finished has no pointer and is written over
            (merged.withColumn("bucket", bucket).hint("rebalance", "bucket")
             .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={version}"))
    finally:
        fresh.unpersist()
    pointer["at"].update({str(b): version for b in touched})
    put_text(spark, f"{path}/_versions/{version}-{batch_id}.json", json.dumps(pointer))


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its latest version."""
    pointer = _pointer(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"no key-value table at {path}")
    return _open(spark, path, pointer, range(pointer["buckets"]))


def read_item(spark: SparkSession, path: str, org: str, pk: str, sk: str) -> DataFrame:
    """The item of a primary key, at most one row, from the one bucket that may hold it."""
    pointer = _pointer(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"no key-value table at {path}")
    bucket = spark.range(1).select(_bucket(pointer["buckets"], F.lit(org), F.lit(pk), F.lit(sk))).first()[0]
    return get_item(_open(spark, path, pointer, [bucket]), org, pk, sk)


def clean_kv(spark: SparkSession, path: str) -> int:
    """Delete the bucket folders that the latest version does not read; returns how many.
    Readers of older versions must be done."""
    pointer = _pointer(spark, path)
    if pointer is None:
        return 0
    live, gone = set(_folders(path, pointer["at"], range(pointer["buckets"]))), 0
    for version in child_names(spark, path):
        if version.startswith("version="):
            folders = {f"{path}/{version}/{b}" for b in child_names(spark, f"{path}/{version}") if b.startswith("bucket=")}
            for folder in folders - live:
                delete_path(spark, folder)
                gone += 1
    return gone


def copy_kv(spark: SparkSession, path: str, target: str) -> None:
    """Write the table to a new folder. Its one batch has a name that is no number, so
    the batches of a stream that goes on there do not meet it."""
    upsert_kv(read_kv(spark, path), target, "base")


def get_item(table: DataFrame, org: str, pk: str, sk: str) -> DataFrame:
    """The item of a primary key, at most one row."""
    return table.where((F.col("org") == org) & (F.col("pk") == pk) & (F.col("sk") == sk))


def query_index(table: DataFrame, org: str, index: str, pk: str, sk_prefix: str = "") -> DataFrame:
    """Items by a secondary index such as ``gsi1``: its partition key, and the start of
    its sort key; in sort key order."""
    name, number = index[:-1], index[-1]
    keys = F.col("index_keys")
    sk = keys[f"{name}sk{number}"]
    return table.where((F.col("org") == org) & (keys[f"{name}pk{number}"] == pk)
                       & F.coalesce(sk, F.lit("")).startswith(sk_prefix)).orderBy(sk, "pk", "sk")


def drop_keys(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete entries; absent keys are no error."""
    return items.join(keys, [c for c in KEY if c in keys.columns], "left_anti")
