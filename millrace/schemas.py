"""Canonical schemas and the fixed values of the platform's formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: content types, limits, metadata names, retention classes ---
JSON_TYPE = "application/json"
TEXT_TYPE = "text/plain"
OCTET_TYPE = "application/octet-stream"
AVRO_TYPE = "application/avro"
PROTOBUF_TYPE = "application/protobuf"
TEXT_TYPES = [JSON_TYPE, TEXT_TYPE]
BINARY_TYPES = [OCTET_TYPE, AVRO_TYPE, PROTOBUF_TYPE]

MAX_BODY_BYTES = 262144

META_TS = "_ds_message_ts"
META_KEY = "_ds_message_key"
META_ID = "_ds_message_id"
META_RETENTION = "_ds_retention"
META_ORG = "_ds_organization"
META_TOPIC = "_ds_topic"
META_FIELDS = [META_TS, META_KEY, META_ID, META_RETENTION, META_ORG, META_TOPIC]

RETENTION_DAYS = {"DAY": 1, "WEEK": 7, "THREE_MONTHS": 90, "YEAR": 366, "THREE_YEARS": 1098}
DEFAULT_RETENTION = "THREE_MONTHS"

LAKE_PARTITIONS = ["retention", "organization", "topic", "year", "month", "day", "hour"]

MESSAGES = (
    "seq long, org string, topic string, message_key string, message_id string, "
    "content_type string, body binary, received_at timestamp"
)

STORE = (
    "struct<keys:array<struct<type:string,index_no:int,pk_parts:array<string>,"
    "sk_parts:array<string>,range_prefix:string>>,"
    "ttl_sec:long,whitelist:array<string>,blacklist:array<string>>"
)

TOPICS = (
    "org string, topic string, allow_undefined boolean, retention string, has_batch boolean, "
    f"streams array<string>, store {STORE}, version long"
)

STATE_OPS = (
    "key_parts array<string>, seq long, at timestamp, attr string, op string, value string"
)


def topic_row(org, topic=None, allow_undefined=None, retention=None, has_batch=False,
              streams=(), store=None, version=0) -> dict:
    """One row of the topics table; ``topic=None`` is the org's default topic."""
    return dict(org=org, topic=topic, allow_undefined=allow_undefined, retention=retention,
                has_batch=has_batch, streams=list(streams), store=store, version=version)


def store_key(kind, number, pk_parts, sk_parts=(), prefix="") -> dict:
    return dict(type=kind, index_no=number, pk_parts=list(pk_parts), sk_parts=list(sk_parts),
                range_prefix=prefix)


def store_def(pk_parts, sk_parts=(), prefix="", ttl_sec=None, whitelist=(), blacklist=(),
              indexes=()) -> dict:
    """A store destination: the primary key, then any further index keys.

    A local index shares the primary partition key, so its parts must be equal.
    """
    for index in indexes:
        if index["type"] == "LSI" and index["pk_parts"] != list(pk_parts):
            raise ValueError(f"local index {index['index_no']} must use the primary partition key")
    return dict(keys=[store_key("PRIMARY", 0, pk_parts, sk_parts, prefix), *indexes],
                ttl_sec=ttl_sec, whitelist=list(whitelist), blacklist=list(blacklist))


def small_df(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A configuration table. Built from Arrow it is a local relation, whose size
    Catalyst knows, so that it alone decides whether a join may broadcast it."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    arrow = pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))
    return spark.createDataFrame(arrow, schema)


def topics_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return small_df(spark, rows, TOPICS)
