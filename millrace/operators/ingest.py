"""The ingest pipeline: validate, decode, enrich and route messages.

Every step is a narrow projection apart from the topic lookup and the dedup, so
one message body is read, checked and written without being shuffled for the
lake and store destinations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import payload as P
from ..functions.columns import once
from ..schemas import BINARY_TYPES, JSON_TYPE, MAX_BODY_BYTES, TEXT_TYPES
from .config import resolve_topics
from .dedup import dedup

# fixed values: status and reason of each refusal
REASONS = {
    "empty_key": (400, "messageKey is required"),
    "undefined_topic": (404, "topic is not defined"),
    "not_json": (415, "batch and store need application/json"),
    "too_large": (413, "body is larger than 262144 bytes"),
    "unknown_type": (415, "unsupported content type"),
    "not_object": (422, "body is not a JSON object"),
}


def validate(msgs: DataFrame, topics: DataFrame) -> DataFrame:
    """Resolve topics and add ``reject``, ``reject_code`` and ``reject_reason``; the
    first failing check decides, and all are null on accepted messages."""
    resolved = resolve_topics(msgs, topics)
    kind = P.bare_type(F.col("content_type"))
    needs_json = F.col("cfg.has_batch") | F.col("cfg.store").isNotNull()
    check = (
        F.when(F.coalesce(F.col("message_key"), F.lit("")) == "", "empty_key")
        .when(F.col("cfg").isNull(), "undefined_topic")
        .when(needs_json & (kind != JSON_TYPE), "not_json")
        .when(F.octet_length("body") > MAX_BODY_BYTES, "too_large")
        .when(~kind.isin(TEXT_TYPES + BINARY_TYPES), "unknown_type")
    )
    return _with_reason(resolved.withColumn("reject", check))


def _with_reason(df: DataFrame) -> DataFrame:
    def pick(i):
        return F.create_map(*[F.lit(x) for k, v in REASONS.items() for x in (k, v[i])])[F.col("reject")]
    return df.withColumn("reject_code", pick(0)).withColumn("reject_reason", pick(1))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject").isNull())


def fan_out(valid: DataFrame) -> DataFrame:
    """One copy per configured stream with the original body."""
    return valid.select(
        "seq", "org", F.explode("cfg.streams").alias("stream"), "topic", "message_key",
        "message_id", "content_type", "body", "received_at")


def _fields(text: Column) -> Column:
    return P.enriched_fields(
        P.parse_object(text), ts=F.col("received_at"), key=F.col("message_key"),
        message_id=F.col("message_id"),
        retention=F.when(F.col("cfg.has_batch"), F.col("cfg.retention")),
        org=F.col("org"), topic=F.col("topic"))


def enrich(valid: DataFrame) -> DataFrame:
    """Parse bodies bound for lake or store; ``fields`` is null when the body is
    not a JSON object."""
    wanted = valid.where(F.col("cfg.has_batch") | F.col("cfg.store").isNotNull())
    return once(wanted, "fields", _fields(P.decode_body(F.col("body"), F.col("content_type"))))


def with_fields(validated: DataFrame, wanted: Column) -> DataFrame:
    """The same for all messages in place: ``fields`` is null where not ``wanted``, too."""
    text = F.when(wanted, P.decode_body(F.col("body"), F.col("content_type")))
    return once(validated, "fields", _fields(text))


def lake_lines(enriched: DataFrame) -> DataFrame:
    """The lake destination: one JSON text per message."""
    return enriched.where(F.col("cfg.has_batch") & F.col("fields").isNotNull()).select(
        "seq", "org", "topic", "received_at", F.to_json("fields").alias("line"))


def store_items(enriched: DataFrame) -> DataFrame:
    """The store destination: key columns, attributes as JSON text, expiry."""
    store = F.col("cfg.store")
    rows = enriched.where(store.isNotNull() & F.col("fields").isNotNull())
    keys = P.kv_keys(F.col("fields"), store["keys"])
    attrs = P.item_attrs(P.project_attrs(F.col("fields"), store["whitelist"], store["blacklist"]))
    return with_ttl(
        rows.select("org", "topic", "seq", "received_at", keys.alias("k"), attrs.alias("a"),
                    store["ttl_sec"].alias("ttl_sec")),
    ).select(
        "org", F.col("k")["pk"].alias("pk"), F.col("k")["sk"].alias("sk"),
        F.map_filter("k", lambda n, _: ~n.isin("pk", "sk")).alias("index_keys"),
        F.to_json("a").alias("attrs"), "ttl", "topic", "received_at", "seq")


def with_ttl(df: DataFrame, ts: str = "received_at", ttl_sec: str = "ttl_sec") -> DataFrame:
    """Expiry in epoch seconds; null when the destination keeps items for good."""
    return df.withColumn("ttl", F.unix_seconds(F.col(ts)) + F.col(ttl_sec))


def live(df: DataFrame, now) -> DataFrame:
    """Rows that have no expiry or expire at or after ``now`` (epoch seconds)."""
    return df.where(F.col("ttl").isNull() | (F.col("ttl") >= F.lit(now)))


@dataclass
class IngestResult:
    streams: DataFrame
    lake: DataFrame
    store: DataFrame
    rejects: DataFrame


def rejects(validated: DataFrame, enriched: DataFrame) -> DataFrame:
    """Refused messages, and accepted ones whose body lake or store cannot use
    (those still reach their streams)."""
    cols = ["seq", "org", "topic", "message_key", "received_at", "reject_code", "reject_reason"]
    unusable = _with_reason(
        enriched.where(F.col("fields").isNull()).withColumn("reject", F.lit("not_object")))
    return (validated.where(F.col("reject").isNotNull()).select(*cols)
            .unionByName(unusable.select(*cols)))


def ingest(msgs: DataFrame, topics: DataFrame, dedup_interval: str = "5 minutes") -> IngestResult:
    """Route messages to their destinations. Nothing is lost: every message is
    accepted or in ``rejects``."""
    validated = validate(msgs, topics)
    valid = accepted(validated)
    enriched = enrich(valid)
    return IngestResult(
        streams=dedup(fan_out(valid), dedup_interval),
        lake=lake_lines(enriched),
        store=store_items(enriched),
        rejects=rejects(validated, enriched),
    )
