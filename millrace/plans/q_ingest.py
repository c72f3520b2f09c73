"""Registered queries of the ingest pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.columns import once
from ..functions.keys import merge_key, split_key
from ..operators import ingest as I
from ..operators.config import resolve_topics
from ..operators.dedup import dedup
from ..operators.ordering import ordered_stream
from ..schemas import META_FIELDS
from ..sources import derived
from .shared import (DEDUPED, MESSAGES, VALIDATED, enriched, epoch_ms, valid, validated, with_ctes)

QUERIES, ORACLES = {}, {}


def topic_resolve(spark, sf):
    df = resolve_topics(derived.messages(spark, sf), derived.topics(spark))
    return df.groupBy("org", "topic", F.col("cfg").isNotNull().alias("defined"),
                      F.coalesce("cfg.retention", F.lit("-")).alias("retention"),
                      F.coalesce(F.array_join("cfg.streams", ","), F.lit("")).alias("streams")).agg(F.count("*").alias("n"))


QUERIES["topic_resolve"] = topic_resolve
ORACLES["topic_resolve"] = with_ctes(VALIDATED, """
SELECT org, topic, defined, coalesce(retention, '-') AS retention,
  array_to_string(streams, ',') AS streams, count(*) AS n FROM resolved GROUP BY ALL""")


def ingest_validate(spark, sf):
    return validated(spark, sf).select("seq", epoch_ms("received_at"), "reject_code",
                                       F.length("reject_reason").isNotNull().alias("has_reason"))


QUERIES["ingest_validate"] = ingest_validate
ORACLES["ingest_validate"] = with_ctes(VALIDATED, """
SELECT seq, ms, reject_code, reject_code IS NOT NULL AS has_reason FROM validated""")


def body_decode(spark, sf):
    return derived.messages(spark, sf).withColumn(
        "text", P.decode_body(F.col("body"), F.col("content_type"))
    ).select("seq", epoch_ms("received_at"), F.length("text").alias("len"), F.md5("text").alias("md5"))


QUERIES["body_decode"] = body_decode
ORACLES["body_decode"] = with_ctes(MESSAGES, """
, decoded AS (SELECT seq, ms, CASE WHEN content_type IN
  ('application/json', 'text/plain') THEN body ELSE base64(encode(body)) END AS text FROM messages)
SELECT seq, ms, length(text) AS len, md5(text) AS md5 FROM decoded""")


def enrich(spark, sf):
    df = once(enriched(spark, sf).where("fields is not null"), "line", F.to_json("fields"))
    read = F.from_json("line", "event_id long, event_type string, value double, props struct<k:int>, "
                               "_ds_message_ts long, " + ", ".join(f"{f} string" for f in META_FIELDS[1:]))
    return once(df, "r", read).select(
        "seq", epoch_ms("received_at"), "r.event_id", "r.event_type", "r.value", "r.props.k",
        F.col("r._ds_message_ts").alias("m_ts"),
        *[F.col(f"r.{f}").alias(a) for f, a in zip(META_FIELDS[1:], ["m_key", "m_id", "m_retention", "m_org", "m_topic"])],
        F.size(F.json_object_keys("line")).alias("fields"), F.instr("line", "\n").alias("newline"))


QUERIES["enrich"] = enrich
ORACLES["enrich"] = with_ctes(VALIDATED, """
SELECT seq, ms, seq AS event_id, topic AS event_type,
  CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value,
  CAST(json_extract_string(body, '$.props.k') AS INTEGER) AS k, ms AS m_ts,
  message_key AS m_key, message_id AS m_id, CASE WHEN has_batch THEN retention END AS m_retention,
  org AS m_org, topic AS m_topic,
  9 + CASE WHEN message_id IS NULL THEN 0 ELSE 1 END + CASE WHEN has_batch THEN 1 ELSE 0 END AS fields,
  0 AS newline
FROM parsed WHERE is_object""")


def fan_out(spark, sf):
    return I.fan_out(valid(spark, sf)).groupBy("org", "stream", "topic").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"))


QUERIES["fan_out"] = fan_out
ORACLES["fan_out"] = with_ctes(VALIDATED, """
SELECT org, stream, topic, count(*) AS n, CAST(sum(strlen(body)) AS BIGINT) AS bytes FROM fanned GROUP BY ALL""")


def dedup_group(spark, sf):
    return dedup(I.fan_out(valid(spark, sf))).select("org", "stream", "message_key", "seq", epoch_ms("received_at"))


QUERIES["dedup_group"] = dedup_group
ORACLES["dedup_group"] = with_ctes(VALIDATED + DEDUPED, """
SELECT org, stream, message_key, seq, t AS ms FROM deduped""", recursive=True)


def dedup_exact(spark, sf):
    """The simple variant: each id of a stream and key once, by its first copy."""
    df = I.fan_out(valid(spark, sf)).where("message_id is not null")
    return df.groupBy("org", "stream", "message_key", "message_id").agg(
        F.unix_millis(F.min("received_at")).alias("ms"), F.count("*").alias("copies"))


QUERIES["dedup_exact"] = dedup_exact
ORACLES["dedup_exact"] = with_ctes(VALIDATED, """
SELECT org, stream, message_key, message_id, min(ms) AS ms, count(*) AS copies
FROM fanned WHERE message_id IS NOT NULL GROUP BY ALL""")


def ingest(spark, sf):
    res = I.ingest(derived.messages(spark, sf), derived.topics(spark))
    parts = [("lake", res.lake, F.lit(None)), ("store", res.store, F.lit(None)),
             ("streams", res.streams, F.lit(None)), ("rejects", res.rejects, F.col("reject_code"))]
    counted = [df.groupBy("org", "topic", code.cast("int").alias("code")).agg(F.count("*").alias("n"))
               .select(F.lit(name).alias("dest"), "org", "topic", "code", "n") for name, df, code in parts]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


QUERIES["ingest"] = ingest
ORACLES["ingest"] = with_ctes(VALIDATED + DEDUPED, """
SELECT 'lake' AS dest, org, topic, CAST(NULL AS INTEGER) AS code, count(*) AS n FROM lake GROUP BY ALL
UNION ALL SELECT 'store', org, topic, NULL, count(*) FROM store GROUP BY ALL
UNION ALL SELECT 'streams', org, topic, NULL, count(*) FROM deduped GROUP BY ALL
UNION ALL SELECT 'rejects', org, topic, reject_code, count(*) FROM validated WHERE reject_code IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'rejects', org, topic, 422, count(*) FROM parsed WHERE NOT is_object GROUP BY ALL""", recursive=True)


def attr_project(spark, sf):
    df = enriched(spark, sf).where("cfg.store is not null and fields is not null")
    kept = P.project_attrs(F.col("fields"), F.col("cfg.store.whitelist"), F.col("cfg.store.blacklist"))
    return df.select("seq", epoch_ms("received_at"),
                     F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("attrs"))


QUERIES["attr_project"] = attr_project
ORACLES["attr_project"] = with_ctes(VALIDATED, """
SELECT seq, ms, CASE topic WHEN 'view' THEN 'user_id,value' ELSE
  concat(CASE WHEN message_id IS NULL THEN '' ELSE '_ds_message_id,' END,
         '_ds_message_key,_ds_message_ts,_ds_organization,_ds_retention,_ds_topic,event_id,event_type,user_id,value')
  END AS attrs FROM store""")


def kv_keys(spark, sf):
    items = I.store_items(enriched(spark, sf))
    return items.select("org", "pk", "sk", "ttl", "seq", epoch_ms("received_at"),
                        F.get_json_object("attrs", "$.value").cast("double").alias("value"))


QUERIES["kv_keys"] = kv_keys
ORACLES["kv_keys"] = with_ctes(VALIDATED, """
SELECT org, pk, sk, ttl, seq, ms,
  CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value FROM store""")


def _key_parts(spark, sf):
    return derived.table(spark, sf, "pages").select(
        "page_id", F.array("url", F.lit(""), F.replace("url", F.lit("/"), F.lit("\\")),
                           F.col("page_id").cast("string")).alias("parts"))


def key_merge(spark, sf):
    return _key_parts(spark, sf).select("page_id", merge_key(F.col("parts")).alias("k"))


QUERIES["key_merge"] = key_merge
ORACLES["key_merge"] = r"""
SELECT page_id, concat(replace(url, ':', '\:'), '::', replace(replace(url, '/', '\\'), ':', '\:'), ':',
                       CAST(page_id AS VARCHAR)) AS k FROM pages"""


def key_split(spark, sf):
    df = key_merge(spark, sf).select("page_id", split_key(F.col("k")).alias("p"))
    return df.select("page_id", F.size("p").alias("n"), *[F.col("p")[i].alias(f"p{i}") for i in range(4)])


QUERIES["key_split"] = key_split
ORACLES["key_split"] = r"""
SELECT page_id, 4 AS n, url AS p0, '' AS p1, replace(url, '/', '\') AS p2, CAST(page_id AS VARCHAR) AS p3 FROM pages"""


def ttl_stamp(spark, sf):
    msgs = derived.messages(spark, sf).withColumn(
        "ttl_sec", F.when(F.col("topic") == "purchase", 1000).when(F.col("topic") == "view", 60).cast("long"))
    return I.with_ttl(msgs).select("seq", epoch_ms("received_at"), "topic", "ttl")


NOW_SEC = 1705320000  # 2024-01-15 12:00:00 UTC

QUERIES["ttl_stamp"] = ttl_stamp
ORACLES["ttl_stamp"] = with_ctes(MESSAGES, """
SELECT seq, ms, topic, ms // 1000 +
  CASE topic WHEN 'purchase' THEN 1000 WHEN 'view' THEN 60 END AS ttl FROM messages""")


def ttl_filter(spark, sf):
    return (I.live(ttl_stamp(spark, sf), NOW_SEC).groupBy("topic")
            .agg(F.count("*").alias("n"), F.max("ttl").alias("ttl")))


QUERIES["ttl_filter"] = ttl_filter
ORACLES["ttl_filter"] = with_ctes(MESSAGES, f"""
, stamped AS (SELECT topic, ms // 1000 +
  CASE topic WHEN 'purchase' THEN 1000 WHEN 'view' THEN 60 END AS ttl FROM messages)
SELECT topic, count(*) AS n, max(ttl) AS ttl FROM stamped WHERE ttl IS NULL OR ttl >= {NOW_SEC} GROUP BY topic""")


def stream_order(spark, sf):
    return ordered_stream(I.fan_out(valid(spark, sf))).select(
        "org", "stream", "message_key", "seq", epoch_ms("received_at"), "position")


QUERIES["stream_order"] = stream_order
ORACLES["stream_order"] = with_ctes(VALIDATED, """
SELECT org, stream, message_key, seq, ms,
  row_number() OVER (PARTITION BY org, stream, message_key ORDER BY received_at, seq) AS position FROM fanned""")
