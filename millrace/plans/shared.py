"""What the registered queries share: inputs, a lake, and the check's CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ingest as I
from ..session import prepare, scratch_path
from ..sources import derived
from ..sources.lake import write_lake

_lakes: dict[tuple[str, str], str] = {}


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validate(derived.messages(spark, sf_dir), derived.topics(spark))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.accepted(validated(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.enrich(valid(spark, sf_dir))


def lake_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.lake_lines(enriched(spark, sf_dir))


def lake_for(spark: SparkSession, sf_dir: str) -> str:
    """A lake of all messages, written once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes:
        path = scratch_path(spark, "lake")
        write_lake(lake_lines(prepare(spark), sf_dir), path)
        _lakes[key] = path
    return _lakes[key]


def epoch_ms(col: str, name: str = "ms"):
    return F.unix_millis(col).alias(name)


# The derived inputs again, for the check.
MESSAGES = """
messages AS (
  SELECT event_id AS seq, concat('org', CAST(user_id % 3 AS VARCHAR)) AS org, event_type AS topic,
    CASE WHEN event_id % 200 = 199 THEN '' ELSE CAST(user_id AS VARCHAR) END AS message_key,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('m', CAST(event_id AS VARCHAR)) END AS message_id,
    CASE event_id % 20 WHEN 0 THEN NULL WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/avro'
         WHEN 3 THEN 'image/png' ELSE 'application/json' END AS content_type,
    CASE WHEN event_id % 50 = 49 THEN '{bad'
         WHEN event_id % 500 = 5 THEN repeat('x', 262145)
         WHEN event_id % 500 = 6 THEN repeat('x', 262144)
         ELSE concat('{"event_id":', CAST(event_id AS VARCHAR), ',"event_type":"', event_type,
                     '","user_id":', CAST(user_id AS VARCHAR), ',"value":',
                     CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), ',"props":', props, '}') END AS body,
    ts + to_seconds(delay) AS received_at, epoch_us(ts + to_seconds(delay)) // 1000 AS ms, user_id, value
  FROM events JOIN (VALUES (0, 0), (1, 60), (2, 600)) copy(n, delay)
    ON n = 0 OR (n = 1 AND event_id % 10 = 0) OR (n = 2 AND event_id % 25 = 0)
)"""

VALIDATED = MESSAGES + """,
topics(org, topic, retention, has_batch, streams, has_store) AS (VALUES
  ('org0', 'click', 'YEAR', true, ['s_click', 's_all'], false),
  ('org0', 'purchase', 'THREE_YEARS', true, ['s_all'], true),
  ('org0', 'error', NULL, false, ['s_err'], false),
  ('org1', 'view', 'DAY', true, ['s_view'], true)
),
resolved AS (
  SELECT m.*, coalesce(m.content_type, 'application/octet-stream') AS kind,
    t.org IS NOT NULL OR m.org <> 'org1' AS defined,
    CASE WHEN t.org IS NOT NULL THEN t.retention WHEN m.org = 'org0' THEN 'WEEK'
         WHEN m.org = 'org2' THEN 'THREE_MONTHS' END AS retention,
    CASE WHEN t.org IS NOT NULL THEN t.has_batch ELSE m.org <> 'org1' END AS has_batch,
    coalesce(t.has_store, false) AS has_store, coalesce(t.streams, []) AS streams
  FROM messages m LEFT JOIN topics t ON m.org = t.org AND m.topic = t.topic
),
validated AS (
  SELECT *, CASE WHEN message_key = '' THEN 400 WHEN NOT defined THEN 404
      WHEN (has_batch OR has_store) AND kind <> 'application/json' THEN 415
      WHEN strlen(body) > 262144 THEN 413
      WHEN kind NOT IN ('application/json', 'text/plain', 'application/octet-stream',
                        'application/avro', 'application/protobuf') THEN 415 END AS reject_code
  FROM resolved
),
valid AS (SELECT * FROM validated WHERE reject_code IS NULL),
parsed AS (SELECT *, body[1] = '{' AND body <> '{bad' AS is_object FROM valid WHERE has_batch OR has_store),
lake AS (SELECT * FROM parsed WHERE has_batch AND is_object),
store AS (SELECT *, CAST(user_id AS VARCHAR) AS pk,
    CASE topic WHEN 'purchase' THEN concat('p:', CAST(seq AS VARCHAR)) ELSE 'last' END AS sk,
    ms // 1000 + CASE topic WHEN 'purchase' THEN 1000 ELSE 60 END AS ttl
  FROM parsed WHERE has_store AND is_object),
fanned AS (SELECT seq, org, unnest(streams) AS stream, topic, message_key, message_id, body,
    received_at, ms FROM valid)"""

# accepted copies, one decision after the other
DEDUPED = """,
cells AS (
  SELECT *, ms AS t, org || '/' || stream || '/' || message_key || '/' ||
    coalesce(message_id, sha256(body)) AS g FROM fanned
),
accepted(g, t) AS (
  SELECT g, min(t) FROM cells GROUP BY g
  UNION ALL
  SELECT a.g, min(c.t) FROM accepted a JOIN cells c ON c.g = a.g AND c.t >= a.t + 300000 GROUP BY a.g
),
deduped AS (
  SELECT c.* FROM cells c JOIN accepted a ON a.g = c.g AND a.t = c.t
  QUALIFY row_number() OVER (PARTITION BY c.g, c.t ORDER BY c.received_at, c.seq) = 1
)"""


def with_ctes(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select.strip()}"
