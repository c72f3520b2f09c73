"""Registered queries of keyed state: folds over the operation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import merge_key
from ..operators import state as S
from ..operators.ingest import live
from ..sources import derived
from .shared import with_ctes

QUERIES, ORACLES = {}, {}

OPS = """
ops AS (
  SELECT concat('task:t:key:', CAST(user_id AS VARCHAR)) AS state_key, user_id, event_id AS seq, ts AS at,
    epoch_us(ts) // 1000000 AS sec,
    CASE event_type WHEN 'signup' THEN 'last_type' WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'spend'
      WHEN 'view' THEN 'seen' ELSE CASE WHEN event_id % 2 = 0 THEN 'clicks' ELSE 'seen' END END AS attr,
    CASE event_type WHEN 'signup' THEN 'set' WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'sadd'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'delete' ELSE 'sdel' END END AS op,
    CASE event_type WHEN 'signup' THEN 'signup' WHEN 'click' THEN '1'
      WHEN 'purchase' THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
      ELSE CAST(event_id % 5 AS VARCHAR) END AS value
  FROM events)"""

FOLDS = OPS + """,
registers AS (SELECT state_key, attr, arg_max(value, seq) AS value FROM ops WHERE op = 'set' GROUP BY ALL),
resets AS (SELECT state_key, attr, max(seq) AS since FROM ops WHERE op = 'delete' GROUP BY ALL),
counters AS (
  SELECT o.state_key, o.attr, sum(CASE WHEN since IS NULL OR seq > since THEN CAST(value AS DECIMAL(28,10)) ELSE 0 END) AS value
  FROM ops o LEFT JOIN resets r ON r.state_key = o.state_key AND r.attr = o.attr WHERE op = 'add' GROUP BY ALL),
members AS (
  SELECT state_key, attr, value, arg_max(op, seq) AS op FROM ops WHERE op IN ('sadd', 'sdel') GROUP BY ALL),
sets AS (
  SELECT state_key, attr, coalesce(string_agg(value, ',' ORDER BY value) FILTER (WHERE op = 'sadd'), '') AS value,
    count(*) FILTER (WHERE op = 'sadd') AS n FROM members GROUP BY ALL)"""

TTL = 43200
NOW = 1706616000  # 2024-01-30 12:00:00 UTC


def state_register(spark, sf):
    return S.fold_register(derived.state_ops(spark, sf)).select(
        "state_key", "attr", S.read_string(F.col("value")).alias("value"))


QUERIES["state_register"] = state_register
ORACLES["state_register"] = with_ctes(FOLDS, "SELECT state_key, attr, value FROM registers")


def state_counter(spark, sf):
    return S.fold_counter(derived.state_ops(spark, sf)).select(
        "state_key", "attr", F.col("value").cast("double").alias("value"))


QUERIES["state_counter"] = state_counter
ORACLES["state_counter"] = with_ctes(FOLDS, """
SELECT state_key, attr, CAST(value AS DOUBLE) AS value FROM counters""")


def state_set(spark, sf):
    return S.fold_set(derived.state_ops(spark, sf)).select(
        "state_key", "attr", F.array_join("value", ",").alias("members"))


QUERIES["state_set"] = state_set
ORACLES["state_set"] = with_ctes(FOLDS, "SELECT state_key, attr, value AS members FROM sets")


def state_json(spark, sf):
    """Each event stores its properties as JSON under its type; the last is read typed."""
    ev = derived.events(spark, sf)
    ops = ev.select(
        F.array(F.lit("task"), F.lit("t"), F.lit("key"), F.col("user_id").cast("string")).alias("key_parts"),
        F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("attr"),
        F.lit("set_json").alias("op"), F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("value"))
    return S.fold_json(ops, "k int").select("state_key", "attr", F.col("value.k").alias("k"))


QUERIES["state_json"] = state_json
ORACLES["state_json"] = """
SELECT concat('task:t:key:', CAST(user_id AS VARCHAR)) AS state_key, event_type AS attr,
  CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(arg_max(props, event_id), '$.k') AS INTEGER) END AS k
FROM events GROUP BY user_id, event_type"""


def state_delete(spark, sf):
    return S.fold_delete(derived.state_ops(spark, sf)).select(
        "state_key", "attr", F.unix_seconds("last_write").alias("last_write"))


QUERIES["state_delete"] = state_delete
ORACLES["state_delete"] = with_ctes(OPS, """
SELECT state_key, attr, max(sec) AS last_write FROM ops GROUP BY ALL HAVING arg_max(op, seq) = 'delete'""")


def state_ttl(spark, sf):
    return live(S.fold_ttl(derived.state_ops(spark, sf), TTL), NOW)


QUERIES["state_ttl"] = state_ttl
ORACLES["state_ttl"] = with_ctes(OPS, f"""
SELECT state_key, max(sec) + {TTL} AS ttl FROM ops GROUP BY ALL HAVING max(sec) + {TTL} >= {NOW}""")


def _state(spark, sf):
    return S.fold_state(derived.state_ops(spark, sf), TTL)


def state_list(spark, sf):
    """The second page of the keys that start like user 1's."""
    return S.state_list(_state(spark, sf), ["task", "t", "key", "1"], limit=40, after="task:t:key:10").select(
        "state_key", "ttl", F.size("key_parts").alias("parts"))


QUERIES["state_list"] = state_list
ORACLES["state_list"] = with_ctes(OPS, f"""
SELECT state_key, max(sec) + {TTL} AS ttl, 4 AS parts FROM ops
WHERE state_key LIKE 'task:t:key:1%' AND state_key > 'task:t:key:10' GROUP BY ALL ORDER BY state_key LIMIT 40""")


def state_pivot(spark, sf):
    wide = S.state_pivot(_state(spark, sf), ["last_type", "clicks", "spend", "seen"])
    return wide.select("state_key", F.try_parse_json("last_type").cast("string").alias("last_type"),
                       F.col("clicks").cast("double").alias("clicks"), F.col("spend").cast("double").alias("spend"),
                       F.array_join(F.from_json("seen", "array<string>"), ",").alias("seen"), "ttl")


# an attribute whose last operation deleted it has no entry
LIVE = """c WHERE (state_key, attr) NOT IN
  (SELECT (state_key, attr) FROM (SELECT state_key, attr, arg_max(op, seq) AS op FROM ops GROUP BY ALL) d WHERE op = 'delete')"""
PIVOT = """
SELECT state_key, max(CASE WHEN attr = 'last_type' THEN value END) AS last_type,
  max(CASE WHEN attr = 'clicks' THEN CAST(value AS DOUBLE) END) AS clicks,
  max(CASE WHEN attr = 'spend' THEN CAST(value AS DOUBLE) END) AS spend,
  max(CASE WHEN attr = 'seen' AND value <> '' THEN value END) AS seen, {ttl} AS ttl
FROM (SELECT state_key, attr, value FROM registers UNION ALL SELECT state_key, attr, CAST(value AS VARCHAR) FROM counters {live}
  UNION ALL SELECT state_key, attr, value FROM sets) s
JOIN (SELECT state_key, max(sec) AS sec FROM ops GROUP BY ALL) t USING (state_key) {where} GROUP BY state_key, sec""".replace("{live}", LIVE)
QUERIES["state_pivot"] = state_pivot
ORACLES["state_pivot"] = with_ctes(FOLDS, PIVOT.format(ttl=f"sec + {TTL}", where=""))


def state_get(spark, sf):
    """Look up the state of every customer key; users without state find none."""
    keys = derived.table(spark, sf, "customer").select(merge_key(F.array(
        F.lit("task"), F.lit("t"), F.lit("key"), F.col("c_custkey").cast("string"))).alias("state_key"))
    return S.state_get(_state(spark, sf), keys).select(
        "state_key", F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("attrs"), "ttl")


QUERIES["state_get"] = state_get
WHOLE = f"""
SELECT t.state_key, coalesce(string_agg(attr, ',' ORDER BY attr), '') AS attrs, sec + {TTL} AS ttl
FROM (SELECT state_key, max(sec) AS sec FROM ops GROUP BY ALL) t
LEFT JOIN (SELECT state_key, attr FROM registers UNION ALL SELECT state_key, attr FROM counters {LIVE}
  UNION ALL SELECT state_key, attr FROM sets WHERE n > 0) a ON a.state_key = t.state_key GROUP BY t.state_key, sec"""
ORACLES["state_get"] = with_ctes(FOLDS, f"""
SELECT w.* FROM ({WHOLE}) w JOIN customer ON w.state_key = concat('task:t:key:', CAST(c_custkey AS VARCHAR))""")


def _put_entries(spark, sf):
    """One whole entry per user who ever had an error."""
    errors = derived.events(spark, sf).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    parts = F.array(F.lit("task"), F.lit("t"), F.lit("key"), F.col("user_id").cast("string"))
    return errors.select(
        merge_key(parts).alias("state_key"), parts.alias("key_parts"),
        F.create_map(F.lit("errors"), F.col("n").cast("string")).alias("attrs"), F.lit(None).cast("long").alias("ttl"))


def _summary(state):
    return state.select("state_key", F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("attrs"),
                        F.col("attrs")["errors"].alias("errors"), "ttl")


_ERRORS = f""",
put AS (SELECT concat('task:t:key:', CAST(user_id AS VARCHAR)) AS state_key, count(*) AS n FROM events
  WHERE event_type = 'error' GROUP BY ALL),
whole AS ({WHOLE})"""


def state_put(spark, sf):
    return _summary(S.state_put(_state(spark, sf), _put_entries(spark, sf)))


QUERIES["state_put"] = state_put
ORACLES["state_put"] = with_ctes(FOLDS + _ERRORS, """
SELECT state_key, attrs, CAST(NULL AS VARCHAR) AS errors, ttl FROM whole WHERE state_key NOT IN (SELECT state_key FROM put)
UNION ALL SELECT state_key, 'errors', CAST(n AS VARCHAR), NULL FROM put""")


def state_drop(spark, sf):
    keys = _put_entries(spark, sf).select("state_key")
    return _summary(S.state_drop(_state(spark, sf), keys)).drop("errors")


QUERIES["state_drop"] = state_drop
ORACLES["state_drop"] = with_ctes(FOLDS + _ERRORS, """
SELECT state_key, attrs, ttl FROM whole WHERE state_key NOT IN (SELECT state_key FROM put)""")
