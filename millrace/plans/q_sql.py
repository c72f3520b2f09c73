"""Registered queries around lake SQL, and the analyst queries that run through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import format as fmt
from ..functions.sqlgate import gate
from ..operators.ordering import asof_join, preceding_totals
from ..sources import derived
from . import analyst
from .shared import VALIDATED, lake_for, with_ctes
from .sql import history, lake_tables, page, run_sql

QUERIES, ORACLES = {}, {}

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()
BODY = ("event_id string, event_type string, user_id string, value string, "
        "_ds_message_ts string, _ds_message_key string")

QUERY_LOG = """
log AS (
  SELECT event_id, concat('org', CAST(user_id % 3 AS VARCHAR)) AS org, concat('q', CAST(event_id AS VARCHAR)) AS query_id,
    epoch_us(ts) // 1000 AS submitted_ms, concat('u', CAST(user_id AS VARCHAR)) AS "user",
    CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'drop table stream_' || event_type
      WHEN 2 THEN 'SELECT inserted FROM stream_' || event_type WHEN 3 THEN 'SELECT 1;' || chr(10) || 'DELETE FROM stream_' || event_type
      WHEN 4 THEN 'SELECT ''drop'' AS w, ' || event_id || ' AS n -- update later' WHEN 5 THEN 'Merge INTO t USING s ON t.id = ' || event_id
      ELSE 'SELECT * FROM stream_' || event_type || ' WHERE event_id = ' || event_id END AS sql,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'CANCELLED' WHEN 'view' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS state,
    CAST(floor(value * 100) AS BIGINT) * event_id AS bytes_scanned, event_id * 37 % 200000 AS elapsed_ms
  FROM events)"""


def table_loaders(sf):
    return {n: (lambda s, n=n: derived.table(s, sf, n)) for n in NAMES}


def _analyst(name):
    def query(spark, sf):
        return run_sql(spark, table_loaders(sf), analyst.SPARK[name])
    query.__name__ = name
    return query


for _name in analyst.SPARK:
    QUERIES[_name] = _analyst(_name)
ORACLES.update(analyst.CHECK)


def _side(spark, sf, kind):
    return derived.events(spark, sf).where(F.col("event_type") == kind).select("user_id", "ts", "event_id", "value")


def q_join_interval(spark, sf):
    """Clicks of the same user in the hour up to each purchase."""
    return preceding_totals(_side(spark, sf, "purchase"), _side(spark, sf, "click"), "user_id", "ts", "event_id",
                            F.col("value"), 3600).select(
        "user_id", "event_id", F.col("n").alias("clicks"), F.col("total").cast("double").alias("value"))


QUERIES["q_join_interval"] = q_join_interval
ORACLES["q_join_interval"] = """
SELECT p.user_id, p.event_id, count(*) AS clicks, CAST(sum(CAST(c.value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM events p JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase'
  AND c.ts BETWEEN p.ts - INTERVAL '1' HOUR AND p.ts GROUP BY ALL"""


def q_join_asof(spark, sf):
    """The latest click at or before each purchase of the same user; some have no user."""
    known = F.when(F.col("event_id") % 40 != 0, F.col("user_id")).alias("user_id")
    clicks = _side(spark, sf, "click").select(known, "ts", "event_id", F.lit(True).alias("is_click"))
    return asof_join(_side(spark, sf, "purchase").withColumn("user_id", known), clicks, "user_id", "ts", "event_id", "event_id").select(
        "event_id", "user_id", F.col("r_event_id").alias("click_id"),
        F.unix_micros("r_ts").alias("click_us"))


QUERIES["q_join_asof"] = q_join_asof
ORACLES["q_join_asof"] = """
SELECT p.event_id, p.user_id, c.event_id AS click_id, epoch_us(c.ts) AS click_us
FROM (SELECT event_id, ts, CASE WHEN event_id % 40 <> 0 THEN user_id END AS user_id FROM events
  WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id, ts, CASE WHEN event_id % 40 <> 0 THEN user_id END AS user_id FROM events
  WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""


def sql_gate(spark, sf):
    return derived.query_log(spark, sf).select("query_id", gate(F.col("sql")).alias("verdict"))


QUERIES["sql_gate"] = sql_gate
ORACLES["sql_gate"] = """
SELECT concat('q', CAST(event_id AS VARCHAR)) AS query_id, CASE WHEN event_id % 11 = 0 THEN 'empty'
  WHEN event_id % 11 IN (1, 3, 5) THEN 'forbidden' ELSE 'ok' END AS verdict FROM events"""


def run_sql_lake(spark, sf):
    """SQL over one org's topics in the lake, all columns text."""
    topics = ["click", "purchase", "view", "signup"]
    tables = lake_tables(lake_for(spark, sf), "org0", {t: BODY for t in topics})
    union = " UNION ALL ".join(f"SELECT event_type, user_id, value, _ds_message_ts FROM stream_{t}" for t in topics)
    return run_sql(spark, tables, f"""
        SELECT date_format(timestamp_millis(CAST(_ds_message_ts AS BIGINT)), 'yyyy-MM-dd') AS day, event_type,
          count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM ({union}) GROUP BY 1, 2""")


QUERIES["run_sql"] = run_sql_lake
ORACLES["run_sql"] = with_ctes(VALIDATED, """
SELECT strftime(received_at, '%Y-%m-%d') AS day, topic AS event_type, count(*) AS n, count(DISTINCT user_id) AS users,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM lake WHERE org = 'org0' AND topic <> 'error' GROUP BY ALL""")


def result_page(spark, sf):
    """The page after a given order date and key."""
    orders = derived.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_orderstatus",
        (F.col("o_totalprice") > 100000).alias("large"))
    return page(orders, ["day", "o_orderkey"], after=["1997-06-15", 500], n=1000)


QUERIES["result_page"] = result_page
ORACLES["result_page"] = """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
  CAST(o_totalprice > 100000 AS VARCHAR) AS large FROM orders
WHERE (strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) > ('1997-06-15', 500) ORDER BY o_orderdate, orders.o_orderkey LIMIT 1000"""

HISTORY_NOW = 1705665600  # 2024-01-19 12:00:00 UTC


def query_history(spark, sf):
    log = derived.query_log(spark, sf).where(F.col("submitted_ms") <= HISTORY_NOW * 1000)
    return history(log, "org1", F.lit(HISTORY_NOW), n=80).select(
        "query_id", "submitted_ms", "sql", "user", "state", "bytes_scanned", "elapsed_ms", "ttl")


QUERIES["query_history"] = query_history
ORACLES["query_history"] = with_ctes(QUERY_LOG, f"""
SELECT query_id, submitted_ms, sql, "user", state, bytes_scanned, elapsed_ms, submitted_ms // 1000 + 604800 AS ttl
FROM log WHERE org = 'org1' AND submitted_ms <= {HISTORY_NOW}000 AND submitted_ms // 1000 + 604800 >= {HISTORY_NOW}
ORDER BY submitted_ms DESC, query_id DESC LIMIT 80""")


def query_stats(spark, sf):
    """History by org and state: counts, bytes and slowest run."""
    return derived.query_log(spark, sf).groupBy("org", "state").agg(
        F.count("*").alias("n"), F.sum("bytes_scanned").alias("bytes"), F.max("elapsed_ms").alias("slowest"))


QUERIES["query_stats"] = query_stats
ORACLES["query_stats"] = with_ctes(QUERY_LOG, """
SELECT org, state, count(*) AS n, CAST(sum(bytes_scanned) AS BIGINT) AS bytes, max(elapsed_ms) AS slowest FROM log GROUP BY ALL""")


def _cells(spark, sf):
    return derived.table(spark, sf, "documents").select(
        "doc_id", F.col("text"), F.nullif("lang", F.lit("en")).alias("lang"),
        F.concat(F.lit('say "'), "source", F.lit('"')).alias("quoted"))


def result_csv(spark, sf):
    return fmt.to_csv_lines(_cells(spark, sf)).select("line", F.length("line").alias("len"))


QUERIES["result_csv"] = result_csv
ORACLES["result_csv"] = """
SELECT concat(CAST(doc_id AS VARCHAR), ',', CASE WHEN regexp_matches(text, '[,"\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END,
  ',', coalesce(nullif(lang, 'en'), ''), ',"say ""', source, repeat('"', 3)) AS line, length(line) AS len FROM documents"""


def result_json(spark, sf):
    lines = fmt.to_json_lines(_cells(spark, sf))
    text = lambda c: F.get_json_object("line", f"$.{c}").alias(c)
    return lines.select(text("doc_id"), F.md5(text("text")).alias("text"), text("lang"), text("quoted"),
                        F.array_join(F.json_object_keys("line"), ",").alias("names"))


QUERIES["result_json"] = result_json
ORACLES["result_json"] = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text, nullif(lang, 'en') AS lang, concat('say "', source, '"') AS quoted,
  'doc_id,text,lang,quoted' AS names FROM documents"""


def fmt_bytes(spark, sf):
    return derived.query_log(spark, sf).select("query_id", fmt.fmt_bytes(
        F.col("bytes_scanned") * F.col("elapsed_ms")).alias("size"))


QUERIES["fmt_bytes"] = fmt_bytes
ORACLES["fmt_bytes"] = with_ctes(QUERY_LOG, """
, b AS (SELECT query_id, bytes_scanned * elapsed_ms AS n FROM log)
SELECT query_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN format('{:.2f} B', CAST(n AS DOUBLE))
  WHEN n < 1048576 THEN format('{:.2f} KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN format('{:.2f} MB', n / 1048576.0::DOUBLE)
  WHEN n < 1099511627776 THEN format('{:.2f} GB', n / 1073741824.0::DOUBLE) ELSE format('{:.2f} TB', n / 1099511627776.0::DOUBLE) END AS size
FROM b""")


def fmt_duration(spark, sf):
    return derived.query_log(spark, sf).select("query_id", fmt.fmt_duration(F.col("elapsed_ms")).alias("took"))


QUERIES["fmt_duration"] = fmt_duration
ORACLES["fmt_duration"] = with_ctes(QUERY_LOG, """
SELECT query_id, CASE WHEN elapsed_ms = 0 THEN '0ms' WHEN elapsed_ms < 1000 THEN concat(CAST(elapsed_ms AS VARCHAR), 'ms')
  WHEN elapsed_ms < 60000 THEN concat(CAST(CAST(elapsed_ms / 1000 AS DECIMAL(18,1)) AS VARCHAR), 's')
  ELSE concat(CAST(CAST(elapsed_ms / 60000 AS DECIMAL(18,1)) AS VARCHAR), 'm') END AS took FROM log""")


def fmt_truncate(spark, sf):
    text = F.col("sql")
    return derived.query_log(spark, sf).select(
        "query_id", fmt.fmt_truncate(text, 30).alias("cli"), fmt.fmt_truncate(text, 30, total=False).alias("board"))


QUERIES["fmt_truncate"] = fmt_truncate
ORACLES["fmt_truncate"] = with_ctes(QUERY_LOG, """
SELECT query_id, CASE WHEN length(sql) > 30 THEN substring(sql, 1, 27) || '...' ELSE sql END AS cli,
  CASE WHEN length(sql) > 30 THEN substring(sql, 1, 30) || '...' ELSE sql END AS board FROM log""")
