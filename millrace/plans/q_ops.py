"""Registered queries of routing, quotas, task status and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage, ops
from ..operators.router import Endpoint, route, route_by_table
from ..schemas import small_df
from ..sources import derived
from .shared import MESSAGES, VALIDATED, validated, with_ctes

QUERIES, ORACLES = {}, {}


def throughput(spark, sf):
    return ops.throughput(validated(spark, sf), "1 hour").select(
        "org", "topic", F.unix_seconds("start").alias("start"), "messages", "bytes", "rejects",
        F.round("error_rate", 6).alias("error_rate"))


QUERIES["throughput"] = throughput
ORACLES["throughput"] = with_ctes(VALIDATED, """
SELECT org, topic, epoch_us(date_trunc('hour', received_at)) // 1000000 AS start, count(*) AS messages,
  CAST(sum(strlen(body)) AS BIGINT) AS bytes, count(reject_code) AS rejects,
  round(count(reject_code) / count(*), 6) AS error_rate FROM validated GROUP BY ALL""")

QUOTA = {"org0": 100, "org1": 130}


def usage_quota(spark, sf):
    plans = small_df(spark, [dict(org=o, quota=q) for o, q in QUOTA.items()], "org string, quota long")
    return ops.usage(derived.messages(spark, sf), plans).select(
        "org", F.date_format("day", "yyyy-MM-dd").alias("day"), "requests", "quota", "exceeded",
        F.unix_micros("first_over").alias("first_over"))


QUERIES["usage_quota"] = usage_quota
ORACLES["usage_quota"] = with_ctes(MESSAGES, """
, numbered AS (SELECT org, strftime(received_at, '%Y-%m-%d') AS day, epoch_us(received_at) AS us,
  row_number() OVER (PARTITION BY org, CAST(received_at AS DATE) ORDER BY received_at, seq) AS n,
  CASE org WHEN 'org0' THEN 100 WHEN 'org1' THEN 130 END AS quota FROM messages)
SELECT org, day, count(*) AS requests, CAST(any_value(quota) AS BIGINT) AS quota,
  coalesce(count(*) > any_value(quota), false) AS exceeded, min(us) FILTER (WHERE n = quota + 1) AS first_over
FROM numbered GROUP BY org, day""")


def _status_inputs(spark, sf):
    """An order is a task, its priority names how many queues it declares, and
    its line items are the sources that exist."""
    orders = derived.table(spark, sf, "orders")
    org = F.concat(F.lit("org"), (F.col("o_custkey") % 3).cast("string")).alias("org")
    n = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    queue = lambda c: F.concat(F.lit("q"), c.cast("string"))
    queues = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), queue)).otherwise(F.array().cast("array<string>"))
    tasks = orders.select(org, F.col("o_orderkey").alias("task"), queues.alias("queues"))
    states = F.array(*[F.lit(s) for s in ops.STATE_WEIGHT])
    lines = derived.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    sources = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        org, F.col("o_orderkey").alias("task"), queue(F.col("l_linenumber")).alias("queue"),
        states[F.col("q").cast("int") % 6].alias("state"))
    return tasks, sources


def task_status(spark, sf):
    return ops.task_status(*_status_inputs(spark, sf))


QUERIES["task_status"] = task_status
ORACLES["task_status"] = """
WITH declared AS (SELECT o_orderkey AS task, concat('org', CAST(o_custkey % 3 AS VARCHAR)) AS org,
    unnest(range(1, CAST(substring(o_orderpriority, 1, 1) AS INTEGER))) AS q FROM orders),
sources AS (SELECT l_orderkey AS task, l_linenumber AS q, CAST(trunc(max(l_quantity)) AS INTEGER) % 6 AS w FROM lineitem GROUP BY ALL),
weighed AS (SELECT org, d.task, max(coalesce(w, 2)) AS w, count(*) AS n FROM declared d
  LEFT JOIN sources s ON s.task = d.task AND s.q = d.q GROUP BY ALL)
SELECT concat('org', CAST(o_custkey % 3 AS VARCHAR)) AS org, o_orderkey AS task,
  CASE coalesce(w, 0) WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'STARTING' WHEN 2 THEN 'PAUSED' WHEN 3 THEN 'PAUSING'
    WHEN 4 THEN 'UPDATING' ELSE 'CREATING' END AS status, coalesce(n, 0) AS queues
FROM orders LEFT JOIN weighed ON task = o_orderkey"""

ENDPOINTS = [
    Endpoint("submit", "POST", "/en/{id}", headers={"Authorization": True}, cookies={"session": True},
             content_types=("application/json",)),
    Endpoint("paged", "GET", "/{lang}/{id}", query={"page": True, "ref": False}),
    Endpoint("english", "GET", "/en/{id}", query={"utm_source": False}),
    Endpoint("any_get", "GET", "/{lang}/{id}", cookies={"session": True}),
]


def route_requests(spark, sf):
    p = F.col("params")
    return route(derived.http_log(spark, sf), ENDPOINTS).select(
        "page_id", "endpoint", p["lang"].alias("lang"), p["id"].alias("id"), p["page"].alias("page"),
        p["utm_source"].alias("utm"), p["session"].alias("session"), p["Authorization"].alias("auth"))


QUERIES["route_requests"] = route_requests
ORACLES["route_requests"] = """
WITH parts AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u, page_id % 3 <> 2 AS is_get, page_id % 4 AS m FROM pages),
req AS (SELECT *, regexp_extract(u, '^https?://[^/]+/([^/?]*)/([^/?]*)/*(\\?|$)', 1) AS lang,
  regexp_extract(u, '^https?://[^/]+/([^/?]*)/([^/?]*)/*(\\?|$)', 2) AS id,
  nullif(regexp_extract(u, '[?&]page=([^&]*)', 1), '') AS pg, nullif(regexp_extract(u, '[?&]utm_source=([^&]*)', 1), '') AS src FROM parts),
routed AS (SELECT *, CASE WHEN id = '' THEN 'default'
  WHEN NOT is_get AND lang = 'en' AND m = 0 THEN 'submit' WHEN is_get AND pg IS NOT NULL THEN 'paged'
  WHEN is_get AND lang = 'en' THEN 'english' WHEN is_get AND m < 2 THEN 'any_get' ELSE 'default' END AS endpoint FROM req)
SELECT page_id, endpoint, CASE WHEN endpoint IN ('paged', 'any_get') THEN lang END AS lang,
  CASE WHEN endpoint <> 'default' THEN id END AS id, CASE WHEN endpoint = 'paged' THEN pg END AS page,
  CASE WHEN endpoint = 'english' THEN src END AS utm,
  CASE WHEN endpoint IN ('submit', 'any_get') THEN 'a; b' END AS session,
  CASE WHEN endpoint = 'submit' THEN concat('t', CAST(page_id AS VARCHAR)) END AS auth FROM routed"""


def route_table(spark, sf):
    p = F.col("params")
    return route_by_table(derived.http_log(spark, sf), derived.endpoints(spark, sf), "page_id").select(
        "page_id", "endpoint", p["lang"].alias("lang"), p["id"].alias("id"), p["page"].alias("page"),
        p["Session"].alias("session"), p["Authorization"].alias("auth"))


QUERIES["route_table"] = route_table
ORACLES["route_table"] = """
WITH parts AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u, page_id % 3 <> 2 AS is_get, page_id % 4 AS m FROM pages),
req AS (SELECT *, regexp_extract(u, '^https?://[^/]+/([^/?]*)/([^/?]*)/*(\\?|$)', 1) AS lang,
  regexp_extract(u, '^https?://[^/]+/([^/?]*)/([^/?]*)/*(\\?|$)', 2) AS id,
  nullif(regexp_extract(u, '[?&]page=([^&]*)', 1), '') AS pg FROM parts),
a AS (SELECT id, min(page_id) AS pa FROM req WHERE id <> '' AND page_id % 5 = 0 GROUP BY ALL),
b AS (SELECT lang, id, min(page_id) AS pb FROM req WHERE id <> '' AND page_id % 5 = 1 GROUP BY ALL),
c AS (SELECT lang, min(page_id) AS pc FROM req WHERE id <> '' AND page_id % 5 = 2 GROUP BY ALL),
met AS (SELECT req.*, CASE WHEN is_get THEN pa END AS pa, CASE WHEN is_get AND pg IS NOT NULL THEN pb END AS pb,
  CASE WHEN NOT is_get AND m = 0 THEN pc END AS pc,
  CASE WHEN is_get AND m < 2 AND req.id <> '' THEN (SELECT max(page_id) + 1 FROM pages) END AS pd
  FROM req LEFT JOIN a ON a.id = req.id LEFT JOIN b ON b.lang = req.lang AND b.id = req.id
  LEFT JOIN c ON c.lang = req.lang AND req.id <> ''),
won AS (SELECT *, least(pa, pb, pc, pd) AS w FROM met)
SELECT page_id, CASE WHEN w IS NULL THEN 'default' WHEN w = pd THEN 'rest' ELSE concat('p', CAST(w AS VARCHAR)) END AS endpoint,
  CASE WHEN w = pa OR w = pd THEN lang END AS lang, CASE WHEN w = pc OR w = pd THEN id END AS id,
  CASE WHEN w = pa OR w = pb THEN pg END AS page, CASE WHEN w = pd THEN 'a; b' END AS session,
  CASE WHEN w = pc THEN concat('t', CAST(page_id AS VARCHAR)) END AS auth FROM won"""

EDGES = """
tasks AS (SELECT concat('org', CAST(o_custkey AS VARCHAR)) AS org, concat('t', CAST(o_orderkey AS VARCHAR)) AS task,
  CAST(round(o_totalprice * 100) AS BIGINT) % 12 AS q_in, unnest(CASE o_orderstatus WHEN 'F'
    THEN [day(o_orderdate) % 12, month(o_orderdate) % 12] ELSE [day(o_orderdate) % 12] END) AS q_out FROM orders),
edges AS (SELECT DISTINCT a.org, a.task AS src, b.task AS dst FROM tasks a JOIN tasks b ON a.org = b.org AND a.q_out = b.q_in)"""


def lineage_edges(spark, sf):
    return lineage.edges(derived.tasks(spark, sf))


QUERIES["lineage_edges"] = lineage_edges
ORACLES["lineage_edges"] = with_ctes(EDGES, "SELECT org, src, dst FROM edges")


def lineage_cycles(spark, sf):
    return lineage.cycles(derived.tasks(spark, sf))


QUERIES["lineage_cycles"] = lineage_cycles
ORACLES["lineage_cycles"] = with_ctes(EDGES + """,
reach(org, src, dst) AS (SELECT org, src, dst FROM edges
  UNION SELECT r.org, r.src, e.dst FROM reach r JOIN edges e ON e.org = r.org AND e.src = r.dst)""", """
SELECT org, src AS task FROM reach WHERE src = dst""", recursive=True)


def lineage_one_cycle(spark, sf):
    return lineage.one_cycle(derived.tasks(spark, sf)).select(
        "org", F.size("cycle").alias("n"), F.array_join("cycle", ">").alias("cycle"))


QUERIES["lineage_one_cycle"] = lineage_one_cycle
