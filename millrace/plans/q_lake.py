"""Registered queries of the lake, its schemas and its retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lakekey import PARTS, parse_lake_key
from ..operators import ingest as I
from ..operators import retention as R
from ..operators import schema_ops as S
from ..operators.config_log import apply_config
from ..schemas import RETENTION_DAYS
from ..session import scratch_path
from ..sources import derived, lake as L
from ..sources.kv import read_kv, upsert_kv
from .shared import (MESSAGES, VALIDATED, enriched, epoch_ms, lake_for, lake_lines, validated, with_ctes)
from .sql import database_schema, lake_tables, table_name

QUERIES, ORACLES = {}, {}

BODY = "event_id long, event_type string, user_id long, value double, props struct<k:int>"
RAW = "event_id string, event_type string, user_id string, value string, props string, _ds_message_ts string"
PARTITION_SQL = """retention, org AS organization, topic, strftime(received_at, '%Y') AS year,
  strftime(received_at, '%m') AS month, strftime(received_at, '%d') AS day, strftime(received_at, '%H') AS hour"""


def lake_write(spark, sf):
    """Write all messages to a fresh lake and count what each folder holds."""
    path = scratch_path(spark, "lake")
    L.write_lake(lake_lines(spark, sf), path)
    return (L.read_lake(spark, path, "event_id long")
            .groupBy(*[c for c in PARTS if c != "filename"])
            .agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")))


QUERIES["lake_write"] = lake_write
ORACLES["lake_write"] = with_ctes(VALIDATED, f"""
SELECT {PARTITION_SQL}, count(*) AS n, CAST(sum(seq) AS BIGINT) AS ids FROM lake GROUP BY ALL""")


def lake_error_sink(spark, sf):
    """Records without routing metadata: bodies that never were enriched."""
    path = scratch_path(spark, "errors")
    good = enriched(spark, sf)
    bad = good.where("fields is null").select(F.decode("body", "UTF-8").alias("line"), "received_at")
    records = I.lake_lines(good).select("line", "received_at").unionByName(bad)
    L.write_errors(records, path)
    schema = "value string, result string, year string, month string, day string, hour string"
    back = spark.read.schema(schema).text(L.error_path(path))
    return back.groupBy("result", "year", "month", "day").agg(
        F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


QUERIES["lake_error_sink"] = lake_error_sink
ORACLES["lake_error_sink"] = with_ctes(VALIDATED, f"""
SELECT '{L.EXTRACTION_FAILED}' AS result, strftime(received_at, '%Y') AS year, strftime(received_at, '%m') AS month,
  strftime(received_at, '%d') AS day, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars
FROM parsed WHERE NOT is_object GROUP BY ALL""")


def lake_scan(spark, sf):
    """Typed read of every topic over two weeks of folders."""
    df = L.read_lake(spark, lake_for(spark, sf), BODY, since="2024-01-08-00", until="2024-01-22-12")
    return df.groupBy("organization", "topic", "retention").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum("props.k").alias("k"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


QUERIES["lake_scan"] = lake_scan
ORACLES["lake_scan"] = with_ctes(VALIDATED, """
SELECT org AS organization, topic, retention, count(*) AS n, count(DISTINCT user_id) AS users,
  CAST(sum(CAST(json_extract_string(body, '$.props.k') AS INTEGER)) AS BIGINT) AS k,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM lake WHERE received_at >= TIMESTAMP '2024-01-08 00:00:00' AND received_at < TIMESTAMP '2024-01-22 12:00:00'
GROUP BY ALL""")


def lake_files(spark, sf):
    """The folders of a topic's first page of files; file names differ from run to run."""
    return L.lake_files(spark, lake_for(spark, sf), "org0", "click", limit=1000).select(
        F.regexp_replace("key", "/[^/]*$", "").alias("folder"), (F.col("size") > 0).alias("filled"),
        (F.col("last_modified").isNotNull()).alias("dated")).distinct()


QUERIES["lake_files"] = lake_files
ORACLES["lake_files"] = with_ctes(VALIDATED, """
SELECT DISTINCT concat('retention=', retention, '/organization=', org, '/topic=', topic,
  strftime(received_at, '/year=%Y/month=%m/day=%d/hour=%H')) AS folder, true AS filled, true AS dated
FROM lake WHERE org = 'org0' AND topic = 'click' ORDER BY folder LIMIT 1000""")


def lake_key_parse(spark, sf):
    msgs = derived.messages(spark, sf)
    ts = F.col("received_at")
    name = F.concat(F.lit("f"), F.col("seq").cast("string"), F.lit(".gz"))
    key = F.concat(
        F.when(F.col("topic") == "signup", "result=").otherwise("retention="), F.lit("YEAR/organization="),
        F.col("org"), F.lit("/topic="), F.col("topic"), F.date_format(ts, "'/year='yyyy'/month='MM'/day='dd'/hour='HH'/'"), name)
    return msgs.select("seq", epoch_ms("received_at"), parse_lake_key(key).alias("k")).select("seq", "ms", "k.*")


QUERIES["lake_key_parse"] = lake_key_parse
ORACLES["lake_key_parse"] = with_ctes(MESSAGES, """
, keys AS (SELECT seq, ms, topic, concat(CASE topic WHEN 'signup' THEN 'result=' ELSE 'retention=' END,
  'YEAR/organization=', org, '/topic=', topic, strftime(received_at, '/year=%Y/month=%m/day=%d/hour=%H/'),
  'f', CAST(seq AS VARCHAR), '.gz') AS key, org, received_at FROM messages)
SELECT seq, ms, CASE WHEN ok THEN 'YEAR' END AS retention, CASE WHEN ok THEN org END AS organization,
  CASE WHEN ok THEN topic END AS topic, CASE WHEN ok THEN strftime(received_at, '%Y') END AS year,
  CASE WHEN ok THEN strftime(received_at, '%m') END AS month, CASE WHEN ok THEN strftime(received_at, '%d') END AS day,
  CASE WHEN ok THEN strftime(received_at, '%H') END AS hour,
  CASE WHEN ok THEN concat('f', CAST(seq AS VARCHAR), '.gz') ELSE key END AS filename
FROM (SELECT *, topic <> 'signup' AS ok FROM keys)""")


def kv_upsert(spark, sf):
    """Items arrive in three batches, one of them twice; the last write wins."""
    path = scratch_path(spark, "kv")
    items = I.store_items(enriched(spark, sf)).withColumn("batch", F.dayofmonth("received_at") % 3)
    for b in (2, 0, 1, 0):
        upsert_kv(items.where(F.col("batch") == b).drop("batch"), path, b)
    return read_kv(spark, path).select(
        "org", "pk", "sk", "ttl", "seq", epoch_ms("received_at"),
        F.get_json_object("attrs", "$.value").cast("double").alias("value"))


QUERIES["kv_upsert"] = kv_upsert
ORACLES["kv_upsert"] = with_ctes(VALIDATED, """
SELECT org, pk, sk, ttl, seq, ms, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value FROM store
QUALIFY row_number() OVER (PARTITION BY org, pk, sk ORDER BY received_at DESC, seq DESC) = 1""")


def schema_infer(spark, sf):
    return S.infer_schema(L.read_lines(spark, lake_for(spark, sf)))


QUERIES["schema_infer"] = schema_infer
ORACLES["schema_infer"] = with_ctes(VALIDATED, """
SELECT DISTINCT name, 'string' AS type FROM (
  SELECT unnest(json_keys(body)) AS name FROM lake
  UNION ALL SELECT '_ds_message_id' FROM lake WHERE message_id IS NOT NULL
  UNION ALL SELECT unnest(['_ds_message_ts', '_ds_message_key', '_ds_retention', '_ds_organization', '_ds_topic'])
    FROM lake)""")


def schema_infer_typed(spark, sf):
    lines = L.read_lines(spark, lake_for(spark, sf))
    topic = F.get_json_object("line", "$._ds_topic").alias("topic")
    typed = S.infer_schema_typed(lines.withColumn("topic", topic), ["topic"])
    # how many digits a decimal needs depends on the values
    return typed.select("topic", F.regexp_replace("schema", r"DECIMAL\([0-9,]+\)", "DECIMAL").alias("schema"))


QUERIES["schema_infer_typed"] = schema_infer_typed
ORACLES["schema_infer_typed"] = with_ctes(VALIDATED, """
SELECT DISTINCT topic, 'OBJECT<_ds_message_id: STRING, _ds_message_key: STRING, _ds_message_ts: BIGINT, _ds_organization: STRING, '
  || '_ds_retention: STRING, _ds_topic: STRING, event_id: BIGINT, event_type: STRING, props: OBJECT<k: BIGINT>, '
  || 'user_id: BIGINT, value: DECIMAL>' AS schema FROM lake""")


def _registry(spark, sf):
    """Version 1 per org and topic: the optional text fields its messages carry."""
    bodies = derived.messages(spark, sf).withColumn("line", F.decode("body", "UTF-8"))
    names = bodies.select("org", "topic", F.explode(F.json_object_keys("line")).alias("name"))
    field = F.struct("name", F.lit("string").alias("type"), F.lit(False).alias("required"))
    return (names.distinct().groupBy("org", "topic").agg(F.sort_array(F.collect_list(field)).alias("fields"))
            .select("org", "topic", F.lit(1).cast("long").alias("version"), F.lit("json").alias("format"), "fields"))


def schema_register(spark, sf):
    reg = _registry(spark, sf)
    extra = lambda n, req: F.array(F.struct(F.lit(n).alias("name"), F.lit("string").alias("type"),
                                            F.lit(req).alias("required")))
    topic = F.col("topic")
    changed = (
        F.when(topic == "view", F.concat("fields", extra("country", False)))
        .when(topic == "error", F.concat("fields", extra("code", True)))
        .when(topic == "purchase", F.transform("fields", lambda f: F.struct(
            f["name"], F.when(f["name"] == "value", "double").otherwise(f["type"]).alias("type"), f["required"])))
        .otherwise(F.col("fields")))
    candidates = reg.select(
        F.when(F.col("org") == "org2", "org9").otherwise(F.col("org")).alias("org"), "topic",
        F.when(topic == "signup", "avro").otherwise("json").alias("format"), changed.alias("fields"))
    done = S.register_schema(reg, candidates)
    return done.select("org", "topic", "outcome", "version", F.size("fields").alias("fields"),
                       F.coalesce(F.array_join("broken", ","), F.lit("")).alias("broken"))


QUERIES["schema_register"] = schema_register
ORACLES["schema_register"] = with_ctes(MESSAGES, """
, reg AS (SELECT org, topic, count(DISTINCT name) AS n FROM
  (SELECT org, topic, unnest(json_keys(body)) AS name FROM messages WHERE body[1] = '{' AND body <> '{bad')
  GROUP BY ALL),
o AS (SELECT *, CASE WHEN org = 'org2' THEN 'created' WHEN topic = 'signup' THEN 'format_conflict'
  WHEN topic = 'view' THEN 'registered' WHEN topic IN ('error', 'purchase') THEN 'incompatible' ELSE 'unchanged' END AS outcome
  FROM reg)
SELECT CASE org WHEN 'org2' THEN 'org9' ELSE org END AS org, topic, outcome,
  CAST(CASE outcome WHEN 'registered' THEN 2 ELSE 1 END AS BIGINT) AS version,
  CAST(n + CASE WHEN topic IN ('view', 'error') THEN 1 ELSE 0 END AS INTEGER) AS fields,
  CASE WHEN outcome <> 'incompatible' THEN '' WHEN topic = 'error' THEN 'code' ELSE 'value' END AS broken FROM o""")

CHECKED = [("event_id", "long", True), ("event_type", "string", True), ("user_id", "string", False),
           ("value", "double", True), ("country", "string", True)]


def schema_check(spark, sf):
    bodies = derived.messages(spark, sf).select("topic", F.decode("body", "UTF-8").alias("line"))
    return S.check_schema(bodies, CHECKED, by=["topic"])


QUERIES["schema_check"] = schema_check
ORACLES["schema_check"] = with_ctes(MESSAGES, """
, marked AS (SELECT topic, body[1] = '{' AND body <> '{bad' AS ok FROM messages)
SELECT topic, field, reason, count(*) AS n FROM (
  SELECT topic, unnest(CASE WHEN ok THEN ['user_id', 'country', 'props'] ELSE [''] END) AS field,
    unnest(CASE WHEN ok THEN ['type', 'missing', 'unknown'] ELSE ['malformed'] END) AS reason FROM marked) GROUP BY ALL""")

NOW = "2024-04-20 06:00:00"


def retention_expire(spark, sf):
    gone = R.expire(spark, lake_for(spark, sf), F.lit(NOW).cast("timestamp"))
    return gone.select("retention", "organization", "topic", "year", "month", "day", "hour",
                       F.unix_seconds("expires_at").alias("expires_at"))


_DAYS = "CASE retention " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RETENTION_DAYS.items()) + " END"
QUERIES["retention_expire"] = retention_expire
ORACLES["retention_expire"] = with_ctes(VALIDATED, f"""
, parts AS (SELECT DISTINCT {PARTITION_SQL}, date_trunc('hour', received_at) + to_days({_DAYS}) AS gone FROM lake)
SELECT retention, organization, topic, year, month, day, hour, CAST(epoch_us(gone) // 1000000 AS BIGINT) AS expires_at
FROM parts WHERE gone <= TIMESTAMP '{NOW}'""")


def tier_report(spark, sf):
    return R.tier(L.lake_partitions(spark, lake_for(spark, sf)), F.lit(NOW).cast("timestamp")).select(
        "retention", "tier", "partitions")


QUERIES["tier_report"] = tier_report
ORACLES["tier_report"] = with_ctes(VALIDATED, f"""
, parts AS (SELECT DISTINCT retention, org, topic, date_trunc('hour', received_at) AS h FROM lake)
SELECT retention, CASE WHEN retention NOT IN ('YEAR', 'THREE_YEARS') THEN 'STANDARD'
  WHEN date_diff('day', h, TIMESTAMP '{NOW}') >= 180 THEN 'DEEP_ARCHIVE'
  WHEN date_diff('day', h, TIMESTAMP '{NOW}') >= 90 THEN 'ARCHIVE' ELSE 'STANDARD' END AS tier,
  count(*) AS partitions FROM parts GROUP BY ALL""")


def catalog(spark, sf):
    """Tables of one org with the columns inferred from all of its lake lines."""
    lines = L.read_lines(spark, lake_for(spark, sf), org="org0")
    names = lines.select(F.get_json_object("line", "$._ds_topic").alias("topic"),
                         F.explode(F.json_object_keys("line")).alias("name")).distinct()
    columns = {}
    for r in names.orderBy("topic", "name").toLocalIterator():   # one row per field of a topic
        columns.setdefault(r.topic, []).append(f"`{r.name}` string")
    tables = lake_tables(lake_for(spark, sf), "org0", {t: ", ".join(c) for t, c in columns.items()})
    schema = database_schema(spark, tables)
    return schema.where(~F.col("column").isin([c for c in PARTS if c != "filename"])).select("table", "column", "type")


QUERIES["catalog"] = catalog
ORACLES["catalog"] = with_ctes(VALIDATED, """
SELECT DISTINCT concat('stream_', topic) AS "table", name AS "column", 'string' AS type FROM (
  SELECT topic, unnest(json_keys(body)) AS name FROM lake WHERE org = 'org0'
  UNION ALL SELECT topic, '_ds_message_id' FROM lake WHERE org = 'org0' AND message_id IS NOT NULL
  UNION ALL SELECT topic, unnest(['_ds_message_ts', '_ds_message_key', '_ds_retention', '_ds_organization', '_ds_topic'])
    FROM lake WHERE org = 'org0')""")


def config_updates(spark, sf):
    """Per customer a log of topic updates, some with an expected version."""
    o = derived.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    return o.select(
        F.concat(F.lit("org"), F.col("o_custkey").cast("string")).alias("org"), k.alias("seq"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("t"), (k % 4).cast("string"))).alias("topic"),
        F.when(status == "P", "delete").otherwise("put").alias("action"),
        F.when(status == "F", F.col("o_totalprice").cast("long") % 6).alias("expect"),
        F.col("o_orderpriority").alias("config"))


def topic_config(spark, sf):
    return apply_config(config_updates(spark, sf)).select("org", "seq", "version", "accepted")


QUERIES["topic_config"] = topic_config
ORACLES["topic_config"] = """
WITH RECURSIVE log AS (SELECT concat('org', CAST(o_custkey AS VARCHAR)) AS org, o_orderkey AS seq,
  CASE WHEN o_orderstatus = 'F' THEN CAST(trunc(o_totalprice) AS BIGINT) % 6 END AS expect,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
run AS (
  SELECT org, i, seq, CASE WHEN expect IS NULL OR expect = 0 THEN 1 ELSE 0 END AS version,
    expect IS NULL OR expect = 0 AS accepted FROM log WHERE i = 1
  UNION ALL
  SELECT l.org, l.i, l.seq, r.version + CASE WHEN l.expect IS NULL OR l.expect = r.version THEN 1 ELSE 0 END,
    l.expect IS NULL OR l.expect = r.version FROM run r JOIN log l ON l.org = r.org AND l.i = r.i + 1)
SELECT org, seq, CAST(version AS BIGINT) AS version, accepted FROM run"""


def topic_config_latest(spark, sf):
    from ..operators.config_log import latest_config
    return latest_config(apply_config(config_updates(spark, sf))).select(
        "org", F.coalesce("topic", F.lit("(default)")).alias("topic"), "config", "seq")


QUERIES["topic_config_latest"] = topic_config_latest
ORACLES["topic_config_latest"] = ORACLES["topic_config"].rsplit("SELECT org, seq", 1)[0] + """
SELECT r.org, CASE WHEN r.seq % 7 = 0 THEN '(default)' ELSE concat('t', CAST(r.seq % 4 AS VARCHAR)) END AS topic,
  o_orderpriority AS config, r.seq FROM run r JOIN orders ON o_orderkey = r.seq WHERE accepted
QUALIFY row_number() OVER (PARTITION BY r.org, topic ORDER BY r.seq DESC) = 1 AND o_orderstatus <> 'P'"""
