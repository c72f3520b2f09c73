"""Registered queries of stream processing. Streams run over files that Spark
wrote from the given tables, in order of time and several micro-batches."""

from __future__ import annotations

from pyspark.sql import Row, functions as F

from ..functions import payload as P
from ..operators import ingest as I
from ..operators import ops
from ..session import child_names, scratch_path, state_partitions
from ..sources import derived
from ..sources.kv import read_kv
from ..sources.lake import read_lake
from ..sources.messages import read_messages
from ..streaming import ingest as SI
from ..streaming import processor as SP
from ..streaming.dedup import read_accepted, start_dedup
from ..streaming.state import read_state, state_stream
from .q_sql import table_loaders
from .q_state import FOLDS, OPS, PIVOT
from .shared import DEDUPED, MESSAGES, VALIDATED, epoch_ms, valid, with_ctes

QUERIES, ORACLES = {}, {}

AVAILABLE = {"availableNow": True}
PARTS = 5


ROWS_PER_FILE = 20_000


def _dealt(ev):
    """Events dealt over the cores, to files that are not too small."""
    files = min(ev.sparkSession.sparkContext.defaultParallelism, ev.count() // ROWS_PER_FILE)
    return ev.repartition(files) if files > 1 else ev.coalesce(1)


def _timed_stream(df, ts, name):
    """Rows as a stream of one micro-batch per six days, oldest first, whatever their
    number: a task of the write makes a file, a micro-batch takes the files of a part."""
    spark, path, schema = df.sparkSession, scratch_path(df.sparkSession, name), df.schema
    width, none = df.rdd.getNumPartitions(), spark.createDataFrame([], schema)
    df = df.withColumn("_part", F.least(F.floor((F.dayofmonth(ts) - 1) / 6), F.lit(PARTS - 1)))
    for i in range(PARTS):
        (df.where(F.col("_part") == i).drop("_part").write.mode("append")
         .option("maxRecordsPerFile", 0).parquet(path))
        made = sum(n.endswith(".parquet") for n in child_names(spark, path))
        for _ in range((i + 1) * width - made):   # a task without rows makes no file
            none.coalesce(1).write.mode("append").parquet(path)
    return read_messages(spark, path, schema=schema, maxFilesPerTrigger=width)


def message_stream(spark, sf):
    return _timed_stream(derived.messages_from(_dealt(derived.events(spark, sf))), "received_at", "messages")


def _run(df, path, checkpoint):
    """Run an append stream to its end, into files."""
    with state_partitions(df.sparkSession):
        query = (df.writeStream.format("parquet").option("path", path)
                 .option("checkpointLocation", checkpoint).trigger(**AVAILABLE).start())
    query.awaitTermination()


def _run_updates(df, path, checkpoint):
    """Run an update stream to its end; the changed rows of each micro-batch."""
    with state_partitions(df.sparkSession):
        query = (df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                 .foreachBatch(lambda rows, b: rows.write.mode("overwrite").parquet(f"{path}/batch={b}"))
                 .trigger(**AVAILABLE).start())
    query.awaitTermination()
    return df.sparkSession.read.parquet(path)


def stream_source(spark, sf):
    out, cp = scratch_path(spark, "copy"), scratch_path(spark, "cp")
    _run(message_stream(spark, sf).select("seq", "org", "topic", F.octet_length("body").alias("bytes")), out, cp)
    return spark.read.parquet(out).groupBy("org", "topic").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("seq").alias("seqs"))


QUERIES["stream_source"] = stream_source
ORACLES["stream_source"] = with_ctes(MESSAGES, """
SELECT org, topic, count(*) AS n, CAST(sum(strlen(body)) AS BIGINT) AS bytes, CAST(sum(seq) AS BIGINT) AS seqs
FROM messages GROUP BY ALL""")


def stream_ingest(spark, sf):
    """All destinations from one stream of messages; counts per destination."""
    base, cp = scratch_path(spark, "ingest"), scratch_path(spark, "cp")
    with state_partitions(spark):
        query = SI.start_ingest(message_stream(spark, sf), derived.topics(spark), base, cp, AVAILABLE)
    query.awaitTermination()
    lake = read_lake(spark, f"{base}/lake", "event_id long").select(
        F.lit("lake").alias("dest"), F.col("organization").alias("org"), "topic")
    store = read_kv(spark, f"{base}/store").select(F.lit("store").alias("dest"), "org", "topic")
    rejects = spark.read.parquet(f"{base}/rejects").select(F.lit("rejects").alias("dest"), "org", "topic")
    streams = read_accepted(spark, f"{base}/streams").select(F.lit("streams").alias("dest"), "org", "topic")
    rows = lake.unionByName(store).unionByName(rejects).unionByName(streams)
    return rows.groupBy("dest", "org", "topic").agg(F.count("*").alias("n"))


QUERIES["stream_ingest"] = stream_ingest
ORACLES["stream_ingest"] = with_ctes(VALIDATED + DEDUPED, """
SELECT 'lake' AS dest, org, topic, count(*) AS n FROM lake GROUP BY ALL
UNION ALL SELECT 'store', org, topic, count(DISTINCT (pk, sk)) FROM store GROUP BY ALL
UNION ALL SELECT 'streams', org, topic, count(*) FROM deduped GROUP BY ALL
UNION ALL SELECT 'rejects', org, topic, count(*) FROM (SELECT org, topic FROM validated WHERE reject_code IS NOT NULL
  UNION ALL SELECT org, topic FROM parsed WHERE NOT is_object) r GROUP BY ALL""", recursive=True)


def stream_dedup(spark, sf):
    out, cp = scratch_path(spark, "dedup"), scratch_path(spark, "cp")
    fanned = I.fan_out(I.accepted(I.validate(message_stream(spark, sf), derived.topics(spark))))
    with state_partitions(spark):
        query = start_dedup(fanned, out, cp, AVAILABLE)
    query.awaitTermination()
    return read_accepted(spark, out).select("org", "stream", "message_key", "seq", epoch_ms("received_at"))


QUERIES["stream_dedup"] = stream_dedup
ORACLES["stream_dedup"] = with_ctes(VALIDATED + DEDUPED, """
SELECT org, stream, message_key, seq, t AS ms FROM deduped""", recursive=True)


def _state_checkpoint(spark, sf):
    """Run the operation log through the stateful stream; its checkpoint and changes."""
    out, cp = scratch_path(spark, "state"), scratch_path(spark, "cp")
    ops_in = _timed_stream(derived.state_ops_from(_dealt(derived.events(spark, sf))), "at", "ops")
    return cp, _run_updates(state_stream(ops_in), out, cp)


def state_read(spark, sf):
    """The live state of the stream, read from its state store."""
    state = read_state(spark, _state_checkpoint(spark, sf)[0])
    value = lambda a: F.col("attrs")[a][1]
    return state.select(
        "state_key", value("last_type").alias("last_type"), value("clicks").cast("double").alias("clicks"),
        value("spend").cast("double").alias("spend"),
        F.nullif(F.array_join(F.from_json(value("seen"), "array<string>"), ","), F.lit("")).alias("seen"),
        F.unix_seconds("at").alias("ttl"))


# a counter that was deleted and not added to again is absent in the live state
QUERIES["state_read"] = state_read
ORACLES["state_read"] = with_ctes(FOLDS, PIVOT.format(ttl="sec", where=""))


def state_stream_changes(spark, sf):
    """Entries changed per micro-batch."""
    changes = _state_checkpoint(spark, sf)[1]
    return changes.groupBy("state_key").agg(F.count("*").alias("changes"), F.unix_seconds(F.max("at")).alias("last"))


QUERIES["state_stream"] = state_stream_changes
ORACLES["state_stream"] = with_ctes(OPS, """
SELECT state_key, count(DISTINCT least((day("at") - 1) // 6, 4)) AS changes, max(sec) AS last FROM ops GROUP BY ALL""")


def _logins(ev):
    """All events as messages of two input streams, with the value as body."""
    return ev.select(
        F.when(F.col("event_type") == "signup", "evt_register").otherwise("evt_login").alias("stream"),
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("message_key"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"),
        F.to_json(F.struct("user_id", "value")).alias("body"), F.col("ts").alias("received_at"))


def last_value_by_key(spark, sf):
    """The sample flow: two input topics, the latest value per user as output."""
    msgs = _logins(derived.events(spark, sf)).withColumn("value", F.from_json("body", "value double").value)
    return SP.last_value(msgs, "message_key", "value", ["received_at", "seq"]).select(
        "message_key", "value", F.col("as_of.seq").alias("seq"))


QUERIES["last_value_by_key"] = last_value_by_key
ORACLES["last_value_by_key"] = """
SELECT CAST(user_id AS VARCHAR) AS message_key, value, event_id AS seq FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def processor(spark, sf):
    """One function per input stream, one output topic."""
    def send(topic):
        return lambda df: df.select(F.lit(topic).alias("topic"), "message_key", "message_id", F.col("body"))
    p = SP.Processor({"evt_login": send("last_ip"), "evt_register": send("welcome")})
    return p.run(_logins(derived.events(spark, sf))).groupBy("topic", "message_key").agg(
        F.count("*").alias("n"), F.sum(F.get_json_object("body", "$.value").cast("decimal(18,2)")).cast("double").alias("value"))


QUERIES["processor"] = processor
ORACLES["processor"] = """
SELECT CASE event_type WHEN 'signup' THEN 'welcome' ELSE 'last_ip' END AS topic, CAST(user_id AS VARCHAR) AS message_key,
  count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM events GROUP BY ALL"""


def _count_visits(state, row):
    """Handler: count per key, remember the last stream, send every tenth."""
    state.add_number("visits", 1)
    state.set_string("last", row.stream)
    if state.get_number("visits") % 10 == 0:
        return [Row(topic="milestone", message_key=row.message_key, message_id=row.message_id,
                    body=str(state.get_number("visits")))]
    return []


def keyed_session_state(spark, sf):
    """A stateful handler over a stream, state scoped by message key."""
    out, cp = scratch_path(spark, "milestones"), scratch_path(spark, "cp")
    stream = _timed_stream(_logins(_dealt(derived.events(spark, sf))), "received_at", "logins")
    _run(SP.stateful(stream, SP.key_scope("visits"), _count_visits), out, cp)
    return spark.read.parquet(out).select("message_key", "message_id", F.col("body").cast("int").alias("visits"))


QUERIES["keyed_session_state"] = keyed_session_state
ORACLES["keyed_session_state"] = """
SELECT message_key, message_id, visits FROM (
  SELECT CAST(user_id AS VARCHAR) AS message_key, concat('m', CAST(event_id AS VARCHAR)) AS message_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS visits
  FROM events) v WHERE visits % 10 = 0"""


def last_value_stream(spark, sf):
    """The sample flow as a stream: the latest value per user, kept as state."""
    out, cp = scratch_path(spark, "latest"), scratch_path(spark, "cp")
    stream = _timed_stream(_logins(_dealt(derived.events(spark, sf))), "received_at", "logins")
    latest = SP.last_value(stream.withColumn("value", F.from_json("body", "value double").value),
                           "message_key", "value", ["received_at", "seq"])
    changes = _run_updates(latest, out, cp)
    return changes.groupBy("message_key").agg(F.max_by(F.struct("value", "as_of"), "as_of").alias("x")).select(
        "message_key", "x.value", F.col("x.as_of.seq").alias("seq"))


QUERIES["last_value_stream"] = last_value_stream
ORACLES["last_value_stream"] = ORACLES["last_value_by_key"]


def stream_decode(spark, sf):
    """Bodies of each stream format, decoded and encoded again."""
    msgs = derived.messages(spark, sf)
    text = P.decode_body(F.col("body"), F.col("content_type"))
    as_json = P.decode(text, "JSON", "event_id long, value double")
    back = P.encode(P.decode(text, "BINARY"), "BINARY")
    is_json = F.col("content_type") == "application/json"
    binary = F.coalesce(F.col("content_type"), F.lit("-")).isin("-", "application/avro", "image/png")
    return msgs.select("seq", epoch_ms("received_at"), F.when(is_json, as_json["event_id"]).alias("event_id"),
                       F.when(is_json, as_json["value"]).alias("value"),
                       F.when(binary, back == text).alias("same"),
                       F.when(binary, F.octet_length(P.decode(text, "BINARY"))).alias("bytes"))


QUERIES["stream_decode"] = stream_decode
ORACLES["stream_decode"] = with_ctes(MESSAGES, """
SELECT seq, ms, CASE WHEN j THEN seq END AS event_id, CASE WHEN j THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS value,
  CASE WHEN b THEN true END AS same, CASE WHEN b THEN strlen(body) END AS bytes
FROM (SELECT *, content_type = 'application/json' AND body[1] = '{' AND body <> '{bad' AS j,
  content_type IS NULL OR content_type IN ('application/avro', 'image/png') AS b FROM messages) m""")


def partial_failure(spark, sf):
    """Records that fail are set apart, the rest of the batch goes on."""
    msgs = valid(spark, sf).withColumn("text", P.decode_body(F.col("body"), F.col("content_type")))
    out = SP.with_failures(msgs, P.parse_object(F.col("text")))
    counted = lambda df, name: df.groupBy("topic", name.alias("outcome")).agg(F.count("*").alias("n"))
    return counted(SP.good(out), F.lit("ok")).unionByName(counted(SP.dead_letters(out), F.col("failure")))


QUERIES["partial_failure"] = partial_failure
ORACLES["partial_failure"] = with_ctes(VALIDATED, """
SELECT topic, CASE WHEN message_key = '' THEN 'no message_key' WHEN message_id IS NULL THEN 'no message_id'
  WHEN kind NOT IN ('application/json', 'text/plain') OR body[1] <> '{' OR body = '{bad' THEN 'undecodable' ELSE 'ok' END AS outcome,
  count(*) AS n FROM valid GROUP BY ALL""")


def _parse_value(record):
    """Handler: fails on what is not a JSON object with a value."""
    import json
    return {"cents": round(json.loads(record["body"])["value"] * 100)}


def handler_failures(spark, sf):
    """User code per record; an exception is that record's failure only."""
    msgs = derived.messages(spark, sf).select("seq", epoch_ms("received_at"), F.decode("body", "UTF-8").alias("body"))
    out = SP.handle_each(msgs, _parse_value, "cents long")
    return out.select("seq", "ms", "cents", F.substring_index("failure", ":", 1).alias("failure"))


QUERIES["handler_failures"] = handler_failures
ORACLES["handler_failures"] = with_ctes(MESSAGES, """
SELECT seq, ms, CASE WHEN ok THEN CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) END AS cents,
  CASE WHEN NOT ok THEN 'JSONDecodeError' END AS failure
FROM (SELECT *, body[1] = '{' AND body <> '{bad' AS ok FROM messages) m""")


def replay(spark, sf):
    """A daily report over the history, fed back as messages and ingested."""
    sql = """SELECT concat(CAST(CAST(ts AS DATE) AS STRING), '/', event_type) AS id, event_type, count(*) AS n,
        sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY CAST(ts AS DATE), event_type"""
    msgs = SP.replay(spark, table_loaders(sf), sql, "org9", "daily", "event_type", "id",
                     F.lit("2024-02-01 00:00:00").cast("timestamp"))
    topics = derived.topics(msgs.sparkSession)
    lake = I.lake_lines(I.enrich(I.accepted(I.validate(msgs, topics))))
    text = lambda name: F.get_json_object("line", f"$.{name}")
    return lake.select(text("id").alias("id"), text("event_type").alias("event_type"), text("n").cast("long").alias("n"),
                       text("total").cast("double").alias("total"), text("_ds_topic").alias("topic"),
                       text("_ds_message_key").alias("message_key"), text("_ds_retention").alias("retention"))


QUERIES["replay"] = replay
ORACLES["replay"] = """
SELECT concat(CAST(CAST(ts AS DATE) AS VARCHAR), '/', event_type) AS id, event_type, count(*) AS n,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, 'daily' AS topic, event_type AS message_key,
  'THREE_MONTHS' AS retention FROM events GROUP BY CAST(ts AS DATE), event_type"""


def throughput_stream(spark, sf):
    """Throughput as a stream; the watermark only bounds its state, and the last
    windows stay open, so the check reads the update output."""
    out, cp = scratch_path(spark, "throughput"), scratch_path(spark, "cp")
    counts = ops.throughput(I.validate(message_stream(spark, sf), derived.topics(spark)), "1 hour", "7 days")
    changes = _run_updates(counts, out, cp)
    return changes.groupBy("org", "topic", F.unix_seconds("start").alias("start")).agg(
        F.max("messages").alias("messages"), F.max("bytes").alias("bytes"), F.max("rejects").alias("rejects"))


QUERIES["throughput_stream"] = throughput_stream
ORACLES["throughput_stream"] = with_ctes(VALIDATED, """
SELECT org, topic, epoch_us(date_trunc('hour', received_at)) // 1000000 AS start, count(*) AS messages,
  CAST(sum(strlen(body)) AS BIGINT) AS bytes, count(reject_code) AS rejects FROM validated GROUP BY ALL""")
