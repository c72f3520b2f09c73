import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ops, ordering, retention, schema_ops as S
from millrace.operators.config_log import apply_config, latest_config
from millrace.operators.ordering import asof_join
from millrace.operators.router import Endpoint, route
from millrace.operators.skew import hot_keys, salted_join
from millrace.schemas import small_df
from millrace.streaming.processor import Processor

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def test_salted_join_equals_join(spark):
    many = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
    one = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    assert [r.k for r in hot_keys(many, ["k"]).collect()] == [0]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = salted_join(many, one, ["k"], how), many.join(one, ["k"], how)
        assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def timed(spark, seed, n, key_hot):
    rng = random.Random(seed)
    rows = [dict(k="hot" if rng.random() < key_hot else f"k{rng.randrange(20)}", id=i, v=rng.randrange(10),
                 ts=T0 + dt.timedelta(seconds=rng.randrange(4000))) for i in range(n)]
    return rows, small_df(spark, rows, "k string, id long, v long, ts timestamp")


def test_running_totals(spark):
    rows, df = timed(spark, 3, 1500, 0.35)
    got = ordering.running(df, ["k"], "ts", ["id"], sums={"n": F.lit(1), "s": F.col("v")},
                           lasts={"seven": F.when(F.col("v") == 7, F.col("id"))}).collect()
    want, acc = {}, {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        a = acc.setdefault(r["k"], [0, 0, None])
        a[0] += 1
        a[1] += r["v"]
        a[2] = r["id"] if r["v"] == 7 else a[2]
        want[r["id"]] = tuple(a)
    assert {r.id: (r.n, r.s, r.seven) for r in got} == want


def test_ordered_partitions_splits_a_hot_key(spark):
    rows, df = timed(spark, 5, 4000, 0.9)
    msgs = df.select(F.lit("o").alias("org"), F.lit("s").alias("stream"), F.col("k").alias("message_key"),
                     F.col("ts").alias("received_at"), F.col("id").alias("seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordering.ordered_partitions(msgs).where("message_key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1


def test_interval_and_asof_brute_force(spark):
    rows, df = timed(spark, 11, 400, 0.4)
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    lefts, rights = [r for r in rows if r["id"] % 2 == 0], [r for r in rows if r["id"] % 2 == 1]
    got = {r.id: (r.n, int(r.total)) for r in ordering.preceding_totals(left, right, "k", "ts", "id", F.col("v"), 300, 60_000).collect()}
    want = {}
    for x in lefts:
        hits = [y["v"] for y in rights if y["k"] == x["k"] and 0 <= (x["ts"] - y["ts"]).total_seconds() <= 300]
        if hits:
            want[x["id"]] = (len(hits), sum(hits))
    assert got == want
    latest = {r.id: r.r_id for r in ordering.asof_join(left, right, "k", "ts", "id", "id").collect()}
    for x in lefts:
        hits = [(y["ts"], y["id"]) for y in rights if y["k"] == x["k"] and y["ts"] <= x["ts"]]
        assert latest[x["id"]] == (max(hits)[1] if hits else None)


def test_retention_classes(spark):
    part = dict(organization="o", topic="t", year="2024", month="01", day="01", hour="05", files=1, bytes=10)
    ddl = "retention string, organization string, topic string, year string, month string, day string, hour string, files long, bytes long"
    parts = small_df(spark, [dict(part, retention=c) for c in ("DAY", "WEEK", "THREE_MONTHS", "YEAR", "THREE_YEARS")], ddl)
    names = lambda now: {r.retention for r in retention.expired_partitions(parts, F.lit(now).cast("timestamp")).collect()}
    assert names("2024-01-02 04:59:59") == set() and names("2024-01-02 05:00:00") == {"DAY"}
    assert names("2025-01-01 05:00:00") == {"DAY", "WEEK", "THREE_MONTHS", "YEAR"}
    tiers = {r.retention: r.tier for r in retention.tier(parts, F.lit("2024-04-01 00:00:00").cast("timestamp")).collect()}
    assert tiers["YEAR"] == "ARCHIVE" and tiers["THREE_MONTHS"] == "STANDARD"
    with pytest.raises(Exception, match="unknown retention"):
        retention.expired_partitions(parts.withColumn("retention", F.lit("EVER")), F.current_timestamp()).collect()


def test_expire_deletes_only_when_asked(spark, scratch):
    from millrace.sources.lake import read_lake, write_lake
    path = scratch("lake")
    rows = [dict(line='{"x":1,"_ds_retention":"%s","_ds_organization":"o","_ds_topic":"t"}' % r, received_at=T0) for r in ("DAY", "YEAR")]
    write_lake(small_df(spark, rows, "line string, received_at timestamp"), path)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert retention.expire(spark, path, now).count() == 1 and read_lake(spark, path, "x int").count() == 2
    retention.expire(spark, path, now, dry_run=False)
    assert [r.retention for r in read_lake(spark, path, "x int").collect()] == ["YEAR"]


def test_schema_inference_literal(spark):
    lines = small_df(spark, [dict(line=t, file="f", pos=i) for i, t in enumerate(['{"a":1}', "", "{bad", '{"b":{"c":1},"a":"x"}'])],
                     "line string, file string, pos long")
    assert [(r.name, r.type) for r in S.infer_schema(lines).collect()] == [("a", "string"), ("b", "string")]
    with pytest.raises(ValueError):
        S.require_fields(S.infer_schema(lines.where("line = ''")))


def test_schema_versions(spark):
    fld = lambda n, t="string", r=False: dict(name=n, type=t, required=r)
    ddl = f"org string, topic string, version long, format string, fields array<{S.FIELD}>"
    reg = small_df(spark, [dict(org="o", topic="t", version=1, format="json", fields=[fld("a"), fld("b")])], ddl)
    cases = [([fld("b"), fld("a")], "json", "unchanged", 1), ([fld("a")], "json", "registered", 2),
             ([fld("a"), fld("b"), fld("c")], "json", "registered", 2), ([fld("a", "long"), fld("b")], "json", "incompatible", 1),
             ([fld("a"), fld("b"), fld("c", r=True)], "json", "incompatible", 1), ([fld("a", r=True), fld("b")], "json", "incompatible", 1),
             ([fld("a"), fld("b")], "avro", "format_conflict", 1)]
    for fields, fmt, outcome, version in cases:
        cand = small_df(spark, [dict(org="o", topic="t", version=0, format=fmt, fields=fields)], ddl).drop("version")
        done = S.register_schema(reg, cand)
        r = done.first()
        assert (r.outcome, r.version) == (outcome, version)
        assert S.next_registry(reg, done).count() == (2 if outcome == "registered" else 1)


def test_config_versions(spark):
    u = lambda seq, topic, expect=None, action="put": dict(org="o", seq=seq, topic=topic, action=action, expect=expect, config=f"c{seq}")
    log = [u(1, "topic1"), u(2, "topic2"), u(3, "topic2", expect=1), u(4, "topic2", expect=2), u(5, None), u(6, "topic1", action="delete", expect=4)]
    df = small_df(spark, log, "org string, seq long, topic string, action string, expect long, config string")
    done = apply_config(df)
    assert [(r.version, r.accepted) for r in done.orderBy("seq").collect()] == [(1, True), (2, True), (2, False), (3, True), (4, True), (5, True)]
    assert {r.topic: r.config for r in latest_config(done).collect()} == {"topic2": "c4", None: "c5"}


def test_task_status(spark):
    tasks = small_df(spark, [dict(org="o", task=t, queues=q) for t, q in (("none", []), ("gone", ["a"]), ("mix", ["a", "b"]))],
                     "org string, task string, queues array<string>")
    src = small_df(spark, [dict(org="o", task="mix", queue="a", state="RUNNING"), dict(org="o", task="mix", queue="b", state="UPDATING"),
                           dict(org="x", task="gone", queue="a", state="RUNNING")], "org string, task string, queue string, state string")
    assert {r.task: r.status for r in ops.task_status(tasks, src).collect()} == {"none": "RUNNING", "gone": "PAUSED", "mix": "UPDATING"}


def test_usage(spark):
    msgs = small_df(spark, [dict(org="o", received_at=T0 + dt.timedelta(seconds=20 * i), seq=i) for i in range(30)],
                    "org string, received_at timestamp, seq long")
    plans = small_df(spark, [dict(org="o", quota=10)], "org string, quota long")
    r = ops.usage(msgs, plans).select("requests", "exceeded", F.unix_seconds("first_over").alias("t")).first()
    assert (r.requests, r.exceeded, r.t) == (30, True, int(T0.timestamp()) + 200)


def test_router(spark):
    e = Endpoint("ip", "POST", "/user/{userId}/ip", query={"limit": True, "cursor": False}, headers={"Authorization": True},
                 cookies={"session": True}, content_types=("application/json",))
    base = dict(method="post", raw_path="/user/7/ip", query={"limit": "3"}, cookies=["Session=a", "session=b", "bare"],
                headers={"AUTHORIZATION": "x", "content-type": "application/json; charset=utf-8"})
    rows = [base, dict(base, method="GET"), dict(base, raw_path="/user/7"), dict(base, query={}), dict(base, cookies=[]),
            dict(base, headers={"authorization": "x"}), dict(base, raw_path="/user/7/ip/")]
    ddl = "method string, raw_path string, query map<string,string>, cookies array<string>, headers map<string,string>"
    df = small_df(spark, [dict(r, query=list(r["query"].items()), headers=list(r["headers"].items())) for r in rows], ddl)
    got = [(r.endpoint, dict(r.params)) for r in route(df, [e]).collect()]
    assert [n for n, _ in got] == ["ip", "default", "default", "default", "default", "default", "ip"]
    assert got[0][1] == {"userId": "7", "limit": "3", "cursor": None, "Authorization": "x", "session": "a; b"}


def test_asof_keeps_rows_without_key_or_time(spark):
    t = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, "a", t), (2, None, t), (3, "a", None)], "id long, k string, t timestamp")
    right = spark.createDataFrame([(7, "a", t), (8, None, t)], "id long, k string, t timestamp")
    got = {r.id: r.r_id for r in asof_join(left, right, "k", "t", "id", "id").collect()}
    assert got == {1: 7, 2: None, 3: None}


def test_unknown_stream_is_a_dead_letter(spark):
    rows = spark.createDataFrame([("in", "k", "m1", "b"), ("other", "k", "m2", "b"), (None, "k", "m3", "b")],
                                 "stream string, message_key string, message_id string, body string")
    p = Processor({"in": lambda df: df.select(F.lit("out").alias("topic"), "message_key", "message_id", "body")})
    assert [r.message_id for r in p.run(rows).collect()] == ["m1"]
    assert {r.message_id: r.failure for r in p.unknown(rows).collect()} == {
        "m2": "unknown source stream other", "m3": "unknown source stream null"}
