import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest as I
from millrace.operators.config import resolve_topics
from millrace.operators.dedup import dedup
from millrace.schemas import MESSAGES, small_df, store_def, store_key, topic_row, topics_df
from millrace.sources import derived
from millrace.sources.kv import read_kv, upsert_kv
from millrace.sources.lake import error_path, lake_files, read_lake, write_errors, write_lake

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def msg(seq, body, topic="registration", key="message-key", mid="message-id", kind="application/json",
        org="o", at=T0):
    return dict(seq=seq, org=org, topic=topic, message_key=key, message_id=mid, content_type=kind,
                body=body.encode() if isinstance(body, str) else body, received_at=at)


def config(spark):
    store = store_def(["ship"], ["deck"], "cabin", 1000, whitelist=["ship", "deck", "beds"], blacklist=["secret"],
                      indexes=[store_key("GSI", 1, ["deck", "ship"], ["ship"], "byDeck")])
    return topics_df(spark, [
        topic_row("o", "registration", has_batch=True, retention="YEAR", streams=["registration"]),
        topic_row("o", "items", store=store),
        topic_row("o", "raw", streams=["raw"]),
        topic_row("closed", None, allow_undefined=False),
        topic_row("week", None, allow_undefined=True, has_batch=True, retention="WEEK"),
    ])


def test_end_to_end_message(spark):
    body = '{\n  "key": "val\\nue"\n}'
    res = I.ingest(small_df(spark, [msg(1, body)], MESSAGES), config(spark))
    assert bytes(res.streams.first().body).decode() == body
    line = res.lake.first().line
    assert "\n" not in line
    assert json.loads(line) == {
        "key": "val\nue", "_ds_message_ts": 1704067200000, "_ds_message_key": "message-key",
        "_ds_message_id": "message-id", "_ds_retention": "YEAR", "_ds_organization": "o",
        "_ds_topic": "registration"}
    assert res.rejects.count() == 0 and res.store.count() == 0


def test_metadata_wins_and_nulls_drop(spark):
    body = '{"_ds_topic":"forged","a":null,"n":1,"s":"1"}'
    line = I.ingest(small_df(spark, [msg(1, body, mid=None)], MESSAGES), config(spark)).lake.first().line
    got = json.loads(line)
    assert got["_ds_topic"] == "registration" and "a" not in got and "_ds_message_id" not in got
    assert got["n"] == 1 and got["s"] == "1"


def test_store_item(spark):
    body = '{"ship":"Argo","deck":3,"beds":[2,4],"secret":"x","other":1}'
    item = I.ingest(small_df(spark, [msg(1, body, topic="items")], MESSAGES), config(spark)).store.first()
    assert (item.pk, item.sk) == ('"Argo"', "cabin:3")
    assert item.index_keys == {"gsipk1": '3:"Argo"', "gsisk1": 'byDeck:"Argo"'}
    assert json.loads(item.attrs) == {"ship": "Argo", "deck": 3, "beds": "[2,4]"}
    assert item.ttl == 1704067200 + 1000


def test_validation_order_and_limits(spark):
    cases = [
        (msg(1, "{}", key=""), 400), (msg(2, "{}", org="closed"), 404),
        (msg(3, "{}", kind=None), 415), (msg(4, "{}", kind="text/plain"), 415),
        (msg(5, "x" * 262144), None), (msg(6, "x" * 262145), 413),
        (msg(7, "x", topic="raw", kind="image/png"), 415),
        (msg(8, "x" * 262145, topic="raw", kind="image/png"), 413),
        (msg(9, b"\x00\xff", topic="raw", kind=None), None),
        (msg(10, "{}", kind="application/json; charset=utf-8"), None),
        (msg(11, "{}", org="closed", key=""), 400),
    ]
    df = I.validate(small_df(spark, [m for m, _ in cases], MESSAGES), config(spark))
    got = {r.seq: r.reject_code for r in df.select("seq", "reject_code").collect()}
    assert got == {m["seq"]: code for m, code in cases}


def test_topic_fallback(spark):
    rows = [msg(i, "{}", org=o, topic=t) for i, (o, t) in enumerate(
        [("new", "x"), ("closed", "x"), ("week", "x"), ("o", "registration"), ("o", "other")])]
    df = resolve_topics(small_df(spark, rows, MESSAGES), config(spark))
    got = {r.seq: r.r for r in df.select("seq", F.col("cfg.retention").alias("r")).collect()}
    assert got == {0: "THREE_MONTHS", 1: None, 2: "WEEK", 3: "YEAR", 4: "THREE_MONTHS"}


def test_highest_version_of_a_topic(spark):
    topics = topics_df(spark, [topic_row("o", "t", has_batch=True, retention=r, version=v)
                               for r, v in (("WEEK", 2), ("YEAR", 7), ("DAY", None))]
                       + [topic_row("o", None, has_batch=True, retention=r, version=v) for r, v in (("DAY", 1), ("WEEK", 3))])
    df = resolve_topics(small_df(spark, [msg(1, "{}", topic="t"), msg(2, "{}", topic="u")], MESSAGES), topics)
    assert sorted((r.seq, r.cfg.retention) for r in df.collect()) == [(1, "YEAR"), (2, "WEEK")]


def test_conservation(spark, sf_dir):
    msgs, topics = derived.messages(spark, sf_dir), derived.topics(spark)
    v = I.validate(msgs, topics)
    assert v.count() == msgs.count()
    res = I.ingest(msgs, topics)
    refused = res.rejects.where("reject_code <> 422").count()
    assert I.accepted(v).count() + refused == msgs.count()


def brute_dedup(rows, width):
    last, keep = {}, []
    for g, t, s in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if g not in last or t - last[g] >= width:
            last[g] = t
            keep.append(s)
    return sorted(keep)


def stream_rows(spark, rows):
    return small_df(spark, [
        dict(org="o", stream="s", message_key="k", message_id=g, body=b"x", seq=s,
             received_at=T0 + dt.timedelta(milliseconds=t)) for g, t, s in rows],
        "org string, stream string, message_key string, message_id string, body binary, seq long, "
        "received_at timestamp")


def test_dedup_matches_replay(spark):
    import random
    rng = random.Random(7)
    rows, seq = [], 0
    for g in range(30):
        for _ in range(rng.choice([1, 2, 5, 60])):
            seq += 1
            rows.append((f"g{g}", rng.randrange(0, rng.choice([2, 30, 400]) * 100), seq))
    for t in range(0, 60_000, 130):   # one hot id with an unbroken chain
        seq += 1
        rows.append(("hot", t, seq))
    got = dedup(stream_rows(spark, rows), "1 second")
    assert sorted(r.seq for r in got.select("seq").collect()) == brute_dedup(rows, 1000)


def test_dedup_without_id_uses_content(spark):
    rows = stream_rows(spark, [(None, 0, 1), (None, 10, 2), (None, 400_000, 3)])
    assert sorted(r.seq for r in dedup(rows).collect()) == [1, 3]


def test_lake_roundtrip(spark, sf_dir, scratch):
    res = I.ingest(derived.messages(spark, sf_dir), derived.topics(spark))
    path = scratch("lake")
    write_lake(res.lake, path)
    back = read_lake(spark, path, "event_id long, _ds_topic string")
    assert back.count() == res.lake.count()
    assert back.where("topic <> _ds_topic or event_id is null").count() == 0
    page = lake_files(spark, path, "org0", "click", limit=5)
    first = [r.key for r in page.collect()]
    assert len(first) == 5 and first == sorted(first)
    second = lake_files(spark, path, "org0", "click", limit=5, after=first[-1]).collect()
    assert second[0].key > first[-1]


def test_pages_walk_the_folders_in_key_order(spark, scratch, monkeypatch):
    """All pages together are all files in order, and a page lists few folders."""
    from millrace.sources import lake
    path = scratch("lake")
    line = '{"_ds_retention":"%s","_ds_organization":"o","_ds_topic":"%s"}'
    write_lake(small_df(spark, [dict(line=line % (r, t), received_at=T0 + dt.timedelta(hours=7 * i))
                                for i in range(40) for r, t in (("DAY", "a"), ("YEAR", "a"), ("DAY", "ab"))],
                        "line string, received_at timestamp"), path)
    listed = []
    list_folder = lake.list_folder
    monkeypatch.setattr(lake, "list_folder", lambda s, p: listed.append(p) or list_folder(s, p))
    keys, after, most = [], None, 0
    while page := [r.key for r in lake_files(spark, path, "o", "a", limit=7, after=after).collect()]:
        keys, after, most, listed[:] = keys + page, page[-1], max(most, len(listed)), []
    want = sorted(r.key for r in lake.all_files(spark, path, "o", "a").collect())
    assert keys == want and len(keys) == 80 and most < 40
    days = [r.key for r in lake_files(spark, path, "o", "a", prefix="year=2024/month=01/day=02/").collect()]
    assert days == [k for k in want if "/day=02/" in k] and days
    assert [r.key for r in lake_files(spark, path, "o", "none").collect()] == []


def test_prefix_topics_and_malformed(spark, scratch):
    path = scratch("lake")
    line = '{"x":%d,"_ds_retention":"DAY","_ds_organization":"o","_ds_topic":"%s"}'
    rows = [dict(line=line % (1, "a"), received_at=T0), dict(line=line % (2, "ab"), received_at=T0),
            dict(line="{bad", received_at=T0)]
    df = small_df(spark, rows, "line string, received_at timestamp")
    write_lake(df, path)
    write_errors(df, path)
    assert [r.x for r in read_lake(spark, path, "x int", topic="a").collect()] == [1]
    assert [r.value for r in spark.read.option("recursiveFileLookup", True).text(error_path(path)).collect()] == ["{bad"]
    plan = read_lake(spark, path, "x int", since="2024-01-01-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert read_lake(spark, path, "x int", since="2024-01-01-01").count() == 0


def test_kv_upsert_is_idempotent(spark, scratch):
    path = scratch("kv")
    ddl = "org string, pk string, sk string, attrs string, received_at timestamp, seq long"
    row = lambda pk, a, s: dict(org="o", pk=pk, sk="s", attrs=a, received_at=T0, seq=s)
    one = small_df(spark, [row("a", "1", 1), row("a", "2", 2), row("b", "3", 3)], ddl)
    two = small_df(spark, [row("a", "9", 4)], ddl)
    for batch, df in ((0, one), (1, two), (0, one)):
        upsert_kv(df, path, batch)
    assert {(r.pk, r.attrs) for r in read_kv(spark, path).collect()} == {("a", "9"), ("b", "3")}
