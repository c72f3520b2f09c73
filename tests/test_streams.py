"""Streams: one-pass ingest, dedup by keyed state, state in any order, expiry."""

import datetime as dt
import json
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import Row, functions as F

from millrace.functions import payload
from millrace.operators import state as S
from millrace.schemas import MESSAGES, STATE_OPS, small_df, store_def, topic_row, topics_df
from millrace.sources import kv
from millrace.sources.kv import clean_kv, read_item, read_kv, upsert_kv
from millrace.sources.lake import all_files, read_lake
from millrace.sources.messages import read_messages
from millrace.streaming.dedup import read_accepted, start_dedup
from millrace.streaming.ingest import DESTINATIONS, IngestSink, parsed_once, start_ingest
from millrace.streaming.dedup import PAGE, AcceptTimes, PagedAcceptTimes
from millrace.streaming.state import HELD, KeyedProcessor, StateEntry, read_state, state_stream

from .test_state import log, random_log

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
NOW = {"availableNow": True}


def files(parts, path):
    """One file and so one micro-batch for each part."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)


# --- dedup

def test_dedup_out_of_order(spark, scratch):
    """Shuffled micro-batches: nothing is lost, nothing is let through twice, and one
    clock far ahead changes no other id."""
    rng = random.Random(5)
    rows = [(i, "o", "s", f"k{i % 3}", f"m{i % 4}", T0 + dt.timedelta(seconds=rng.randrange(4000))) for i in range(120)]
    rows.append((999, "o", "s", "ahead", "m", T0 + dt.timedelta(days=400)))
    rng.shuffle(rows)
    ddl = "seq long, org string, stream string, message_key string, message_id string, received_at timestamp"
    src, path, cp = scratch("src"), scratch("dedup"), scratch("cp")
    parts = [spark.createDataFrame(rows[b::3], ddl).select(
        "seq", F.lit("t").alias("topic"), "message_key", "message_id", F.lit("application/json").alias("content_type"),
        F.lit(b"{}").alias("body"), "received_at", "org", "stream") for b in range(3)]
    files(parts, src)
    stream = read_messages(spark, src, schema=parts[0].schema, maxFilesPerTrigger=1)
    start_dedup(stream, path, cp, NOW).awaitTermination()
    taken = {}
    for r in read_accepted(spark, path).collect():
        taken.setdefault((r.message_key, r.message_id), []).append(r.received_at.timestamp())
    for times in taken.values():
        times.sort()
        assert all(b - a >= 300 for a, b in zip(times, times[1:]))
    for _, _, _, key, mid, at in rows:
        assert any(abs(at.timestamp() - t) < 300 for t in taken[key, mid])


class Store:
    """A state store in memory that counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.values = 0, [], {}, {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Reads())

    def getValueState(self, name, _):
        return self.values.setdefault(name, Value())

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def asked(self):
        return self.calls + sum(s.asked for s in (*self.maps.values(), *self.values.values()))


class Value:
    def __init__(self):
        self.value, self.asked = None, 0

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def clear(self):
        self.value = None


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def copies(ids, t, now):
    return [Row(id=i, org="o", stream="s", t=t, received_at=t, seq=n, now_ms=now) for n, i in enumerate(ids)]


def test_dedup_asks_the_store_twice_for_an_id():
    store, marks = Store(), AcceptTimes(300, 1000)
    marks.init(store)
    ids = [f"m{i}" for i in range(200)]
    assert len(list(marks.handleInputRows((1,), copies(ids, 0, 50), Clock(0)))) == 200
    assert store.asked() <= 2 * len(ids) + 3 and store.timers == [1050]


def test_dedup_forgets_by_the_clock():
    """Ids are forgotten when their time is over, and removed by the timer of their group."""
    store, marks = Store(), AcceptTimes(300, 1000)
    marks.init(store)
    take = lambda ids, t, now, clock: [r.seq for r in marks.handleInputRows((1,), copies(ids, t, now), Clock(clock))]
    assert take(["a", "b"], 0, 0, 0) == [0, 1] and take(["a"], 500, 500, 0) == [0]
    assert take(["a", "b"], 100, 900, 500) == []
    list(marks.handleExpiredTimer((1,), Clock(1000), Clock(1000)))
    assert set(store.maps["times"].data) == {("a",)} and store.timers == [1000, 1500]
    assert take(["a", "b"], 100, 1100, 1000) == [1]
    assert take(["a"], 100, 1600, 1500) == [0]


def test_dedup_asks_the_store_for_pages_not_ids():
    """Any series of micro-batches and timers gives what single ids give, for a page's calls."""
    rng, paged, single = random.Random(8), PagedAcceptTimes(300, 4000), AcceptTimes(300, 4000)
    stores = Store(), Store()
    paged.init(stores[0])
    single.init(stores[1])
    for now in range(0, 9000, 500):
        ids = [f"m{rng.randrange(20 * PAGE if now < 5000 else 30)}" for _ in range(12 * PAGE if now < 5000 else 20)]
        rows = [Row(id=i, org="o", stream="s", t=now + 40 * (n % 9), received_at=now + 40 * (n % 9), seq=n, now_ms=now)
                for n, i in enumerate(ids)]
        before = stores[0].asked()
        got, want = (list(p.handleInputRows((1,), rows, Clock(now))) for p in (paged, single))
        assert got == want
        if now:
            assert stores[0].asked() - before <= 2 * 32 + 4   # pages, read and written
        if stores[1].timers[-1] <= now:
            for p in (paged, single):
                list(p.handleExpiredTimer((1,), Clock(now), Clock(now)))
        assert stores[0].timers == stores[1].timers
        kept = [json.loads(text) for text, in stores[0].maps["pages"].data.values()]
        assert {(i,): tuple(v) for page in kept for i, v in page.items()} == stores[1].maps["times"].data
        assert len(kept) <= max(1, 8 * sum(map(len, kept)) / PAGE) and max(map(len, kept)) < 2 * PAGE
    assert len(kept) == 1   # pages are given back


# --- ingest

def test_a_body_is_kept_for_streams_only(spark):
    """What a micro-batch holds on to has no bodies that no stream takes."""
    rows = [dict(seq=n, org="o", topic=t, message_key=k, message_id="m", content_type="application/json", body=b"{}", received_at=T0)
            for n, (t, k) in enumerate([("both", "k"), ("both", ""), ("items", "k"), ("raw", "k")])]
    kept = parsed_once(small_df(spark, rows, MESSAGES), topics(spark)).select("seq", "body", "fields").collect()
    assert {r.seq: r.body for r in kept} == {0: b"{}", 1: None, 2: None, 3: b"{}"}
    assert [r.seq for r in kept if r.fields is not None] == [0, 2]


def messages(spark, src):
    """Three micro-batches with copies of one id, bodies of all kinds and a refused one."""
    rows = []
    for i in range(60):
        topic = ["both", "raw", "items", "both"][i % 4]
        body = {"user": f"u{i % 5}", "n": i} if i % 11 else [1]
        rows.append(dict(seq=i, org="o", topic=topic, message_key=f"k{i % 4}" if i % 13 else "", message_id=f"m{i % 9}",
                         content_type="application/json", body=json.dumps(body).encode(),
                         received_at=T0 + dt.timedelta(seconds=40 * i)))
    files([small_df(spark, rows[a:a + 20], MESSAGES) for a in (0, 20, 40)], src)
    return rows


def topics(spark):
    return topics_df(spark, [topic_row("o", "both", has_batch=True, retention="WEEK", streams=["s1", "s2"]),
                             topic_row("o", "raw", streams=["s1"]), topic_row("o", "items", store=store_def(["user"]))])


def run_ingest(spark, src, base, cp):
    start_ingest(read_messages(spark, src, maxFilesPerTrigger=1), topics(spark), base, cp, NOW).awaitTermination()


def taken_in(spark, base):
    lines = Counter(r.n for r in read_lake(spark, f"{base}/lake", "n long").collect())
    items = sorted((r.pk, r.attrs, r.seq) for r in read_kv(spark, f"{base}/store").collect())
    copies = Counter((r.stream, r.seq) for r in read_accepted(spark, f"{base}/streams").collect())
    refused = Counter((r.seq, r.reject_code) for r in spark.read.parquet(f"{base}/rejects").collect())
    return lines, items, copies, refused


@pytest.fixture(scope="module")
def clean_run(spark):
    from millrace.session import scratch_path
    src, base, cp = (scratch_path(spark, n) for n in ("src", "base", "cp"))
    rows = messages(spark, src)
    run_ingest(spark, src, base, cp)
    return src, rows, taken_in(spark, base)


def test_ingest_reaches_all_destinations(clean_run):
    _, rows, (lines, items, copies, refused) = clean_run
    good = [r for r in rows if r["message_key"]]
    objects = [r for r in good if r["body"].startswith(b"{")]
    assert lines == Counter(r["seq"] for r in objects if r["topic"] == "both")
    last = {json.loads(r["body"])["user"]: r["seq"] for r in objects if r["topic"] == "items"}
    assert sorted(s for _, _, s in items) == sorted(last.values())
    assert refused == Counter([(r["seq"], 400) for r in rows if not r["message_key"]]
                              + [(r["seq"], 422) for r in good if r["body"] == b"[1]" and r["topic"] != "raw"])
    want, seen = Counter(), {}
    for r in good:
        for stream in {"both": ["s1", "s2"], "raw": ["s1"]}.get(r["topic"], ()):
            key = (stream, r["message_key"], r["message_id"])
            if key not in seen or r["received_at"] - seen[key] >= dt.timedelta(minutes=5):
                seen[key] = r["received_at"]
                want[stream, r["seq"]] += 1
    assert copies == want


@pytest.mark.parametrize("killed", DESTINATIONS)
def test_a_killed_batch_repeats_to_the_same_result(spark, scratch, monkeypatch, clean_run, killed):
    """Each destination dies once behind its write, in the second micro-batch; then the
    query starts again."""
    src, _, want = clean_run
    base, cp = scratch("base"), scratch("cp")
    from millrace.streaming import ingest as module
    home, name = (module, "deliver") if killed == "streams" else (IngestSink, killed)
    write, died = getattr(home, name), []

    def once(*args):
        write(*args)
        if args[-1] == 1 and not died:
            died.append(killed)
            raise RuntimeError("killed")
    monkeypatch.setattr(home, name, once)
    with pytest.raises(Exception, match="killed"):
        run_ingest(spark, src, base, cp)
    run_ingest(spark, src, base, cp)
    assert died and taken_in(spark, base) == want
    names = [r.key for r in all_files(spark, f"{base}/lake").collect()]
    assert len(names) == len(set(names)) and all("/batch-" in n for n in names)


def test_a_body_is_parsed_once(spark, scratch, monkeypatch, clean_run):
    src, rows, _ = clean_run
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        if text is not None:
            calls.add(1)
        return text
    parse = payload.parse_object
    monkeypatch.setattr(payload, "parse_object", lambda text: parse(counted(text)))
    run_ingest(spark, src, scratch("base"), scratch("cp"))
    assert calls.value == sum(1 for r in rows if r["message_key"] and r["topic"] != "raw")


# --- the key-value table

ITEM = "org string, pk string, sk string, attrs string, received_at timestamp, seq long"


def item(pk, attrs, seq):
    return dict(org="o", pk=pk, sk="s", attrs=attrs, received_at=T0, seq=seq)


def test_a_batch_rewrites_the_buckets_it_touches(spark, scratch):
    path = scratch("kv")
    upsert_kv(small_df(spark, [item(f"p{i}", "a", i) for i in range(200)], ITEM), path, 0, buckets=16)
    before = kv._pointer(spark, path)
    upsert_kv(small_df(spark, [item("p7", "b", 300), item("p8", "old", -1)], ITEM), path, 1)
    after = kv._pointer(spark, path)
    assert len(before["at"]) == 16 and 1 <= sum(v == 2 for v in after["at"].values()) <= 2
    assert {r.pk: r.attrs for r in read_kv(spark, path).collect()} == {f"p{i}": "b" if i == 7 else "a" for i in range(200)}
    assert [r.attrs for r in read_item(spark, path, "o", "p7", "s").collect()] == ["b"]
    assert len(read_item(spark, path, "o", "p7", "s").inputFiles()) == 1
    assert read_item(spark, path, "o", "none", "s").count() == 0
    gone = clean_kv(spark, path)
    assert gone == sum(v == 2 for v in after["at"].values()) and read_kv(spark, path).count() == 200


def test_readers_see_one_version(spark, scratch, monkeypatch):
    """A merge that dies before its pointer leaves the table as it was, and its repeat
    writes the same version."""
    path = scratch("kv")
    upsert_kv(small_df(spark, [item("a", "1", 1), item("b", "1", 2)], ITEM), path, 0, buckets=4)
    reader = read_kv(spark, path)
    two = small_df(spark, [item("a", "2", 3), item("c", "2", 4)], ITEM)
    with monkeypatch.context() as m:
        m.setattr(kv, "put_text", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            upsert_kv(two, path, 1)
    rows = lambda df: sorted((r.pk, r.attrs) for r in df.collect())
    assert rows(read_kv(spark, path)) == [("a", "1"), ("b", "1")]
    upsert_kv(two, path, 1)
    assert rows(reader) == [("a", "1"), ("b", "1")]   # opened before, still whole
    assert rows(read_kv(spark, path)) == [("a", "2"), ("b", "1"), ("c", "2")]
    upsert_kv(small_df(spark, [], ITEM), path, 2)
    assert rows(read_kv(spark, path)) == [("a", "2"), ("b", "1"), ("c", "2")]


def test_an_empty_table_has_its_columns(spark, scratch):
    path = scratch("kv")
    upsert_kv(small_df(spark, [], ITEM), path, 0)
    assert read_kv(spark, path).count() == 0 and "attrs" in read_kv(spark, path).columns


# --- state

def run_state(spark, parts, scratch, **options):
    src, out, cp = scratch("ops"), scratch("out"), scratch("cp")
    files(parts, src)
    (state_stream(read_messages(spark, src, schema=STATE_OPS, maxFilesPerTrigger=1), **options)
     .writeStream.outputMode("update").option("checkpointLocation", cp)
     .foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{out}/batch={b}")).trigger(**NOW).start().awaitTermination())
    return cp, out


def live_values(spark, cp):
    out = {}
    for r in read_state(spark, cp).collect():
        for attr, (kind, text) in r.attrs.items():
            out[r.state_key, attr] = Decimal(text) if kind == "number" else json.loads(text) if kind == "set" else text
    return out


def folded(ops):
    out = {(r.state_key, r.attr): r.value for r in S.fold_register(ops).collect() if r.value is not None}
    out |= {(r.state_key, r.attr): r.value for r in S._counters(ops).where("present").collect()}
    out |= {(r.state_key, r.attr): r.value for r in S.fold_set(ops).collect() if r.value}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_micro_batches_equals_the_fold(spark, scratch, seed):
    rng = random.Random(seed)
    ops = log(spark, random_log(seed, 240)).withColumn("key_parts", F.array(F.lit("t"), (F.col("seq") % 3).cast("string")))
    rows = [r.asDict() for r in ops.collect()]
    rng.shuffle(rows)
    rows += rows[:20]   # some come twice
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [small_df(spark, rows[a:b], STATE_OPS) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    cp, _ = run_state(spark, parts, scratch)
    assert live_values(spark, cp) == folded(ops)


def test_memory_state_in_any_order():
    """The same on one entry, without a stream, in many orders."""
    for seed in range(30):
        entries = list(enumerate(random_log(seed, 60)))
        in_order, mixed = StateEntry(), StateEntry()
        for i, (a, o, v) in entries:
            in_order.apply(o, a, v)
        random.Random(seed).shuffle(entries)
        for i, (a, o, v) in entries:
            mixed.apply(o, a, v, i)
        mixed = StateEntry.load(mixed.dump())
        for attr in ("n0", "n1"):
            assert mixed.get_number(attr) == in_order.get_number(attr)
        for attr in ("s0", "s1"):
            assert mixed.get_set(attr) == in_order.get_set(attr)
        for attr in ("r0", "r1"):
            assert mixed.get_string(attr) == in_order.get_string(attr)


def test_an_operation_touches_its_element_only(spark, scratch):
    """A set of a thousand elements, then one more: the micro-batch reports one change."""
    many = [("s", "add_to_set", f"e{i}") for i in range(1000)]
    ops = log(spark, [*many, ("s", "add_to_set", "new"), ("s", "remove_from_set", "e5")])
    cp, out = run_state(spark, [ops.where("seq < 1000"), ops.where("seq >= 1000")], scratch)
    changes = [[(c.attr, c.member, c.value) for c in r.changes]
               for b in (0, 1) for r in spark.read.parquet(f"{out}/batch={b}").collect()]
    assert len(changes[0]) == 1001 and sorted(changes[1]) == [("s", "e5", "false"), ("s", "new", "true")]
    assert len(live_values(spark, cp)["billing:room 7", "s"]) == 1000


class Reads:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.data, self.asked = {}, 0

    def getValue(self, key):
        self.asked += 1
        return self.data.get(key)

    def containsKey(self, key):
        self.asked += 1
        return key in self.data

    def updateValue(self, key, value):
        self.asked += 1
        self.data[key] = value

    def removeKey(self, key):
        self.asked += 1
        del self.data[key]

    def iterator(self):
        self.asked += len(self.data)
        return iter(list(self.data.items()))


def test_cost_of_an_operation_is_independent_of_the_set():
    from millrace.streaming.state import _Map
    costs = []
    for size in (10, 10_000):
        kept = [Reads() for _ in range(3)]
        entry = StateEntry(*map(_Map, kept))
        for i in range(size):
            entry.add_to_set("s", f"e{i}", seq=i)
            entry.add_number("n", 1, seq=i)
        entry.flush()
        before = sum(k.asked for k in kept)
        entry = StateEntry(*map(_Map, kept))
        entry.add_to_set("s", "new", seq=size)
        entry.remove_from_set("s", "e3", seq=size + 1)
        entry.add_number("n", 1, seq=size + 2)
        entry.set_string("r", "x", seq=size + 3)
        entry.flush()
        costs.append(sum(k.asked for k in kept) - before)
    assert costs[0] == costs[1]


def test_a_small_entry_is_one_value():
    """Up to ``HELD`` entries of a key cost a read and a write; more move to the maps, and
    what comes later is newer than those."""
    store, run = Store(), KeyedProcessor()
    run.init(store)
    clock = Clock(0)

    def batch(*ops):
        before = store.asked()
        rows = [Row(seq=n, at_us=n, attr=a, op=o, value=v) for n, a, o, v in ops]
        list(run.handleInputRows(("k",), iter(rows), clock))
        return store.asked() - before

    assert batch(*[(n, "n", "add_number", "1") for n in range(50)], (50, "s", "add_to_set", "x")) == 2
    assert batch((51, "n", "add_number", "1"), (52, "s", "remove_from_set", "x"), (20, "n", "add_number", "1")) == 2
    batch(*[(n, "n", "add_number", "1") for n in range(100, 100 + HELD)])
    assert len(store.maps["adds"].data) == 51 + HELD
    batch((500, "n", "set_number", "7"), (501, "n", "add_number", "2"), (60, "n", "add_number", "9"))
    entry = StateEntry.of_held(run.maps, *store.values["written"].value[1:])
    assert entry.get_number("n") == 9 and entry.get_set("s") == set()
    entry.flush()
    assert set(store.maps["adds"].data) == {("n", 501)}


def test_a_part_of_many_files_is_one_micro_batch(spark, tmp_path):
    """More rows make more files, not more micro-batches; results stay those of the SQL."""
    from millrace.plans.q_stream import PARTS, _timed_stream
    days = spark.range(40, numPartitions=4).select(
        "id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 20 * 86400).alias("at"))
    seen = []
    (_timed_stream(days.where("id < 10 or id > 12"), "at", "days").writeStream
     .foreachBatch(lambda df, b: seen.append((df.agg(F.min("at"), F.max("at"), F.count("*")).first())))
     .option("checkpointLocation", str(tmp_path)).trigger(**NOW).start().awaitTermination())
    spans = [(r[0].day, r[1].day) for r in seen if r[2]]
    assert spans == [(1, 6), (7, 12), (13, 18), (19, 20)] and sum(r[2] for r in seen) == 37 and len(seen) <= PARTS


def test_expiry_in_event_time(spark, scratch):
    """After a replay the live entries are those the batch fold keeps at the watermark."""
    rng = random.Random(4)
    rows = []
    for i in range(200):
        key, at = rng.randrange(12), T0 + dt.timedelta(seconds=30 * i)
        if key % 3 == 0 and i > 80:
            continue   # these keys are quiet from then on
        rows.append(dict(key_parts=["k", str(key)], seq=i, at=at, attr="n", op="add_number", value="1"))
    rows.append(dict(key_parts=["k", "0"], seq=1000, at=rows[-1]["at"], attr="n", op="add_number", value="5"))
    parts = [small_df(spark, rows[a:a + 50], STATE_OPS) for a in range(0, len(rows), 50)]
    cp, out = run_state(spark, parts, scratch, ttl_sec=900, lateness="0 seconds")
    watermark = int(max(r["at"] for r in rows).timestamp())
    ops = small_df(spark, rows, STATE_OPS)
    want = {r.state_key: r.ttl for r in S.fold_ttl(ops, 900).where(F.col("ttl") >= watermark).collect()}
    live = {r.state_key: int(r.at.replace(tzinfo=UTC).timestamp()) + 900 for r in read_state(spark, cp).collect()}
    assert live == want and 0 < len(live) < 12
    assert live_values(spark, cp)["k:0", "n"] == 5   # a new life, not the old count
    ended = {r.state_key for r in spark.read.parquet(out).where("expired").collect()}
    assert {f"k:{k}" for k in (3, 6, 9)} <= ended
