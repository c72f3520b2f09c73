import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import state as S
from millrace.schemas import STATE_OPS, small_df
from millrace.sources.messages import read_messages
from millrace.streaming.state import StateEntry, read_state, state_stream

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KEY = ["billing", "room 7"]
# a meter, a guest list, a lamp and a note of one hotel room
LITERAL = [
    ("guest", "set_string", "Ada"), ("lamp", "set_bool", "true"), ("meter", "add_number", "2.5"),
    ("guest", "set_string", "Bo"), ("visitors", "add_to_set", "cat"), ("meter", "set_number", "40"),
    ("visitors", "add_to_set", "dog"), ("keys", "set_set", '["k2","k1"]'), ("meter", "add_number", "0.25"),
    ("visitors", "remove_from_set", "cat"), ("heater", "set_bool", "true"), ("heater", "set_bool", "false"),
    ("keys", "remove_from_set", "k2"), ("keys", "add_to_set", "k9"), ("note", "set_json", '{"wake":[6,30],"tea":true}'),
    ("minibar", "add_number", "3"), ("minibar", "delete", None), ("gone", "set_string", "x"), ("gone", "delete", None),
]


def log(spark, entries, key=KEY):
    rows = [dict(key_parts=key, seq=i, at=T0 + dt.timedelta(seconds=i), attr=a, op=o, value=v)
            for i, (a, o, v) in enumerate(entries)]
    return small_df(spark, rows, STATE_OPS)


def values(df):
    return {r.attr: r.value for r in df.collect()}


def test_literal_folds(spark):
    ops = log(spark, LITERAL)
    assert values(S.fold_counter(ops)) == {"meter": Decimal("40.25"), "minibar": 0}
    assert values(S.fold_set(ops)) == {"keys": ["k1", "k9"], "visitors": ["dog"]}
    texts = values(S.fold_register(ops))
    assert (texts["guest"], texts["lamp"], texts["heater"], texts["gone"]) == ("Bo", "true", "false", None)
    got = S.fold_json(ops.where("attr = 'note'"), "wake array<int>, tea boolean").first().value
    assert got.wake == [6, 30] and got.tea is True


def test_whole_state_has_types_and_no_deleted_entries(spark):
    attrs = {k: json.loads(v) for k, v in S.fold_state(log(spark, LITERAL)).first().attrs.items()}
    assert attrs == {"guest": "Bo", "lamp": True, "heater": False, "meter": 40.25, "visitors": ["dog"],
                     "keys": ["k1", "k9"], "note": {"wake": [6, 30], "tea": True}}


def test_state_entry_defaults_and_literals():
    e = StateEntry()
    assert (e.get_string("x"), e.get_bool("x"), e.get_number("x"), e.get_set("x"), e.get_json("x")) == ("", False, 0, set(), None)
    for attr, op, value in LITERAL:
        e.apply(op, attr, value)
    again = StateEntry.load(e.dump())
    assert again.get_set("keys") == {"k1", "k9"} and again.get_number("meter") == Decimal("40.25")
    assert again.get_json("note")["wake"] == [6, 30] and again.get_bool("heater") is False


def random_log(seed, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.choice(["n", "s", "r"])
        attr = f"{kind}{rng.randrange(2)}"
        v = str(rng.randrange(6))
        op, value = {
            "n": lambda: rng.choice([("add_number", v)] * 8 + [("set_number", v), ("delete", None)]),
            "s": lambda: rng.choice([("add_to_set", v), ("remove_from_set", v)] * 5 + [("set_set", json.dumps([v, "z"])), ("delete", None)]),
            "r": lambda: rng.choice([("set_string", v)] * 4 + [("delete", None)]),
        }[kind]()
        out.append((attr, op, value))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folds_match_replay(spark, seed):
    entries = random_log(seed)
    entry = StateEntry()
    for a, o, v in entries:
        entry.apply(o, a, v)
    ops = log(spark, entries).repartition(7)
    for attr, number in values(S.fold_counter(ops)).items():
        assert number == entry.get_number(attr)
    for attr, members in values(S.fold_set(ops)).items():
        assert set(members) == entry.get_set(attr)
    for attr, text in values(S.fold_register(ops)).items():
        assert (text or "") == entry.get_string(attr)


def test_ttl_touch_and_lists(spark):
    ops = log(spark, [("a", "set_string", "1"), ("", "touch", None)], ["task", "a"]).unionByName(
        log(spark, [("a", "set_string", "1")], ["task", "ab"])).unionByName(log(spark, [("a", "set_string", "1")], ["task", "a", "k"]))
    t0 = int(T0.timestamp())
    state = S.fold_state(ops, 100)
    assert {r.state_key: r.ttl for r in state.collect()} == {"task:a": t0 + 101, "task:ab": t0 + 100, "task:a:k": t0 + 100}
    keys = lambda df: [r.state_key for r in df.collect()]
    assert keys(S.state_list(state, ["task", "a"])) == ["task:a", "task:a:k", "task:ab"]
    assert keys(S.state_list(state, ["task", "a"], exact_part=True)) == ["task:a", "task:a:k"]
    assert keys(S.state_list(state, limit=2, after="task:a")) == ["task:a:k", "task:ab"]
    assert keys(S.state_get(state, ["task", "ab"])) == ["task:ab"]
    new = state.where("state_key = 'task:a'").withColumn("ttl", F.lit(None).cast("long"))
    assert S.state_put(state, new).where("ttl is null").count() == 1
    assert keys(S.state_drop(state, spark.createDataFrame([("task:a",), ("none",)], "state_key string")).orderBy("state_key")) == ["task:a:k", "task:ab"]


def test_stream_equals_fold_and_restarts(spark, scratch):
    src, out, cp = scratch("ops"), scratch("out"), scratch("cp")
    entries = random_log(9, 300)
    ops = log(spark, entries).withColumn("key_parts", F.array(F.lit("t"), (F.col("seq") % 3).cast("string")))

    def run():
        (state_stream(read_messages(spark, src, schema=STATE_OPS, maxFilesPerTrigger=1))
         .writeStream.outputMode("update").option("checkpointLocation", cp)
         .foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{out}/batch={b}"))
         .trigger(availableNow=True).start().awaitTermination())

    ops.where("seq < 100").coalesce(1).write.mode("append").parquet(src)
    run()   # a first run, then a restart from the checkpoint with two more files
    ops.where("seq between 100 and 199").coalesce(1).write.mode("append").parquet(src)
    ops.where("seq >= 200").coalesce(1).write.mode("append").parquet(src)
    run()
    live = {r.state_key: r.attrs for r in read_state(spark, cp).collect()}
    for r in S.fold_counter(ops).collect():
        assert Decimal(live[r.state_key].get(r.attr, [None, "0"])[1]) == r.value
    for r in S.fold_set(ops).collect():
        assert json.loads(live[r.state_key].get(r.attr, [None, "[]"])[1]) == r.value
