"""Keyed state in a stream, kept element by element in Spark's state store.

Every attribute has a *head*: the number (``seq``) of its last replacement or delete,
with the value set then. Later additions to a counter are kept by number, the last
operation on each element of a set by element. So an operation that arrives late, in
the same micro-batch or a later one, meets what it would have met in order:

- a replacement or delete only counts if its number is higher than the head's;
- an addition only counts if its number is higher than the head's, and once;
- a set holds the elements whose last operation put them in and is no older than the head.

An operation reads and writes its attribute's head and its own element, whatever the
size of a set. What one micro-batch changes is written once per key, at its end: up to
``HELD`` entries of a key stay together in one value of the store, as every call to the
store costs a round trip. When a key has more, they move to the store's maps, entry by
entry, and the value goes on with what is changed later; it is newer than the maps.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import keyed

# times are epoch microseconds inside the store
WRITTEN = "at_us long, clock long, spilled boolean, held string"
HEADS = ("attr string", "kind string, seq long, value string, total string, last long")
ADDS = ("attr string, seq long", "amount string")
MEMBERS = ("attr string, member string", "seq long, present boolean")
CHANGED = ("state_key string, changes array<struct<attr:string,kind:string,member:string,value:string>>, "
           "at_us long, expired boolean")

HELD = 128   # entries of a key that are kept in one value
HELD_HEAD = ("attr", "kind", "seq", "value", "total", "last")
HELD_MEMBER = ("attr", "member", "seq", "present")
HELD_JSON = ("heads array<struct<attr:string,kind:string,seq:long,value:string,total:string,last:long>>, "
             "members array<struct<attr:string,member:string,seq:long,present:boolean>>")

NEVER = -(1 << 63)   # the number of no operation
NO_HEAD = (None, NEVER, None, "0", NEVER)


class _Map:
    """A map of the state store, or of memory: reads are remembered, writes are kept
    until :meth:`flush`. ``held`` are entries newer than the store's (null: removed);
    the store is not asked when nothing was ``spilled`` to it."""

    def __init__(self, state=None, held: dict | None = None, spilled: bool = True):
        self.state, self.seen, self.changed = state, dict(held or ()), set()
        self.held, self.spilled = set(self.seen), spilled and state is not None

    def get(self, key: tuple):
        if key not in self.seen:
            self.seen[key] = self.state.getValue(key) if self.spilled else None
        return self.seen[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def of(self, attr: str) -> list[tuple]:
        """Entries of one attribute; reads the key's whole map."""
        if self.spilled:
            for key, value in self.state.iterator():
                self.seen.setdefault(tuple(key), tuple(value))
        return [(k, v) for k, v in self.seen.items() if k[0] == attr and v is not None]

    def clear(self) -> None:
        if self.spilled:
            self.state.clear()
        self.seen = dict.fromkeys(self.seen)
        self.changed, self.held, self.spilled = set(), set(), False

    def pending(self) -> dict:
        """What the store's map does not have yet; removals only where it may have the entry."""
        return {k: self.seen[k] for k in self.held | self.changed if self.spilled or self.seen[k] is not None}

    def flush(self) -> None:
        for key, value in self.pending().items():
            if value is not None:
                self.state.updateValue(key, value)
            elif self.state.containsKey(key):
                self.state.removeKey(key)


class StateEntry:
    """Attributes of one key as a handler sees them. Numbers are exact; absent
    attributes read as ``""``, ``False``, ``0``, the empty set or ``None``.

    Without a ``seq`` operations are numbered as they come (``clock``), which is how a
    handler's calls are taken; then additions need not be kept one by one."""

    def __init__(self, heads: _Map | None = None, adds: _Map | None = None, members: _Map | None = None, clock: int = 0):
        self._heads, self._adds, self._members = heads or _Map(), adds or _Map(), members or _Map()
        self.clock, self.touched = clock, False

    # --- what is kept

    def _head(self, attr: str) -> tuple:
        return self._heads.get((attr,)) or NO_HEAD

    def _next(self, seq: int | None) -> int:
        self.touched = True
        if seq is not None:
            return seq
        self.clock += 1
        return self.clock

    def _replace(self, attr: str, kind: str | None, value: str | None, seq: int | None) -> bool:
        number = self._next(seq)
        old, since, _, total, last = self._head(attr)
        if number < since:
            return False
        if last > NEVER:   # additions since the replacement before this one
            kept = Decimal(0)
            for key, (amount,) in self._adds.of(attr):
                if key[1] <= number:
                    self._adds.put(key, None)
                else:
                    kept += Decimal(amount)
            last, total = (last, str(kept)) if last > number else (NEVER, "0")
        self._heads.put((attr,), (kind or old, number, value, total, last))
        return True

    def _member(self, attr: str, member: str, present: bool, number: int) -> None:
        old = self._members.get((attr, member))
        if old is None or old[0] <= number:
            self._members.put((attr, member), (number, present))

    # --- operations

    def set_string(self, attr: str, value: str, seq: int | None = None) -> None:
        self._replace(attr, "string", value, seq)

    def set_bool(self, attr: str, value: bool, seq: int | None = None) -> None:
        self._replace(attr, "bool", "true" if value else "false", seq)

    def set_json(self, attr: str, value, seq: int | None = None) -> None:
        self._replace(attr, "json", value if isinstance(value, str) else json.dumps(value), seq)

    def set_number(self, attr: str, value, seq: int | None = None) -> None:
        self._replace(attr, "number", str(Decimal(value)), seq)

    def add_number(self, attr: str, value, seq: int | None = None) -> None:
        number = self._next(seq)
        kind, since, base, total, last = self._head(attr)
        if number <= since:
            return
        if seq is not None:
            if self._adds.get((attr, seq)) is not None:
                return
            self._adds.put((attr, seq), (str(Decimal(value)),))
        self._heads.put((attr,), ("number", since, base, str(Decimal(total) + Decimal(value)), max(last, number)))

    def set_set(self, attr: str, values, seq: int | None = None) -> None:
        if self._replace(attr, "set", None, seq):
            for member in set(values):
                self._member(attr, member, True, self._head(attr)[1])

    def add_to_set(self, attr: str, *values: str, seq: int | None = None) -> None:
        self._change_set(attr, values, True, seq)

    def remove_from_set(self, attr: str, *values: str, seq: int | None = None) -> None:
        self._change_set(attr, values, False, seq)

    def _change_set(self, attr: str, values, present: bool, seq: int | None) -> None:
        number = self._next(seq)
        kind, since, value, total, last = self._head(attr)
        if number < since:
            return
        if kind != "set":
            self._heads.put((attr,), ("set", since, value, total, last))
        for member in values:
            self._member(attr, member, present, number)

    def delete(self, attr: str, seq: int | None = None) -> None:
        self._replace(attr, None, None, seq)

    def touch(self, seq: int | None = None) -> None:
        self._next(seq)

    def apply(self, op: str, attr: str, value: str | None, seq: int | None = None) -> None:
        """One operation of the log in ``schemas.STATE_OPS``."""
        if op == "set_set":
            self.set_set(attr, json.loads(value), seq)
        elif op == "set_bool":
            self.set_bool(attr, value == "true", seq)
        elif op in ("set_string", "set_number", "add_number", "set_json"):
            getattr(self, op)(attr, value, seq)
        elif op in ("add_to_set", "remove_from_set"):
            getattr(self, op)(attr, value, seq=seq)
        elif op == "delete":
            self.delete(attr, seq)
        elif op == "touch":
            self.touch(seq)
        else:
            raise ValueError(f"unknown state operation {op}")

    # --- values

    def get_string(self, attr: str) -> str:
        return self._head(attr)[2] or ""

    def get_bool(self, attr: str) -> bool:
        return self._head(attr)[2] == "true"

    def get_number(self, attr: str) -> Decimal:
        head = self._head(attr)
        return Decimal(head[2] or "0") + Decimal(head[3])

    def get_set(self, attr: str) -> set[str]:
        since = self._head(attr)[1]
        return {key[1] for key, (number, present) in self._members.of(attr) if present and number >= since}

    def get_json(self, attr: str):
        text = self._head(attr)[2]
        return json.loads(text) if text else None

    def _changes(self) -> list[tuple]:
        """Changed attributes and elements: ``attr, kind, member, value``. The value is
        null where the attribute is absent now; an element's says whether it is in."""
        out = []
        for (attr,) in sorted(self._heads.changed):
            kind, _, value, total, last = self._head(attr)
            if kind == "number" and (value is not None or last > NEVER):
                value = str(Decimal(value or "0") + Decimal(total))
            out.append((attr, kind, None, value))
        for attr, member in sorted(self._members.changed):
            number, present = self._members.get((attr, member))
            inside = present and number >= self._head(attr)[1]
            out.append((attr, "set", member, "true" if inside else "false"))
        return out

    def clear(self) -> None:
        for kept in (self._heads, self._adds, self._members):
            kept.clear()

    def flush(self) -> None:
        for kept in (self._heads, self._adds, self._members):
            kept.flush()

    def held(self) -> str | None:
        """All that is pending as one text, for :meth:`of_held`; null when it is too much."""
        heads, adds, members = (kept.pending() for kept in (self._heads, self._adds, self._members))
        if len(heads) + len(adds) + len(members) > HELD:
            return None
        return json.dumps({
            "heads": [dict(zip(HELD_HEAD, k + v)) for k, v in heads.items()],
            "adds": [[*k, v and v[0]] for k, v in adds.items()],
            "members": [dict(zip(HELD_MEMBER, k + v)) for k, v in members.items()]})

    @classmethod
    def of_held(cls, maps, clock: int, spilled: bool, text: str | None) -> "StateEntry":
        """An entry over the maps of a state store and the text of its pending changes."""
        held = json.loads(text) if text else {"heads": (), "adds": (), "members": ()}
        parts = (
            {(d["attr"],): tuple(d[n] for n in HELD_HEAD[1:]) for d in held["heads"]},
            {(attr, seq): None if amount is None else (amount,) for attr, seq, amount in held["adds"]},
            {(d["attr"], d["member"]): (d["seq"], d["present"]) for d in held["members"]})
        return cls(*(_Map(m, part, spilled) for m, part in zip(maps, parts)), clock=clock)

    @property
    def spilled(self) -> bool:
        return any(kept.spilled for kept in (self._heads, self._adds, self._members))

    # --- as text

    def dump(self) -> str:
        return json.dumps([self.clock, *([[list(k), v] for k, v in kept.seen.items() if v is not None]
                                         for kept in (self._heads, self._adds, self._members))])

    @classmethod
    def load(cls, text: str | None) -> "StateEntry":
        entry = cls()
        if text:
            entry.clock, *parts = json.loads(text)
            for kept, part in zip((entry._heads, entry._adds, entry._members), parts):
                kept.seen = {tuple(k): tuple(v) for k, v in part}
        return entry


class KeyedProcessor(StatefulProcessor):
    """Runs ``handle(entry, row)`` for each row of a key in ``seq`` order and yields what
    it returns. Without a handler rows are operations of the log, numbered by ``seq``.

    With ``ttl_sec`` an entry lives that long, in event time, after the latest of its
    rows: a row from after its end meets an empty entry, and a timer drops the entry when
    the watermark passes its end."""

    def __init__(self, handle: Callable[[StateEntry, Row], list[Row]] | None = None,
                 ttl_sec: int | None = None):
        self.handle, self.ttl_us = handle, ttl_sec and ttl_sec * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle
        self.written = handle.getValueState("written", WRITTEN)
        self.maps = [handle.getMapState(name, *schema)
                     for name, schema in (("heads", HEADS), ("adds", ADDS), ("members", MEMBERS))]

    def _timer(self, at_us: int) -> int:
        """The first whole millisecond after the entry's end."""
        return (at_us + self.ttl_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.written.get()
        at, clock, spilled, held = old or (None, 0, False, None)
        before, ended = at, False
        state = StateEntry.of_held(self.maps, clock, spilled, held)
        # a key's rows of one micro-batch, which the trigger bounds
        for row in sorted(rows, key=lambda r: r.seq):
            if self.ttl_us and at is not None and row.at_us > at + self.ttl_us:
                state.clear()
                ended = True
            at = row.at_us if at is None else max(at, row.at_us)
            if self.handle is None:
                state.apply(row.op, row.attr, row.value, row.seq)
            else:
                yield from self.handle(state, row) or ()
        if state.touched:
            changes, text = state._changes(), state.held()
            if text is None:
                state.flush()
            self.written.update((at, state.clock, text is None or state.spilled, text))
            if self.ttl_us and at != before:
                if before is not None:
                    self.store.deleteTimer(self._timer(before))
                self.store.registerTimer(self._timer(at))
            if self.handle is None:
                yield Row(state_key=key[0], changes=changes, at_us=at, expired=False)
        elif ended:
            self.written.update((before, clock, False, None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.written.get()
        if old and self._timer(old[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            for kept in (*self.maps, self.written):
                kept.clear()
            if self.handle is None:
                yield Row(state_key=key[0], changes=[], at_us=old[0], expired=True)

    def close(self) -> None:
        pass


def state_stream(ops: DataFrame, ttl_sec: int | None = None, lateness: str = "0 seconds") -> DataFrame:
    """A stream of operations as a stream of changes: per key and micro-batch the
    attributes and elements that changed (``changes``), the time of the latest operation
    so far (``at``), and ``expired`` where the entry's life has ended.

    Operations may come in any order. With a life (``ttl_sec``) those that come later
    than ``lateness`` after newer ones are left out."""
    if ttl_sec:
        ops = ops.withWatermark("at", lateness)
    rows = keyed(ops).select("state_key", "seq", "at", F.unix_micros("at").alias("at_us"), "attr", "op", "value")
    changed = rows.groupBy("state_key").transformWithState(
        KeyedProcessor(None, ttl_sec), CHANGED, "Update", "EventTime" if ttl_sec else "None")
    return changed.select("state_key", "changes", F.timestamp_micros("at_us").alias("at"), "expired")


def read_state(spark: SparkSession, checkpoint: str, operator_id: int = 0) -> DataFrame:
    """The live state of a stream: merged key, attributes as ``name -> [kind,
    JSON text]`` and time of the last write."""
    def part(name: str) -> DataFrame:
        raw = (spark.read.format("statestore").option("operatorId", operator_id)
               .option("stateVarName", name).load(checkpoint))
        key = F.col("key").getField(raw.schema["key"].dataType.names[0]).alias("state_key")
        if name == "written":
            return raw.select(key, "value.*")
        return raw.select(key, "user_map_key.*", "user_map_value.*")

    def newest(name: str, keys: list[str]) -> DataFrame:
        """Entries of the value where it has them, else of the map."""
        kept = part(name)
        held = (written.select("state_key", F.inline(F.from_json("held", HELD_JSON)[name]))
                .select(kept.columns).withColumn("newer", F.lit(1)))
        rest = [c for c in kept.columns if c not in keys]
        return (kept.withColumn("newer", F.lit(0)).unionByName(held)
                .groupBy(*keys).agg(F.max_by(F.struct(*rest), "newer").alias("entry")).select(*keys, "entry.*"))

    written = part("written")
    heads = newest("heads", ["state_key", "attr"])
    inside = newest("members", ["state_key", "attr", "member"]).where("present").select("state_key", "attr", "member", F.col("seq").alias("number"))
    sets = (heads.where("kind = 'set'").select("state_key", "attr", "seq")
            .join(inside, ["state_key", "attr"]).where("number >= seq")
            .groupBy("state_key", "attr").agg(F.to_json(F.sort_array(F.collect_list("member"))).alias("text")))
    number = F.coalesce(F.col("value"), F.lit("0")).cast("decimal(38,10)") + F.col("total").cast("decimal(38,10)")
    plain = heads.where("kind <> 'set'").select(
        "state_key", "attr", "kind", F.when(F.col("kind") != "number", F.col("value"))
        .when(F.col("value").isNotNull() | (F.col("last") > NEVER), number.cast("string")).alias("text"))
    live = plain.where("text is not null").unionByName(sets.withColumn("kind", F.lit("set")))
    attrs = live.groupBy("state_key").agg(F.map_from_entries(F.collect_list(
        F.struct("attr", F.array("kind", "text")))).alias("attrs"))
    none = F.create_map().cast("map<string,array<string>>")
    return written.join(attrs, "state_key", "left").select(
        "state_key", F.coalesce("attrs", none).alias("attrs"), F.timestamp_micros("at_us").alias("at"))
