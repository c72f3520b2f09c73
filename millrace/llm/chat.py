"""Chat formatting with tool calls linked to their results.

Calls and results are rows that carry an identifier; they are hash-joined on
(conversation, identifier). A call may name an earlier call that it follows; calls are
put in topological order by their depth in these chains, found by pointer doubling, in
a number of rounds that grows with the logarithm of the longest chain. Arguments are
checked against the tool's schema, and every message is written as canonical JSON:
keys sorted, no spaces, no nulls. Output is a row per message with its place in the
conversation; a conversation is never gathered into one group.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

PLACES = 1 << 10   # turns that are numbered together


def depths(calls: DataFrame) -> DataFrame:
    """``(conv_id, id, depth, latest)`` of each call: depth 0 without a known predecessor,
    else one more than its predecessor's, null for calls on or behind a cycle; ``latest``
    is the last turn of the call and all before it in its chain."""
    ids = calls.select("conv_id", "id").distinct()
    known = ids.select("conv_id", F.col("id").alias("after"), F.lit(True).alias("known"))
    # one predecessor each: of rows that repeat an identifier the least one named
    state = (calls.groupBy("conv_id", "id").agg(F.min("after").alias("after"), F.min("turn").alias("latest"))
             .join(known, ["conv_id", "after"], "left")
             .select("conv_id", "id", "latest", F.when(F.col("known"), F.col("after")).alias("up"))
             .withColumn("depth", F.col("up").isNotNull().cast("long")))
    state = settle(state, "chains")
    size, rounds = state.where("up is not null").count(), 0
    while size and rounds <= size.bit_length():
        parent = state.select("conv_id", F.col("id").alias("up"), F.col("up").alias("next"),
                              F.col("depth").alias("more"), F.col("latest").alias("earlier"))
        state = settle(state.join(parent, ["conv_id", "up"], "left").select(
            "conv_id", "id", F.greatest("latest", "earlier").alias("latest"), F.col("next").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chains")
        rounds += 1
        if state.where("up is not null").limit(1).count() == 0:
            break
    return state.select("conv_id", "id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), "latest")


# How values of a type look in JSON.
LOOKS = {"string": r'^".*"$', "integer": r"^-?[0-9]+$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
         "boolean": r"^(true|false)$"}

Kind = str | dict | list


def _names(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("array<string>")


def _value_faults(value: Column, kind: Kind, path: str) -> Column:
    """The faults of a value that is there; ``path`` names it, an array's elements as ``[]``."""
    wrong = _names(f"type:{path}")
    shown = F.coalesce(F.to_json(value), F.lit("null"))
    if isinstance(kind, dict):
        return F.when(shown.startswith("{"), _field_faults(value.try_cast("map<string, variant>"), kind, f"{path}.")).otherwise(wrong)
    if isinstance(kind, list):
        each = F.transform(value.try_cast("array<variant>"), lambda v: _value_faults(v, kind[0], f"{path}[]"))
        return F.when(shown.startswith("["), F.array_distinct(F.flatten(each))).otherwise(wrong)
    return F.when(shown.rlike("(?s)" + LOOKS[kind]), _names()).otherwise(wrong)


def _field_faults(given: Column, fields: dict[str, tuple[Kind, bool]], path: str = "") -> Column:
    """The faults of an object's fields, and of fields that the schema does not know."""
    found = [F.transform(F.array_except(F.map_keys(given), _names(*fields)), lambda k: F.concat(F.lit(f"extra:{path}"), k))]
    for field, (kind, needed) in fields.items():
        absent = _names(f"missing:{path}{field}") if needed else _names()
        found.append(F.when(F.to_json(given[field]).isNull(), absent).otherwise(
            _value_faults(given[field], kind, f"{path}{field}")))
    return F.concat(*found)


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[Kind, bool]]]) -> Column:
    """The faults of a call, sorted: ``tool`` for an unknown tool, ``json`` for arguments
    that are not a JSON object, ``missing:x``, ``type:x`` and ``extra:x`` for its fields;
    a field ``y`` of an object ``x`` is ``x.y``, an element of an array ``x`` is ``x[]``.

    A schema names each field's type and whether it must be there. A type is string,
    integer, number or boolean, a dict of an object's fields, or a list of the one type
    that an array's elements have."""
    given = F.try_parse_json(arguments).try_cast("map<string, variant>")
    found = F.when(F.lit(True), _names("tool"))
    for tool, fields in schemas.items():
        faults = F.array_sort(_field_faults(given, fields))
        found = F.when(name == tool, F.when(given.isNull(), _names("json")).otherwise(faults)).otherwise(found)
    return F.when(name.isNull(), _names("tool")).otherwise(found)


def _finite(text: str) -> float:
    """A number of a JSON text; JSON has no infinite ones and no NaN."""
    number = float(text)
    if not math.isfinite(number):
        raise ValueError(f"{text} is no JSON number")
    return number


def _text(value: object) -> str:
    """JSON with sorted keys, without spaces. Half surrogate pairs, which no text may
    hold, stay escaped."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", out)


def canonical(value: str | None) -> str | None:
    """A JSON text with sorted keys, without spaces; a text that is not JSON, one with an
    infinite number or NaN too, as a JSON string."""
    if value is None:
        return None
    try:
        return _text(json.loads(value, parse_float=_finite, parse_constant=_finite))
    except (ValueError, RecursionError):
        return _text(value)


def _object(**fields: Column) -> Column:
    """Canonical JSON of an object: keys in order, null fields left out. Values are
    JSON texts already."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def quoted(text: Column) -> Column:
    """A text as a JSON string: quotes, back-slashes and control characters escaped."""
    out = F.to_json(F.struct(text.alias("t")))
    return F.when(text.isNotNull(), F.substring(out, F.lit(6), F.length(out) - 6))


def _serialise(batches):
    import pyarrow as pa
    for batch in batches:
        at = batch.schema.names.index("arguments")
        columns = list(batch.columns)
        columns[at] = pa.array([canonical(v) for v in columns[at].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def format_chat(messages: DataFrame, schemas: dict[str, dict[str, tuple[Kind, bool]]]) -> DataFrame:
    """Messages ``(conv_id, turn, role, text, id, name, arguments, after)`` in order.

    A row with a name is a call, one with the role ``tool`` a result, any other a plain
    message. Returns ``conv_id, turn, kind, place, status, problems, json``: ``place``
    counts a conversation's messages from 0, calls by depth, a result right behind its
    call, all else by turn. ``status`` of a call is ``answered``, ``open`` (no result) or
    ``cycle``; of a result ``linked``, ``again`` (not the first by turn) or ``orphan``;
    of a plain message ``plain``. A null identifier links with nothing. Rows that repeat
    all stay; ties are broken by role and text. Null texts give an empty content. Arguments
    that are not JSON are written as a JSON string.
    """
    rows = settle(messages.select("conv_id", "turn", "role", "text", "id", "name", "arguments", "after")
                  .withColumn("kind", F.when(F.col("name").isNotNull(), "call")
                              .when(F.col("role") == "tool", "result").otherwise("plain")), "messages")
    calls = rows.where("kind = 'call' and id is not null")
    depth = depths(calls)
    first_call = calls.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"))
    linked = rows.join(depth, ["conv_id", "id"], "left").join(first_call, ["conv_id", "id"], "left")
    results = rows.where("kind = 'result' and id is not null").groupBy("conv_id", "id").agg(
        F.min("turn").alias("result_turn"))
    linked = linked.join(results, ["conv_id", "id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = (F.when(is_call & F.col("id").isNotNull() & F.col("depth").isNull(), "cycle")
              .when(is_call, F.when(F.col("result_turn").isNull(), "open").otherwise("answered"))
              .when(is_result, F.when(F.col("call_turn").isNull(), "orphan")
                    .when(F.col("turn") > F.col("result_turn"), "again").otherwise("linked"))
              .otherwise("plain"))
    # a call stands at its own turn or, behind those it follows, at theirs if that is
    # later; a result stands behind its call
    moved = F.col("depth").isNotNull() & (is_call | (status == "linked") | (status == "again"))
    judged = linked.withColumns({
        "status": status, "anchor": F.when(moved, F.col("latest")).otherwise(F.col("turn")),
        "level": F.when(moved, F.col("depth")).otherwise(F.lit(0)),
        "problems": F.when(is_call, problems(F.col("name"), F.col("arguments"), schemas))})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in judged.schema.fields)
    tidy = judged.mapInArrow(_serialise, fields)
    call = _object(arguments=F.col("arguments"), id=quoted(F.col("id")), name=quoted(F.col("name")))
    whole = _object(
        content=quoted(F.coalesce("text", F.lit(""))), role=quoted(F.coalesce("role", F.lit(""))),
        tool_call=F.when(is_call, call), tool_call_id=F.when(is_result, quoted(F.col("id"))))
    ordered = tidy.withColumn("json", whole).withColumns({
        "is_result": F.col("kind") == "result", "is_cycle": F.col("status") == "cycle"})
    return _numbered(ordered).select("conv_id", "turn", "kind", "place", "status", "problems", "json")


def _numbered(rows: DataFrame) -> DataFrame:
    """``place`` within a conversation: cycles last, else by anchor and level. Stretches of
    ``PLACES`` turns are numbered apart, each behind the counts before it."""
    rows = rows.withColumn("part", F.floor(F.coalesce("anchor", F.lit(-1)) / PLACES))
    keys = ["conv_id", "is_cycle", "part"]
    before = Window.partitionBy("conv_id").orderBy("is_cycle", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(
        *[F.col(k).alias(f"of_{k}") for k in keys], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(
        "anchor", "level", "id", "is_result", "turn", "role", "json"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return rows.withColumn("number", number).join(counts, same).withColumn(
        "place", F.col("earlier") + F.col("number") - 1)
