"""Keyed state as folds over an operation log (``schemas.STATE_OPS``).

Operations: ``set_string``, ``set_bool``, ``set_json``, ``set_number``,
``add_number``, ``set_set`` (a JSON array), ``add_to_set``, ``remove_from_set``,
``delete`` and ``touch``. An attribute keeps one kind. Every fold is an
aggregate with a map-side combine; where the last replacement of an attribute
must meet the later operations, a hot attribute is salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import merge_key
from .skew import hot_keys, salted_join

KEY = ["state_key", "attr"]
NUMBER = "decimal(38,10)"
REGISTER_OPS = ["set_string", "set_bool", "set_json"]


def keyed(ops: DataFrame) -> DataFrame:
    return ops.withColumn("state_key", merge_key(F.col("key_parts")))


def fold_register(ops: DataFrame) -> DataFrame:
    """Last write per attribute; deleted attributes read as null."""
    return _registers(ops).select(*KEY, F.when(F.col("op") != "delete", F.col("value")).alias("value"))


def _registers(ops: DataFrame) -> DataFrame:
    return (
        keyed(ops).where(F.col("op").isin(*REGISTER_OPS, "delete"))
        .groupBy(*KEY).agg(F.max_by(F.struct("op", "value"), "seq").alias("last"),
                           F.bool_or(F.col("op") != "delete").alias("known"))
        .where("known").select(*KEY, "last.op", "last.value")
    )


def read_string(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def read_bool(value: Column) -> Column:
    return F.coalesce(value == "true", F.lit(False))


def fold_counter(ops: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Value of the last ``set_number`` (0 after a delete) plus the later adds.
    ``hot`` may bring a list of hot attributes, see ``skew.hot_keys``."""
    return _counters(ops, hot).drop("present")


def _counters(ops: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Counters with ``present``: false where nothing follows the last delete."""
    log = keyed(ops).where(F.col("op").isin("set_number", "add_number", "delete")).select(
        *KEY, "seq", "op", F.col("value").cast(NUMBER).alias("x"))
    resets = (log.where("op <> 'add_number'").groupBy(*KEY)
              .agg(F.max_by(F.struct("op", "x", "seq"), "seq").alias("last"),
                   F.bool_or(F.col("op") == "set_number").alias("known")))
    base = resets.where("known").select(
        *KEY, F.when(F.col("last.op") == "set_number", F.col("last.x"))
        .otherwise(F.lit(0).cast(NUMBER)).alias("x"), (F.col("last.op") == "set_number").alias("present"))
    adds = salted_join(log.where("op = 'add_number'").select(*KEY, "seq", "x"),
                       resets.select(*KEY, F.col("last.seq").alias("since")), KEY, hot=hot)
    counts = F.col("since").isNull() | (F.col("seq") > F.col("since"))
    later = adds.select(*KEY, F.when(counts, F.col("x")).otherwise(F.lit(0).cast(NUMBER)).alias("x"),
                        counts.alias("present"))
    return (later.unionByName(base).groupBy(*KEY)
            .agg(F.sum("x").cast(NUMBER).alias("value"), F.bool_or("present").alias("present")))


def fold_set(ops: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Members after replacements, unions, subtractions and deletes; sorted."""
    log = keyed(ops).where(
        F.col("op").isin("set_set", "add_to_set", "remove_from_set", "delete")
    ).select(*KEY, "seq", "op", "value")
    resets = log.where(F.col("op").isin("set_set", "delete")).groupBy(*KEY).agg(
        F.max("seq").alias("since"), F.bool_or(F.col("op") == "set_set").alias("known"))
    members = F.when(F.col("op") == "set_set", F.from_json("value", "array<string>")).otherwise(
        F.array("value"))
    last = (
        log.where("op <> 'delete'").withColumn("member", F.explode(members))
        .groupBy(*KEY, "member")
        .agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"))
    )
    kept = salted_join(last, resets.select(*KEY, "since"), KEY, hot=hot).select(
        *KEY, F.when((F.col("op") != "remove_from_set")
                     & (F.col("since").isNull() | (F.col("seq") >= F.col("since"))),
                     F.col("member")).alias("member"))
    # an attribute whose only operations are replacements by nothing is still a set
    emptied = resets.where("known").select(*KEY, F.lit(None).cast("string").alias("member"))
    # the array is the attribute's value itself
    return (kept.unionByName(emptied).groupBy(*KEY)
            .agg(F.sort_array(F.collect_list("member")).alias("value")))


def fold_json(ops: DataFrame, schema: str) -> DataFrame:
    """Last JSON value read with a schema; an empty text reads as none."""
    return fold_register(ops).select(
        *KEY, F.when(F.col("value") != "", F.from_json("value", schema)).alias("value"))


def fold_delete(ops: DataFrame) -> DataFrame:
    """Attributes whose latest operation removed them."""
    return (keyed(ops).where("op <> 'touch'").groupBy(*KEY)
            .agg(F.max_by("op", "seq").alias("op"), F.max("at").alias("at"))
            .where("op = 'delete'").select(*KEY, F.col("at").alias("last_write")))


def fold_ttl(ops: DataFrame, ttl_sec: int) -> DataFrame:
    """Expiry per key, in epoch seconds: every write, ``touch`` too, refreshes it."""
    return (keyed(ops).groupBy("state_key")
            .agg((F.unix_seconds(F.max("at")) + F.lit(ttl_sec)).alias("ttl")))


def fold_state(ops: DataFrame, ttl_sec: int | None = None) -> DataFrame:
    """All state as one row per key: ``state_key, key_parts, attrs, ttl``. Values
    are JSON text of their own type; attributes that are absent have no entry."""
    register = _registers(ops).where("op <> 'delete' and value is not null").select(*KEY, F.to_json(
        F.when(F.col("op") == "set_bool", (F.col("value") == "true").cast("variant"))
        .when(F.col("op") == "set_json", F.coalesce(F.try_parse_json("value"), F.col("value").cast("variant")))
        .otherwise(F.col("value").cast("variant"))).alias("value"))
    hot = hot_keys(keyed(ops), KEY)
    counter = _counters(ops, hot).where("present").select(
        *KEY, F.to_json(F.col("value").cast("variant")).alias("value"))
    sets = fold_set(ops, hot).where("size(value) > 0").select(*KEY, F.to_json("value").alias("value"))
    attrs = (register.unionByName(counter).unionByName(sets).groupBy("state_key")
             .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "value")))).alias("attrs")))
    expiry = keyed(ops).groupBy("state_key").agg(
        F.any_value("key_parts").alias("key_parts"), F.max("at").alias("at"))
    ttl = F.unix_seconds("at") + F.lit(ttl_sec).cast("long")
    return (expiry.join(attrs, "state_key", "left")
            .select("state_key", "key_parts",
                    F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"),
                    ttl.alias("ttl")))


def state_list(state: DataFrame, prefix: list[str] | None = None, exact_part: bool = False,
               limit: int = 50, after: str | None = None) -> DataFrame:
    """A page of entries in key order. The prefix matches the merged key's text,
    so ``task:a`` also finds ``task:ab`` unless ``exact_part`` is set."""
    if prefix:
        text = merge_key(F.array(*[F.lit(p) for p in prefix]))
        hit = F.col("state_key").startswith(text)
        if exact_part:
            hit = (F.col("state_key") == text) | F.col("state_key").startswith(F.concat(text, F.lit(":")))
        state = state.where(hit)
    if after:
        state = state.where(F.col("state_key") > after)
    return state.orderBy("state_key").limit(limit)


def state_get(state: DataFrame, keys: DataFrame | list[str]) -> DataFrame:
    """Entries of the given keys: one key as its parts, or a table of ``state_key``."""
    if isinstance(keys, list):
        return state.where(F.col("state_key") == merge_key(F.array(*[F.lit(p) for p in keys])))
    return state.join(keys, "state_key", "left_semi")


def state_put(state: DataFrame, entries: DataFrame) -> DataFrame:
    """Replace whole entries (``state_key, key_parts, attrs, ttl``); a null ttl
    removes the expiry."""
    return state.join(entries, "state_key", "left_anti").unionByName(entries)


def state_drop(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys, "state_key", "left_anti")


def state_pivot(state: DataFrame, attrs: list[str]) -> DataFrame:
    """One column per named attribute beside the merged key and the expiry."""
    return state.select("state_key", *[F.col("attrs")[a].alias(a) for a in attrs], "ttl")
