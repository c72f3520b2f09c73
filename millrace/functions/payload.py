"""Message bodies: decoding, enrichment, attribute lists and item keys.

A JSON object is held as ``map<string,variant>`` so that values keep their JSON
type: ``"1"`` stays text and ``1`` a number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import (META_FIELDS, META_ID, META_KEY, META_ORG, META_RETENTION, META_TOPIC,
                       META_TS, OCTET_TYPE, TEXT_TYPES)
from .keys import merge_key


def bare_type(content_type: Column) -> Column:
    """Content type without parameters; a missing one counts as raw bytes."""
    bare = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.coalesce(bare, F.lit(OCTET_TYPE))


def decode_body(body: Column, content_type: Column) -> Column:
    """Text and JSON as UTF-8, everything else as base64."""
    return (F.when(bare_type(content_type).isin(TEXT_TYPES), F.decode(body, "UTF-8"))
            .otherwise(to_base64(body)))


def to_base64(data: Column) -> Column:
    """One line: the built-in breaks its output every 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


# fixed values: data formats of streams
FORMATS = ["STRING", "BINARY", "JSON", "AVRO", "PROTOBUF"]


def decode(body: Column, fmt: str, schema: str | None = None) -> Column:
    """A stream body (text) as a typed value: text, bytes from base64, or JSON
    read with a schema. Avro and Protobuf need Spark's own packages."""
    if fmt == "STRING":
        return body
    if fmt == "BINARY":
        return F.unbase64(body)
    if fmt == "JSON":
        return F.from_json(body, schema)
    if fmt == "AVRO":
        from pyspark.sql.avro.functions import from_avro
        return from_avro(F.unbase64(body), schema)
    raise ValueError(f"no decoder for {fmt}: add Spark's package for it and use its functions")


def encode(value: Column, fmt: str, schema: str | None = None) -> Column:
    """The reverse of :func:`decode`."""
    if fmt == "STRING":
        return value.cast("string")
    if fmt == "BINARY":
        return to_base64(value)
    if fmt == "JSON":
        return F.to_json(value)
    if fmt == "AVRO":
        from pyspark.sql.avro.functions import to_avro
        return to_base64(to_avro(value, schema) if schema else to_avro(value))
    raise ValueError(f"no encoder for {fmt}: add Spark's package for it and use its functions")


def parse_object(text: Column) -> Column:
    """A JSON object as ``map<string,variant>``; anything else gives null."""
    return F.from_json(text, "map<string,variant>")


def as_variant(value: Column) -> Column:
    return value.cast("variant")


def enriched_fields(fields: Column, *, ts: Column, key: Column, message_id: Column,
                    retention: Column, org: Column, topic: Column) -> Column:
    """Add the metadata fields; they win over same-named user fields, and null
    fields are dropped. Pass a null retention when the lake is off."""
    pairs = [(META_TS, F.unix_millis(ts)), (META_KEY, key), (META_ID, message_id),
             (META_RETENTION, retention), (META_ORG, org), (META_TOPIC, topic)]
    meta = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(name).alias("k"), as_variant(value).alias("v"))
                  for name, value in pairs]),
        lambda e: e["v"].isNotNull(),
    ))
    user = F.map_filter(fields, lambda k, v: ~F.is_variant_null(v) & ~k.isin(META_FIELDS))
    return F.map_concat(user, meta)


def project_attrs(fields: Column, whitelist: Column, blacklist: Column) -> Column:
    """Keep the whitelist (all when empty) without the blacklist; drop nulls."""
    allow = F.coalesce(whitelist, F.array().cast("array<string>"))
    deny = F.coalesce(blacklist, F.array().cast("array<string>"))
    return F.map_filter(
        fields,
        lambda k, v: ((F.size(allow) == 0) | F.array_contains(allow, k))
        & ~F.array_contains(deny, k) & v.isNotNull() & ~F.is_variant_null(v),
    )


def item_attrs(fields: Column) -> Column:
    """Stored form of attribute values: scalars as they are, lists and objects as
    their JSON text."""
    def stored(_, v):
        text = F.to_json(v)
        return F.when(F.substring(text, 1, 1).isin("[", "{"), as_variant(text)).otherwise(v)
    return F.transform_values(fields, stored)


def kv_keys(fields: Column, keys: Column) -> Column:
    """All key attributes of an item as ``map<string,string>``.

    A key part is the JSON text of the field: text keeps its quotes, a missing
    field is ``null``. A local index adds only its sort key.
    """
    def part(name):
        return F.coalesce(F.to_json(fields[name]), F.lit("null"))

    def entries(k):
        primary = k["type"] == "PRIMARY"
        prefix = F.lower(k["type"])
        number = k["index_no"].cast("string")
        pk_name = F.when(primary | (k["type"] == "LSI"), "pk").otherwise(F.concat(prefix, F.lit("pk"), number))
        sk_name = F.when(primary, "sk").otherwise(F.concat(prefix, F.lit("sk"), number))
        pk = merge_key(F.transform(k["pk_parts"], part))
        sk = merge_key(F.concat(F.array(k["range_prefix"]), F.transform(k["sk_parts"], part)))
        return F.filter(
            F.array(F.struct(F.when(k["type"] != "LSI", pk_name).alias("k"), pk.alias("v")),
                    F.struct(sk_name.alias("k"), sk.alias("v"))),
            lambda e: e["k"].isNotNull())

    return F.map_from_entries(F.flatten(F.transform(keys, entries)))
