"""Classify HTTP requests to endpoints and extract their parameters.

A few definitions in code (``route``) compile into one ``when`` chain: a narrow
projection with no join. Any number of them as a table (``route_by_table``) is joined:
an endpoint is found by its method, by which of its parts are fixed, and by those
parts, so a request meets one row for each way of fixing parts at its depth, not one
for each endpoint.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .skew import salted_join

ENDPOINTS_DDL = ("name string, position long, method string, path string, query map<string,boolean>, "
                 "headers map<string,boolean>, cookies map<string,boolean>, content_types array<string>")


@dataclass(frozen=True)
class Endpoint:
    """``path`` like ``/user/{userId}/ip``; parameter maps say which are required."""
    name: str
    method: str
    path: str
    query: dict[str, bool] = field(default_factory=dict)
    headers: dict[str, bool] = field(default_factory=dict)
    cookies: dict[str, bool] = field(default_factory=dict)
    content_types: tuple[str, ...] = ()

    @property
    def parts(self) -> list[str]:
        return self.path.strip("/").split("/")


def path_parts(raw_path: Column) -> Column:
    """Path parts; the leading and any trailing slashes add none."""
    return F.split(F.regexp_replace(raw_path, "^/|/+$", ""), "/")


def lower_keys(m: Column) -> Column:
    """Names in lower case; of several that differ in case only the first in byte
    order (upper case before lower case) is kept."""
    entries = F.array_sort(F.map_entries(m))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(
        n, F.element_at(entries, F.array_position(names, n).cast("int"))["value"])))


def cookie_map(cookies: Column) -> Column:
    """Lower-case names; a repeated cookie's values are joined by ``"; "``."""
    pairs = F.transform(cookies, lambda c: F.struct(
        F.lower(F.substring_index(c, "=", 1)).alias("k"),
        F.when(F.instr(c, "=") > 0, F.regexp_replace(c, "(?s)^[^=]*=", "")).otherwise("").alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(
        n, F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), "; "))))


def _matches(e: Endpoint) -> Column:
    ok = (F.upper("method") == e.method.upper()) & (F.size("_path") == len(e.parts))
    for i, part in enumerate(e.parts):
        if not part.startswith("{"):
            ok = ok & (F.col("_path")[i] == part)
    for source, names in (("query", e.query), ("_headers", e.headers), ("_cookies", e.cookies)):
        for name, required in names.items():
            if required:
                key = name if source == "query" else name.lower()
                ok = ok & F.map_contains_key(source, key)
    if e.content_types:
        ok = ok & F.col("_type").isin(*[c.lower() for c in e.content_types])
    return F.coalesce(ok, F.lit(False))


def _params(e: Endpoint) -> Column:
    """The path's parts come first where two parameters have one name."""
    pairs = [(p[1:-1], F.col("_path")[i]) for i, p in enumerate(e.parts) if p.startswith("{")]
    pairs += [(n, F.col("query")[n]) for n in e.query]
    pairs += [(n, F.col("_headers")[n.lower()]) for n in e.headers]
    pairs += [(n, F.col("_cookies")[n.lower()]) for n in e.cookies]
    pairs = [p for i, p in enumerate(pairs) if p[0] not in [n for n, _ in pairs[:i]]]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.array(*[F.struct(F.lit(n), v.cast("string")) for n, v in pairs]))


def _prepared(log: DataFrame) -> DataFrame:
    return (
        log.withColumn("_path", path_parts(F.col("raw_path")))
        .withColumn("_headers", lower_keys(F.col("headers")))
        .withColumn("_cookies", cookie_map(F.col("cookies")))
        .withColumn("_type", F.lower(F.trim(F.split_part(
            F.coalesce(F.col("_headers")["content-type"], F.lit("text/plain")), F.lit(";"), F.lit(1)))))
    )


def route(log: DataFrame, endpoints: list[Endpoint]) -> DataFrame:
    """Add ``endpoint`` (the first that matches, else ``default``) and ``params``."""
    ready = _prepared(log)
    name, params = F.lit("default"), F.create_map().cast("map<string,string>")
    for e in reversed(endpoints):
        name = F.when(_matches(e), e.name).otherwise(name)
    ready = ready.withColumn("endpoint", name)
    for e in endpoints:
        params = F.when(F.col("endpoint") == e.name, _params(e)).otherwise(params)
    return ready.withColumn("params", params).drop("_path", "_headers", "_cookies", "_type")


def endpoint_table(spark: SparkSession, endpoints: list[Endpoint]) -> DataFrame:
    """Definitions as rows for ``route_by_table``, in their order."""
    return spark.createDataFrame(
        [(e.name, i, e.method, e.path, e.query, e.headers, e.cookies, list(e.content_types))
         for i, e in enumerate(endpoints)], ENDPOINTS_DDL)


def _pattern(parts: Column, fixed: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p, i: F.when(
        F.substring(fixed, i + 1, F.lit(1)) == "1", p).otherwise("{}")), "/")


def _definitions(endpoints: DataFrame) -> DataFrame:
    """One row per method and pattern: what its endpoints ask for, in their order. An
    endpoint behind one that asks for the same can never match and is left out, so a
    row's list is as long as the ways to ask."""
    parts = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/")

    def names(column, lower=False):
        keys = F.coalesce(F.map_keys(column), F.array().cast("array<string>"))
        return F.transform(keys, F.lower) if lower else keys

    def needs(column, lower=False):
        return F.array_sort(F.array_distinct(names(F.map_filter(column, lambda _, required: required), lower)))
    ready = endpoints.withColumn("parts", parts).withColumn("fixed", F.array_join(F.transform(
        "parts", lambda p: F.when(p.startswith("{"), "0").otherwise("1")), "")).select(
        F.upper("method").alias("_method"), "fixed", _pattern(F.col("parts"), F.col("fixed")).alias("pattern"),
        needs("query").alias("ask_query"), needs("headers", True).alias("ask_headers"),
        needs("cookies", True).alias("ask_cookies"),
        F.array_sort(F.transform(F.coalesce("content_types", F.array().cast("array<string>")), F.lower)).alias("types"),
        F.struct("position", "name", "parts", names("query").alias("query"), names("headers").alias("headers"),
                 names("cookies").alias("cookies")).alias("end"))
    place, ask = ["_method", "fixed", "pattern"], ["ask_query", "ask_headers", "ask_cookies", "types"]
    return (ready.groupBy(*place, *ask).agg(F.min("end").alias("end"))
            .groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("end", *ask))).alias("ends")))


def _named(end: Column) -> Column:
    """Parameters of the endpoint a request went to; the path's parts come first where two
    have one name."""
    def pairs(names, value):
        return F.transform(names, lambda n: F.struct(n.alias("name"), value(n).alias("value")))
    path = F.filter(F.transform(end["parts"], lambda p, i: F.struct(
        F.when(p.startswith("{"), F.substring(p, F.lit(2), F.length(p) - 2)).alias("name"),
        F.get(F.col("_path"), i).alias("value"))), lambda p: p["name"].isNotNull())
    found = F.concat(path, pairs(end["query"], lambda n: F.col("query")[n]),
                     pairs(end["headers"], lambda n: F.col("_headers")[F.lower(n)]),
                     pairs(end["cookies"], lambda n: F.col("_cookies")[F.lower(n)]))
    kept = F.filter(found, lambda p, i: F.array_position(F.transform(found, lambda q: q["name"]), p["name"]) == i + 1)
    return F.coalesce(F.map_from_entries(kept), F.create_map().cast("map<string,string>"))


def route_by_table(log: DataFrame, endpoints: DataFrame, key: str) -> DataFrame:
    """``route`` with the endpoints as a table (``ENDPOINTS_DDL``): the matching one of least
    ``position`` (then ``name``) wins. ``key`` names a request, uniquely; requests without
    one go to ``default``. Only names of parameters are shuffled to the endpoints, and a
    pattern that many requests meet is salted."""
    ends = _definitions(endpoints)
    # one row per depth of a path
    ways = (ends.select(F.length("fixed").alias("_depth"), "fixed").distinct()
            .groupBy("_depth").agg(F.collect_set("fixed").alias("ways")))
    ready = _prepared(log)

    def names(column):
        return F.coalesce(F.map_keys(column), F.array().cast("array<string>"))
    asked = (ready.select(F.col(key), F.upper("method").alias("_method"), "_path", F.size("_path").alias("_depth"),
                          names("query").alias("in_query"), names("_headers").alias("in_headers"),
                          names("_cookies").alias("in_cookies"), F.col("_type").alias("type"))
             .join(ways, "_depth").withColumn("fixed", F.explode("ways"))
             .withColumn("pattern", _pattern(F.col("_path"), F.col("fixed"))).drop("_path", "_depth", "ways"))

    def fits(e):
        ok = (F.size(e["types"]) == 0) | F.array_contains(e["types"], F.col("type"))
        for source in ("query", "headers", "cookies"):
            ok = ok & (F.size(F.array_except(e[f"ask_{source}"], F.col(f"in_{source}"))) == 0)
        return ok
    met = salted_join(asked, ends, ["_method", "fixed", "pattern"], "inner")
    first = (met.select(key, F.get(F.filter("ends", fits), F.lit(0))["end"].alias("_end")).where("_end is not null")
             .groupBy(key).agg(F.min("_end").alias("_end")))
    return (ready.join(first, key, "left")
            .withColumn("endpoint", F.coalesce(F.col("_end")["name"], F.lit("default")))
            .withColumn("params", _named(F.col("_end"))).drop("_path", "_headers", "_cookies", "_type", "_end"))
