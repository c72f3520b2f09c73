"""URL filters by a temporal list join.

A list is a log of dated entries: from a day on, a key (a host, or a host with a path
prefix) is listed under a category, or no longer listed. Per key and category the log
becomes validity intervals. Every capture is looked up under all keys its URL falls
under and joined as of its fetch time, so it is judged by the list of that time.

The join is on key and time slice: intervals are cut at ``SLICES`` equal slices of the
time that captures cover, so a key with a long history, or a host with a third of all
captures, meets only the few intervals of a slice; both sides are plain join keys that
AQE splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def keys(url: Column, depths: list[int]) -> Column:
    """The keys a URL falls under: its host and every parent domain of two labels or
    more, and its host with as many leading path segments as ``depths`` names. Host
    names are compared in lower case, paths as they are."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    segments = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda s: s != "")
    asked = F.array(*[F.lit(d) for d in depths if d > 0]).cast("array<int>")
    prefixes = F.transform(
        F.filter(asked, lambda d: d <= F.size(segments)),
        lambda d: F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(segments, F.lit(1), d))))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """``(key, category, valid_from, valid_to)`` from ``(key, category, at, listed)``.

    Each entry holds until the next of its key and category; of entries at the same
    time a listing wins over a removal. Entries with a null key, category or time do
    not count, a null ``listed`` is a removal. The last interval is open (null)."""
    known = entries.where("key is not null and category is not null and at is not null")
    known = known.groupBy("key", "category", "at").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    following = F.lead("at").over(Window.partitionBy("key", "category").orderBy("at"))
    return known.select("key", "category", F.col("at").alias("valid_from"), following.alias("valid_to"),
                        "listed").where("listed").drop("listed")


def judge(captures: DataFrame, entries: DataFrame, capture_id: str, url: str, fetched: str) -> DataFrame:
    """``(capture_id, fetched_at, categories, blocked)``, one row per capture row.

    ``categories`` are the categories that list any of the capture's keys at its fetch
    time, sorted; an interval holds from its first moment to before its last. Captures
    with a null URL, one without a host, or a null fetch time are listed nowhere.
    Rows that repeat, also under one id, are judged each. Other columns are not read.
    """
    own = captures.select(F.col(capture_id).alias("capture_id"), F.col(url).alias("_url"),
                          F.col(fetched).alias("fetched_at"))
    # equal captures are judged once: the lookup below may then be joined back by value
    asked = own.where("fetched_at is not null").select("_url", "fetched_at").distinct()
    span = asked.agg(F.min(F.unix_micros("fetched_at")).alias("lo"), F.max(F.unix_micros("fetched_at")).alias("hi"))
    lo, hi = span.first()
    lo, hi = lo or 0, hi or 0
    width = (hi - lo) // SLICES + 1

    def place(t: Column) -> Column:
        return F.floor((F.unix_micros(t) - lo) / width).cast("int")

    held = intervals(entries).where((F.unix_micros("valid_from") <= hi)
                                    & (F.col("valid_to").isNull() | (F.unix_micros("valid_to") > lo)))
    # path segments of the listed prefixes: only of these lengths are prefixes looked up
    depths = sorted(r["depth"] for r in entries.where("key is not null").select(
        F.length(F.regexp_replace("key", "[^/]", "")).alias("depth")).distinct().collect())
    sliced = held.withColumn("slice", F.explode(F.sequence(
        F.greatest(place(F.col("valid_from")), F.lit(0)),
        F.least(F.coalesce(place(F.col("valid_to")), F.lit(SLICES)), F.lit(SLICES)))))
    looked = (asked.withColumn("key", F.explode(keys(F.col("_url"), depths))).withColumn("slice", place(F.col("fetched_at"))))
    hits = (looked.join(sliced, ["key", "slice"])
            .where((F.col("valid_from") <= F.col("fetched_at"))
                   & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
            .groupBy("_url", "fetched_at").agg(F.array_sort(F.collect_set("category")).alias("categories")))
    out = own.join(hits, ["_url", "fetched_at"], "left")
    categories = F.coalesce("categories", F.array().cast("array<string>"))
    return out.select("capture_id", "fetched_at", categories.alias("categories"),
                      (F.size(categories) > 0).alias("blocked"))
