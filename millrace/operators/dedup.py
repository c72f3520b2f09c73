"""Exact interval dedup per ordered stream, message key and message id.

Rule: in time order a copy is accepted iff it comes at least ``interval`` after
the last *accepted* copy. That is a chain of decisions, and one id may own a
third of all rows, so no id is ever gathered in one task:

1. Time is cut into slots of one interval; a slot accepts at most one copy. Ids
   and slots are summed up with a map-side combine, without bodies. A slot at
   least an interval after the copies before it accepts its first copy, whatever
   was accepted earlier. Nearly all slots end here.
2. In slots closer together the chain has to be followed. Each time points to the
   time that would be accepted after it, and the chain is found by pointer doubling:
   log2(chain length) equi-joins on unique ``(id, time)`` keys. Windows run over one
   id and slot pair at most, two intervals of milliseconds.
3. The messages themselves are shuffled once, after their own map-side combine
   of copies of one id and millisecond, to meet the accepted times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage

GROUP = ["org", "stream", "message_key", "dedup_id"]


def interval_ms(interval: str) -> int:
    amount, unit = interval.split()
    # fixed values: milliseconds per unit
    scale = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000}
    return int(amount) * scale[unit.rstrip("s")]


def dedup_id():
    """The given id, else a hash of the content."""
    return F.coalesce(F.col("message_id"), F.sha2(F.col("body"), 256))


def with_cell(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_id", dedup_id()).withColumn("t", F.unix_millis("received_at"))


def dedup(df: DataFrame, interval: str = "5 minutes") -> DataFrame:
    """Keep the accepted copies. Rows need ``org, stream, message_key,
    message_id, body, received_at, seq``; copies of the same millisecond are
    ordered by ``received_at, seq``."""
    width = interval_ms(interval)
    keyed = with_cell(df)
    times = keyed.select(*GROUP, "t", F.floor(F.col("t") / width).alias("slot"))
    by_group = W.partitionBy(*GROUP).orderBy("slot")
    slots = cut_lineage(
        times.groupBy(*GROUP, "slot").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        # one row per id and interval of time, whatever the number of copies
        .withColumn("prev_hi", F.lag("hi").over(by_group))
        .withColumn("next_lo", F.lead("lo").over(by_group))
        .withColumn("head", F.col("prev_hi").isNull() | (F.col("lo") - F.col("prev_hi") >= width))
        .withColumn("tail", F.col("next_lo").isNull() | (F.col("next_lo") - F.col("hi") >= width))
    )
    winners = slots.where("head").select(*GROUP, F.col("lo").alias("t"))
    linked = slots.where(~(F.col("head") & F.col("tail")))
    if not linked.isEmpty():
        winners = winners.unionByName(_close_winners(times, linked, width))
    first = F.min_by(F.struct(*df.columns), F.struct("received_at", "seq"))
    cells = keyed.groupBy(*GROUP, "t").agg(first.alias("row"))
    return cells.join(winners, [*GROUP, "t"], "left_semi").select("row.*")


def _close_winners(times: DataFrame, linked: DataFrame, width: int) -> DataFrame:
    """Accepted times in linked slots."""
    points = (times.distinct().join(linked.select(*GROUP, "slot", "next_lo"), [*GROUP, "slot"])
              .select(*GROUP, "slot", "t", "next_lo"))
    return _chain(points, linked.where("head").select(*GROUP, F.col("lo").alias("t")), width)


def _chain(points: DataFrame, heads: DataFrame, width: int) -> DataFrame:
    """Times reached from the heads by pointer doubling."""
    points = cut_lineage(points)
    # a time's successor lies in the next slot or, if that has none late enough,
    # is the first time of the slot after it
    probes = points.select(*GROUP, (F.col("slot") + 1).alias("slot"),
                           (F.col("t") + width).alias("at"), F.col("t").alias("probe"),
                           F.col("next_lo"), F.lit(None).cast("long").alias("point"),
                           F.lit(None).cast("long").alias("own_next"))
    marks = points.select(*GROUP, "slot", F.col("t").alias("at"), F.lit(None).cast("long").alias("probe"),
                          F.lit(None).cast("long").alias("next_lo"), F.col("t").alias("point"),
                          F.col("next_lo").alias("own_next"))
    # descending, so that "at or after" is a running minimum and not a shrinking frame
    ahead = (W.partitionBy(*GROUP, "slot").orderBy(F.col("at").desc())
             .rangeBetween(W.unboundedPreceding, W.currentRow))
    whole = W.partitionBy(*GROUP, "slot")
    succ = (
        probes.unionByName(marks)
        .withColumn("hit", F.min("point").over(ahead))
        .withColumn("after", F.max("own_next").over(whole))
        .where(F.col("probe").isNotNull())
        # next_lo is the first time of the next slot in use: take it when it is
        # late enough, else the slot after that one starts late enough
        .select(*GROUP, F.col("probe").alias("t"), F.coalesce(
            F.col("hit"),
            F.when(F.col("next_lo") >= F.col("at"), F.col("next_lo")),
            F.col("after")).alias("nxt"))
        .where(F.col("nxt").isNotNull())
    )
    jumps = cut_lineage(succ)
    reached = cut_lineage(heads)
    count = reached.count()
    while True:
        step = reached.join(jumps, [*GROUP, "t"]).select(*GROUP, F.col("nxt").alias("t"))
        reached = cut_lineage(reached.unionByName(step).distinct())
        grown = reached.count()
        if grown == count:
            break
        count = grown
        further = jumps.select(*GROUP, F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        jumps = cut_lineage(
            jumps.join(further, [*GROUP, "nxt"]).select(*GROUP, "t", F.col("far").alias("nxt")))
    return reached
