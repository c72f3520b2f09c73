"""Running values along time, per key, without one task per key.

A window partitioned by the key alone sorts a hot key in one task. Here time is
cut into chunks: each (key, chunk) is folded with a map-side combine, the chunk
totals (one row per key and chunk) are accumulated, and rows only meet the rows
of their own chunk. The rows are shuffled once, by (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_MS = 60_000


def running(df: DataFrame, keys: list[str], ts: str, tiebreak: list[str],
            sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
            chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Add inclusive running columns in the order ``ts, *tiebreak`` per key.

    ``sums`` maps a new column to a non-null number to add up, ``lasts`` to a value of
    which the latest non-null one is carried forward. Keys must not be null.
    """
    sums, lasts = sums or {}, lasts or {}
    work = df
    for name, value in {**sums, **lasts}.items():
        work = work.withColumn(f"_v_{name}", value)
    work = work.withColumn("_chunk", F.floor(F.unix_millis(ts) / chunk_ms))
    order = F.struct(ts, *tiebreak)
    totals = work.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), order)).alias(f"_c_{n}")
          for n in lasts])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in sums],
        *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in lasts])
    inside = (W.partitionBy(*keys, "_chunk").orderBy(ts, *tiebreak)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = work.join(carried, [*keys, "_chunk"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_p_{n}") + F.sum(f"_v_{n}").over(inside)).alias(n) for n in sums],
        *[F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_p_{n}")).alias(n)
          for n in lasts])


def ordered_stream(df: DataFrame) -> DataFrame:
    """The strict order of each (org, stream, message_key): a 1-based position."""
    return running(df, ["org", "stream", "message_key"], "received_at", ["seq"],
                   sums={"position": F.lit(1).cast("long")})


def ordered_partitions(df: DataFrame) -> DataFrame:
    """The same order as physical layout: range partitions over key and time, so
    a hot key spans several partitions and every partition is in order."""
    cols = ["org", "stream", "message_key", "received_at", "seq"]
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols)


def undelivered(df: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Messages still kept for delivery: the queue drops them after 14 days."""
    return df.where(F.col("received_at") >= now - F.make_dt_interval(days=F.lit(days)))


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, left_id: str,
              right_id: str, prefix: str = "r_", chunk_ms: int = 3_600_000) -> DataFrame:
    """Each left row with the latest right row of its key at or before it; of
    several at one time the one with the highest id. Unmatched rows keep nulls; a
    row with a null key or time matches nothing."""
    timed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    alone, left, right = left.where(~timed), left.where(timed), right.where(timed)
    rights = right.select(
        F.col(key), F.col(ts), F.lit(0).alias("_side"), F.col(right_id).alias("_id"),
        F.struct(*[F.col(c) for c in right.columns]).alias("_right"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"))
    lefts = left.select(
        F.col(key), F.col(ts), F.lit(1).alias("_side"), F.col(left_id).alias("_id"),
        F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("_right"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    run = running(rights.unionByName(lefts), [key], ts, ["_side", "_id"],
                  lasts={"_hit": F.col("_right")}, chunk_ms=chunk_ms)
    matched = run.where("_side = 1").select(
        "_left.*", *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in right.columns if c != key])
    return matched.unionByName(alone.select("*", *[
        F.lit(None).cast(f.dataType).alias(f"{prefix}{f.name}") for f in right.schema if f.name != key]))


def preceding_totals(left: DataFrame, right: DataFrame, key: str, ts: str, left_id: str,
                     value: Column, seconds: int, chunk_ms: int = 3_600_000) -> DataFrame:
    """Interval join with aggregation: count and sum of the right rows with the
    same key in ``[t - seconds, t]`` of each left row, for left rows with any.

    The pairs are never formed: both ends of the interval become probes into the
    running totals, and the difference is the answer."""
    zero = F.lit(0).cast("decimal(18,2)")
    marks = right.select(key, ts, F.lit(1).alias("_side"), F.lit(None).cast("long").alias(left_id),
                         F.lit(1).cast("long").alias("_n"), value.cast("decimal(18,2)").alias("_x"))
    probe = lambda when, side: left.select(
        F.col(key), when.alias(ts), F.lit(side).alias("_side"), F.col(left_id),
        F.lit(0).cast("long").alias("_n"), zero.alias("_x"))
    ends = probe(F.col(ts), 2)
    starts = probe(F.col(ts) - F.make_dt_interval(secs=F.lit(seconds)), 0)
    run = running(marks.unionByName(ends).unionByName(starts), [key], ts, ["_side"],
                  sums={"n": F.col("_n"), "total": F.col("_x")}, chunk_ms=chunk_ms)
    sign = F.when(F.col("_side") == 2, 1).otherwise(-1)
    return (run.where("_side <> 1").groupBy(key, left_id)
            .agg(F.sum(sign * F.col("n")).alias("n"), F.sum(sign * F.col("total")).alias("total"))
            .where("n > 0"))
