"""Operational analytics: throughput, quotas, task status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# fixed values: daily request quota by plan; unlimited plans have none
PLAN_QUOTA = {1: 1_000, 2: 86_400, 3: 864_000, 4: 8_640_000}
# fixed values: weight of a source's state in the roll-up
STATE_WEIGHT = {"RUNNING": 0, "STARTING": 1, "PAUSED": 2, "PAUSING": 3, "UPDATING": 4, "CREATING": 5}


def throughput(validated: DataFrame, every: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Messages, bytes, rejects and error rate per org, topic and time bucket.
    A stream needs a watermark to bound its state."""
    if watermark:
        validated = validated.withWatermark("received_at", watermark)
    rejected = F.col("reject_code").isNotNull().cast("long")
    return (
        validated.groupBy("org", "topic", F.window("received_at", every).alias("w"))
        .agg(F.count("*").alias("messages"), F.sum(F.octet_length("body")).alias("bytes"),
             F.sum(rejected).alias("rejects"))
        .select("org", "topic", F.col("w.start").alias("start"), "messages", "bytes", "rejects",
                (F.col("rejects") / F.col("messages")).alias("error_rate"))
    )


def usage(msgs: DataFrame, plans: DataFrame) -> DataFrame:
    """Requests per org and UTC day against the org's daily quota (``org,
    quota``; null is unlimited), with the time of the first request over it.

    The request is found by counting seconds first: only the one second in which a
    day crosses its quota is read again row by row.
    """
    seconds = msgs.groupBy("org", F.date_trunc("second", "received_at").alias("second")).agg(
        F.count("*").alias("n"))
    by_day = W.partitionBy("org", "day").orderBy("second").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = (seconds.withColumn("day", F.to_date("second")).join(plans, "org", "left")
               .withColumn("upto", F.sum("n").over(by_day)))
    over_quota = F.col("quota").isNotNull() & (F.col("upto") > F.col("quota"))
    nth = F.col("quota") - F.col("upto") + F.col("n") + 1
    days = counted.groupBy("org", "day").agg(
        F.sum("n").alias("requests"), F.first("quota").alias("quota"),
        F.min(F.when(over_quota, F.struct("second", nth.alias("nth")))).alias("cross"))
    cross = days.where("cross is not null").select("org", "cross.second", "cross.nth")
    in_second = W.partitionBy("org", "second").orderBy("received_at", "seq")
    first_over = (
        msgs.select("org", "received_at", "seq", F.date_trunc("second", "received_at").alias("second"))
        .join(cross, ["org", "second"])
        .withColumn("rn", F.row_number().over(in_second)).where("rn = nth")
        .select("org", F.to_date("second").alias("day"), F.col("received_at").alias("first_over")))
    return (days.drop("cross").join(first_over, ["org", "day"], "left")
            .withColumn("exceeded", F.col("first_over").isNotNull()))


def state_weight(state: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STATE_WEIGHT.items() for x in kv])[state]


def task_status(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """A task's state is its heaviest source's; a declared queue without a source
    counts as paused, a task without queues as running. Tasks: ``org, task,
    queues``; sources: ``org, task, queue, state``."""
    declared = tasks.select("org", "task", F.explode_outer("queues").alias("queue"))
    states = declared.join(sources, ["org", "task", "queue"], "left").withColumn(
        "state", F.coalesce("state", F.when(F.col("queue").isNull(), "RUNNING").otherwise("PAUSED")))
    return states.groupBy("org", "task").agg(
        F.max_by("state", state_weight(F.col("state"))).alias("status"),
        F.count("queue").alias("queues"))
