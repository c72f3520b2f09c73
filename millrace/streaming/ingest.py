"""Streaming ingest: one query takes every message to all its destinations.

A message is checked and its body parsed once; the micro-batch is kept while the lake,
the store, the streams and the rejects are written from it. Every destination writes a
micro-batch under its number, in place of what an earlier run of the same micro-batch
has left: a run that is killed at any point is repeated to the same result. A marker,
written last, says that all have it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest as I
from ..session import adaptive, child_names, put_text
from ..sources.kv import upsert_kv
from ..sources.lake import write_lake_batch
from .dedup import MARK, accepted_marks, deliver

# fixed value: seconds after which buffered records are written
LAKE_TRIGGER = {"processingTime": "900 seconds"}

DESTINATIONS = ("lake", "store", "streams", "rejects")
_MARKED = "_mark"


def parsed_once(msgs: DataFrame, topics: DataFrame) -> DataFrame:
    """Every message with its verdict and, where lake or store want it, its fields. The
    body itself stays only where a stream takes it; no other destination reads it."""
    validated = I.validate(msgs, topics)
    usable = F.col("reject").isNull() & (F.col("cfg.has_batch") | F.col("cfg.store").isNotNull())
    streamed = F.col("reject").isNull() & (F.size("cfg.streams") > 0)
    return I.with_fields(validated, usable).withColumn("body", F.when(streamed, F.col("body")))


class IngestSink:
    """Use with ``writeStream.foreachBatch`` on ``parsed_once`` rows (``_mark`` false)
    together with the marks of accepted stream copies (``_mark`` true)."""

    def __init__(self, base: str):
        self.base = base

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        done = f"{self.base}/_batches"
        if str(batch_id) in child_names(spark, done):
            return
        df = df.persist()   # read for each destination; its size is that of one micro-batch
        try:
            with adaptive(spark):
                rows = df.where(~F.col(_MARKED)).drop(_MARKED)
                for name in DESTINATIONS:
                    if name == "streams":
                        marks = df.where(_MARKED).select(*MARK)
                        deliver(I.fan_out(I.accepted(rows)), marks, f"{self.base}/streams", batch_id)
                    else:
                        getattr(self, name)(rows, batch_id)
            put_text(spark, f"{done}/{batch_id}", "")
        finally:
            df.unpersist()

    def lake(self, rows: DataFrame, batch_id: int) -> None:
        write_lake_batch(I.lake_lines(I.accepted(rows)), f"{self.base}/lake", batch_id)

    def store(self, rows: DataFrame, batch_id: int) -> None:
        upsert_kv(I.store_items(I.accepted(rows)), f"{self.base}/store", batch_id)

    def rejects(self, rows: DataFrame, batch_id: int) -> None:
        wanted = I.accepted(rows).where(F.col("cfg.has_batch") | F.col("cfg.store").isNotNull())
        I.rejects(rows, wanted).write.mode("overwrite").parquet(f"{self.base}/rejects/batch={batch_id}")


def start_ingest(msgs: DataFrame, topics: DataFrame, base: str, checkpoint: str, trigger: dict | None = None,
                 interval: str = "5 minutes", keep: str = "24 hours") -> StreamingQuery:
    """Start ingest into ``lake``, ``store``, ``streams`` and ``rejects`` below ``base``.

    A message's ``seq`` and time name it: of rows with both equal one is delivered. The
    state of the dedup sees ids and times only; for that the stream's topics are looked
    up a second time, but no body is parsed again."""
    fanned = I.fan_out(I.accepted(I.validate(msgs, topics)))
    marks = accepted_marks(fanned, interval, keep)
    rows = parsed_once(msgs, topics).withColumn(_MARKED, F.lit(False))
    both = rows.unionByName(marks.withColumn(_MARKED, F.lit(True)), allowMissingColumns=True)
    return (both.writeStream.foreachBatch(IngestSink(base)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or LAKE_TRIGGER)).start())
