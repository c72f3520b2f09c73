"""User code on streams: several inputs, several outputs, state, failures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import once
from ..functions.keys import merge_key
from ..plans.sql import Loader, run_sql
from .state import KeyedProcessor, StateEntry

# what a handler sends: enough to be ingested as messages again
OUTPUT = ["topic", "message_key", "message_id", "body"]
OUTPUT_DDL = "topic string, message_key string, message_id string, body string"


@dataclass
class Processor:
    """``inputs`` maps a stream's name to a function from its messages to output
    rows (``OUTPUT`` columns). Works on batch and streaming messages. A message of any
    other stream fails alone: see :meth:`unknown`."""

    inputs: dict[str, Callable[[DataFrame], DataFrame]]

    def run(self, messages: DataFrame) -> DataFrame:
        outputs = [fn(messages.where(F.col("stream") == name)).select(*OUTPUT)
                   for name, fn in self.inputs.items()]
        out = outputs[0]
        for other in outputs[1:]:
            out = out.unionByName(other)
        return out

    def unknown(self, messages: DataFrame) -> DataFrame:
        """Dead letters: messages of streams that no function takes."""
        other = ~F.coalesce(F.col("stream").isin(list(self.inputs)), F.lit(False))
        return messages.where(other).withColumn(
            "failure", F.concat(F.lit("unknown source stream "), F.coalesce("stream", F.lit("null"))))

    def start(self, messages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
              trigger: dict) -> StreamingQuery:
        return (self.run(messages).writeStream.foreachBatch(sink)
                .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def task_scope(task: str) -> Column:
    """State key shared by all messages of a task."""
    return merge_key(F.array(F.lit("task"), F.lit(task)))


def key_scope(task: str) -> Column:
    """State key of one message key of a task."""
    return merge_key(F.array(F.lit("task"), F.lit(task), F.lit("key"), F.col("message_key")))


def stateful(messages: DataFrame, scope: Column, handler: Callable[[StateEntry, Row], list[Row]],
             output: str = OUTPUT_DDL, ttl_sec: int | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Run ``handler`` for each message in order, with the state of its scope.
    Messages need ``seq`` and ``received_at``. With ``ttl_sec`` a scope's state ends that
    long, in event time, after its latest message; messages later than ``lateness`` are
    left out then."""
    if ttl_sec:
        messages = messages.withWatermark("received_at", lateness)
    rows = messages.withColumn("state_key", scope).withColumn("at_us", F.unix_micros("received_at"))
    return rows.groupBy("state_key").transformWithState(
        KeyedProcessor(handler, ttl_sec), output, "Append", "EventTime" if ttl_sec else "None")


def last_value(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Latest value per key; the aggregate combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value),
                               F.max(F.struct(*order)).alias("as_of"))


def with_failures(df: DataFrame, decoded: Column, required: tuple[str, ...] = ("message_key", "message_id")) -> DataFrame:
    """Add ``value`` and ``failure``: a record without key or id, or whose decoding
    gives null, fails alone and the others go on."""
    failure = F.when(F.col("value").isNull(), "undecodable")
    for name in reversed(required):
        failure = F.when(F.coalesce(F.col(name), F.lit("")) == "", f"no {name}").otherwise(failure)
    return once(df, "value", decoded).withColumn("failure", failure)


def handle_each(df: DataFrame, handler: Callable[[dict], dict], output: str) -> DataFrame:
    """Run Python code per record in Arrow batches. An exception marks its record
    in ``failure`` and leaves the output columns null."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(output)
    out = T.StructType(df.schema.fields + fields.fields + [T.StructField("failure", T.StringType())])
    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            results, failures = [], []
            for record in batch.to_pylist():
                try:
                    results.append(handler(record))
                    failures.append(None)
                except Exception as e:  # noqa: BLE001  the record's failure is data
                    results.append({})
                    failures.append(f"{type(e).__name__}: {e}")
            new = [pa.array([r.get(f.name) for r in results], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *new, pa.array(failures, pa.string())],
                names=[*batch.schema.names, *arrow.names, "failure"])

    return df.mapInArrow(run, out)


def good(df: DataFrame) -> DataFrame:
    return df.where("failure is null").drop("failure")


def dead_letters(df: DataFrame) -> DataFrame:
    return df.where("failure is not null")


def replay(spark: SparkSession, tables: dict[str, Loader], sql: str, org: str, topic: str,
           key_col: str, id_col: str, at: Column) -> DataFrame:
    """Rows of a lake query as messages for a topic, ready for ``ingest``. ``at`` is
    their arrival time; ``seq`` follows from the id, so a second run gives the
    same messages."""
    rows = run_sql(spark, tables, sql)
    return rows.select(
        F.xxhash64(id_col).alias("seq"), F.lit(org).alias("org"), F.lit(topic).alias("topic"),
        F.col(key_col).cast("string").alias("message_key"), F.col(id_col).cast("string").alias("message_id"),
        F.lit("application/json").alias("content_type"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).cast("binary").alias("body"),
        at.alias("received_at"))
