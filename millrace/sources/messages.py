"""Continuous input of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import MESSAGES

# files taken per micro-batch unless the caller says otherwise; bounds its size
FILES_PER_TRIGGER = 64


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = MESSAGES,
                  **options) -> DataFrame:
    """A stream of message files; or of a Kafka topic where Spark's Kafka package
    is present (``fmt="kafka"``, rows as Kafka gives them)."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        return reader.options(**options).load()
    options.setdefault("maxFilesPerTrigger", FILES_PER_TRIGGER)
    return reader.schema(schema).options(**options).load(path)
