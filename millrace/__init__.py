"""Millrace: an event lake, keyed state and read-only analytics on Spark.

Messages addressed to named topics are checked, enriched and routed to ordered
streams, a partitioned JSON-lines lake and an upserted key-value table. All
work is expressed with DataFrames, Spark SQL and Structured Streaming.
"""
