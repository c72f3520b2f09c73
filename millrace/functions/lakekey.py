"""Lake object keys: ``retention=/organization=/topic=/year=/month=/day=/hour=/file``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed value: the key format
KEY_PATTERN = (r"^retention=([^/]+)/organization=([^/]+)/topic=([^/]+)"
               r"/year=(\d+)/month=(\d+)/day=(\d+)/hour=(\d+)/(.+)$")
PARTS = ["retention", "organization", "topic", "year", "month", "day", "hour", "filename"]


def parse_lake_key(key: Column) -> Column:
    """Struct of the key's parts; a key of another form is all filename."""
    fits = key.rlike(KEY_PATTERN)
    return F.struct(*[
        F.when(fits, F.regexp_extract(key, KEY_PATTERN, i + 1))
        .otherwise(key if name == "filename" else F.lit(None).cast("string")).alias(name)
        for i, name in enumerate(PARTS)
    ])
