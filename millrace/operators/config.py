"""Topic configuration: lookup with fallbacks and the versioned update log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import DEFAULT_RETENTION, STORE

_CFG = f"struct<has_batch:boolean,retention:string,streams:array<string>,store:{STORE}>"


def _cfg() -> F.Column:
    return F.struct("has_batch", "retention", "streams", "store")


def resolve_topics(msgs: DataFrame, topics: DataFrame) -> DataFrame:
    """Attach each message's topic configuration as column ``cfg``.

    Order: the topic itself; if undefined topics are allowed (unset means
    allowed) the org's default, then the global default (lake only); else null.
    Of several versions the highest holds, so a message is never multiplied.
    Neither join carries a broadcast hint: the configuration grows with the
    tenants, so Catalyst checks its size and AQE splits a hot topic otherwise.
    """
    version = F.coalesce("version", F.lit(-1).cast("long"))
    explicit = topics.where(F.col("topic").isNotNull()).groupBy("org", "topic").agg(
        F.max_by(_cfg(), version).alias("own"))
    defaults = topics.where(F.col("topic").isNull()).groupBy("org").agg(
        F.max_by(F.struct("allow_undefined", _cfg().alias("fallback")), version).alias("default")).select(
        "org", "default.*")   # as given, destinations all off too
    global_default = F.struct(
        F.lit(True).alias("has_batch"), F.lit(DEFAULT_RETENTION).alias("retention"),
        F.array().cast("array<string>").alias("streams"), F.lit(None).cast(STORE).alias("store"))
    return (
        msgs.join(explicit, ["org", "topic"], "left").join(defaults, "org", "left")
        .withColumn("cfg", F.coalesce(
            F.col("own"),
            F.when(F.coalesce("allow_undefined", F.lit(True)),
                   F.coalesce(F.col("fallback"), global_default.cast(_CFG)))))
        .drop("own", "allow_undefined", "fallback")
    )
