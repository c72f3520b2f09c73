"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 1 / 256
SALTS = 64


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = 1) -> DataFrame:
    """Keys that own at least ``share`` of the rows, and ``least`` rows. There are at most
    ``1 / share`` of them whatever the data, so the list may be broadcast."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.groupBy().agg(F.sum("n"))   # over the same exchange as the counts
    return counts.where(F.col("n") >= F.greatest(F.ceil(total.scalar() * share), F.lit(least))).select(*keys)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "left",
                hot: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Equi-join ``many`` rows with at most one row of ``one`` per key. Rows of a
    hot key are dealt over ``salts`` tasks, and only that key's row of ``one``
    is copied; all other keys join as usual. ``hot`` may bring a list from
    :func:`hot_keys` made earlier."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    if hot is None:
        hot = hot_keys(many, keys)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    dealt = many.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*many.columns), F.lit(salts)))
        .otherwise(F.lit(0)).cast("int")).drop("_hot")
    copied = one.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                           .otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
