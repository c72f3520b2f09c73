"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Instead of sending every row to a random shard, which leaves sizes to chance, the
counts come first: how many rows of each partition go to each shard is drawn from
the multivariate hypergeometric law, so that rows and columns of the matrix add up
exactly and every arrangement is as likely as in one big shuffle. Then every
partition permutes its rows and deals them out by these counts, the rows are
exchanged, and every shard permutes what it got. Both permutations sort by a seeded
hash; a shard is permuted in hash ranges, so that no task holds a shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SEED = 20240229


def communication_matrix(rows: list[int], shards: list[int], seed: int = SEED) -> np.ndarray:
    """``m[p, s]``: rows of partition p for shard s, drawn so that m sums to ``rows``
    along a partition and to ``shards`` along a shard."""
    draw = np.random.default_rng(seed)
    left = np.array(shards, dtype=np.int64)
    m = np.zeros((len(rows), len(shards)), dtype=np.int64)
    for p, n in enumerate(rows):
        rest = n
        for s in range(len(shards)):
            if rest == 0:
                break
            after = int(left[s + 1:].sum())
            m[p, s] = _hypergeometric(draw, int(left[s]), after, rest)
            rest -= m[p, s]
        left -= m[p]
    return m


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without return, by the exact law at any size: the chances
    follow from each other by the ratio of neighbours, outwards from the likeliest number
    to where less than one in 10^25 is left, and one uniform number picks among them."""
    low, high = max(0, n - bad), min(good, n)
    if low >= high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = 50 + int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))))
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(float(bad - n) + k + 1)
    logs = np.concatenate([np.zeros(1), np.cumsum(step)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chances, draw.random() * chances[-1], side="right"))


def _places(df: DataFrame, group: list[str], by: list[str], name: str, ranges: int) -> DataFrame:
    """Number the rows of each group from 0 in the order of ``by``, whose first column
    is a uniform long: ranges of it are numbered apart, behind the counts before them."""
    part = F.shiftrightunsigned(F.col(by[0]), 32) * ranges   # of 2^32
    cut = df.withColumn("_range", F.shiftright(part, 32).cast("int"))
    counts = cut.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = cut.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*by)))
    return (numbered.join(counts, [*group, "_range"])
            .withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_range", "_before", "_row"))


def shard(df: DataFrame, shards: int, key: list[str], seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0 upwards, without gaps, a
    random order within the shard); columns of these names are replaced.

    Shard sizes differ by one row at most. ``key`` names columns that rows are told
    apart by; they only seed the permutation, so they may hold nulls and repeat: rows
    with equal keys are told apart by a number. An empty table gives no rows.

    ``partitions`` (by default the session's shuffle partitions, 32 at least) is the
    number of rows of the matrix, which alone reaches the driver.
    """
    spark = df.sparkSession
    partitions = partitions or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    carried = [c for c in df.columns if c not in ("shard", "slot")]
    # deal to partitions by key and number, so that neither repeated rows nor a hot key fill one
    rows = df.select(*carried).withColumn("_number", F.monotonically_increasing_id())
    rows = rows.withColumn("_partition", F.pmod(F.xxhash64(F.lit(seed), "_number", *key), F.lit(partitions)).cast("int"))
    rows = settle(rows, "rows")
    counted = {r["_partition"]: r["n"] for r in rows.groupBy("_partition").agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counted.get(p, 0) for p in range(partitions)], sizes, seed)
    ends = np.cumsum(matrix, axis=1).tolist()

    first = rows.withColumn("_r", F.xxhash64(F.lit(seed + 1), "_number", *key))
    placed = _places(first, ["_partition"], ["_r", "_number"], "_place", 8)
    table = spark.createDataFrame([(p, e) for p, e in enumerate(ends)], "_partition int, _ends array<long>")
    dealt = placed.join(F.broadcast(table), "_partition").withColumn(
        "shard", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))).cast("int"))
    again = dealt.withColumn("_r", F.xxhash64(F.lit(seed + 2), "_number", *key))
    return _places(again, ["shard"], ["_r", "_number"], "slot", partitions).select(*carried, "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Write sharded rows in the order of their slots, one folder per shard; the files
    of a shard, by name, hold rising ranges of slots."""
    (df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
