import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.config_log import apply_config, chunk_moves
from millrace.schemas import small_df

DDL = "org string, seq long, topic string, action string, expect long, config string"


def sequential(updates):
    version, out = {}, {}
    for org, seq, expect in sorted(updates, key=lambda u: u[:2]):
        v = version.get(org, 0)
        ok = expect is None or expect == v
        version[org] = v + ok
        out[org, seq] = (v + ok, ok)
    return out


def replay(expected, version):
    for e in expected:
        version += e is None or e == version
    return version


@pytest.mark.parametrize("seed", range(40))
def test_a_chunk_is_a_function_of_the_version(seed):
    rng = random.Random(seed)
    expected = [rng.choice([None, rng.randrange(6), rng.randrange(6)]) for _ in range(rng.randrange(30))]
    shift, moves = chunk_moves(expected)
    for v in range(-3, 14):
        assert replay(expected, v) == moves.get(v, v) + shift


def log(rng, org, n):
    """Clients that mostly know the version, or one a little older, or do not ask."""
    version, out = 0, []
    for seq in range(n):
        expect = rng.choice([None, version, version, max(version - rng.randrange(4), 0), version + rng.randrange(1, 3)])
        version += expect is None or expect == version
        out.append((org, seq, expect))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 17, 1000])
def test_chunks_equal_the_sequential_log(spark, chunk):
    rng = random.Random(chunk)
    updates = [u for o, n in (("a", 1), ("b", 60), ("c", 2), ("d", 25), ("e", 1)) for u in log(rng, o, n)]
    # versions asked for long before they are reached, and the same one over and over
    updates += [("x", i, e) for i, e in enumerate([5, 4, 3, 2, 1, 0, 0, 1, None, 3, 3, 3, 2, 4, 1, 5, None, 7] * 2)]
    rows = [dict(org=o, seq=s, topic="t", action="put", expect=e, config="c") for o, s, e in updates]
    rng.shuffle(rows)
    got = {(r.org, r.seq): (r.version, r.accepted) for r in apply_config(small_df(spark, rows, DDL), chunk).collect()}
    assert got == sequential(updates)


def test_empty_log(spark):
    assert apply_config(small_df(spark, [], DDL)).count() == 0


def test_one_org_with_a_million_updates(spark):
    """One org's log over many tasks: a third ask for nothing, the others for a version
    that the sequential log reaches now and then."""
    n = 1_000_000
    df = spark.range(n).select(
        F.lit("one").alias("org"), F.col("id").alias("seq"), F.lit("t").alias("topic"), F.lit("put").alias("action"),
        F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 2) + F.pmod(F.xxhash64("id"), F.lit(9)) - 4).alias("expect"),
        F.lit("c").alias("config"))
    updates = [("one", r.seq, r.expect) for r in df.select("seq", "expect").toLocalIterator()]
    done = apply_config(df, chunk=20_000)
    got = done.agg(F.sum(F.col("version") * F.pmod("seq", F.lit(1009))), F.count_if("accepted"), F.max("version")).first()
    want = sequential(updates)
    assert tuple(got) == (sum(v * (s % 1009) for (_, s), (v, _) in want.items()), sum(ok for _, ok in want.values()),
                          max(v for v, _ in want.values()))
    spread = done.groupBy(F.spark_partition_id()).count().count()
    assert spread > 1
