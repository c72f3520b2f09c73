import time

import pytest
from pyspark.sql import functions as F

from millrace.functions.sqlgate import NotReadOnly
from millrace.plans.runs import CANCELLED, FAILED, SUCCEEDED, QueryRuns


@pytest.fixture()
def tables(spark, scratch):
    path = scratch("t")
    spark.range(1000).select("id", (F.col("id") % 7).alias("k")).write.parquet(path)
    return {"stream_t": lambda s: s.read.parquet(path)}


def test_a_run_a_failure_and_a_cancellation(spark, scratch, tables):
    now = [1_700_000_000.0]
    runs = QueryRuns(spark, scratch("runs"), at_once=2, clock=lambda: now[0])
    good = runs.submit(tables, "SELECT k, count(*) AS n FROM stream_t GROUP BY k", "a", "ann")
    runs.wait(good)
    now[0] += 1
    bad = runs.submit(tables, "SELECT assert_true(id < 10, 'too large') AS x FROM stream_t", "a", "ann")
    runs.wait(bad)
    now[0] += 1
    # a query without an end in sight
    slow = runs.submit(tables, "SELECT count(*) AS n FROM stream_t a, range(100000000) b WHERE hash(a.id, b.id) = 1", "a", "bob")
    for _ in range(100):
        if runs.state(slow, "a") == "RUNNING":
            break
        time.sleep(0.1)
    assert runs.state(slow, "a") == "RUNNING" and runs.cancel(slow)
    runs.wait(slow)
    rows = runs.history("a").collect()
    assert [(r.query_id, r.state, r.user) for r in rows] == [(slow, CANCELLED, "bob"), (bad, FAILED, "ann"), (good, SUCCEEDED, "ann")]
    assert rows[2].bytes_scanned > 0 and rows[2].elapsed_ms >= 0 and "too large" in rows[1].reason
    assert sum(r.n for r in runs.result(good, "a").collect()) == 1000
    assert runs.history("b").count() == 0 and runs.state(good, "b") is None and not runs.cancel(good)
    with pytest.raises(ValueError, match="FAILED"):
        runs.result(bad, "a")
    with pytest.raises(NotReadOnly):
        runs.submit(tables, "DROP TABLE stream_t", "a", "ann")
    now[0] += 8 * 86400
    assert runs.history("a").count() == 0 and runs.expire("a") == 1 and runs.expire("a") == 0


def test_a_waiting_run_can_be_cancelled(spark, scratch, tables):
    runs = QueryRuns(spark, scratch("runs"), at_once=1)
    slow = runs.submit(tables, "SELECT count(*) AS n FROM stream_t a, range(100000000) b WHERE hash(a.id, b.id) = 1", "a", "u")
    waits = runs.submit(tables, "SELECT 1 AS one FROM stream_t", "a", "u")
    assert runs.cancel(waits) and runs.cancel(slow)
    runs.wait(slow)
    runs.wait(waits)
    assert {r.state for r in runs.history("a").collect()} == {CANCELLED}
