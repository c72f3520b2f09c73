"""Runs of submitted SQL: in the background, recorded, cancelled on request.

Every run has an id, which tags all jobs that Spark starts for it. Its entry in the
history is one small file, written anew with each state: queued, running, then succeeded,
failed or cancelled, with the bytes that the run's tasks have read and its time. Entries
lie by org and day, so a listing reads the days that are still alive.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import child_names, delete_path, get_text, put_text
from .sql import HISTORY_DAYS, HISTORY_PAGE, Loader, history, run_sql

# fixed values: the states of a run
QUEUED, RUNNING, SUCCEEDED, FAILED, CANCELLED = "QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED"

ENTRY = ("query_id string, org string, user string, sql string, submitted_ms long, state string, reason string, "
         "bytes_scanned long, elapsed_ms long")


def _day(submitted_ms: int) -> str:
    return dt.datetime.fromtimestamp(submitted_ms / 1000, dt.timezone.utc).strftime("%Y-%m-%d")


class QueryRuns:
    """Runs of all orgs with results and history below ``base``; ``at_once`` of them run,
    the others wait."""

    def __init__(self, spark: SparkSession, base: str, at_once: int = 8, clock: Callable[[], float] = time.time):
        self.spark, self.base, self.clock = spark, base, clock
        self.pool = ThreadPoolExecutor(at_once)
        self.open: dict[str, tuple[Future, dict]] = {}
        self.stopped: set[str] = set()

    def submit(self, tables: dict[str, Loader], sql: str, org: str, user: str) -> str:
        """Start a run and return its id. A text that fails the checks is refused here:
        it raises and leaves no entry."""
        checked = run_sql(self.spark, tables, sql)
        entry = dict(query_id=uuid.uuid4().hex, org=org, user=user, sql=sql, submitted_ms=int(self.clock() * 1000),
                     state=QUEUED, reason=None, bytes_scanned=None, elapsed_ms=None)
        self._record(entry)
        self.open[entry["query_id"]] = self.pool.submit(self._run, entry, checked), entry
        return entry["query_id"]

    def _record(self, entry: dict) -> None:
        day = _day(entry["submitted_ms"])
        put_text(self.spark, f"{self.base}/history/org={entry['org']}/day={day}/{entry['query_id']}.json", json.dumps(entry))

    def _run(self, entry: dict, query: DataFrame) -> None:
        run, sc = entry["query_id"], self.spark.sparkContext
        started = self.clock()
        sc.addJobTag(run)
        try:
            entry["state"] = RUNNING
            self._record(entry)
            query.write.mode("overwrite").parquet(self.result_path(run))
            entry["state"] = SUCCEEDED
        except Exception as e:  # noqa: BLE001  the run's failure is data
            entry["state"] = CANCELLED if run in self.stopped else FAILED
            entry["reason"] = str(e).split("\n", 1)[0][:500]
        finally:
            sc.removeJobTag(run)
            entry["elapsed_ms"] = int((self.clock() - started) * 1000)
            entry["bytes_scanned"] = self._bytes_read(run)
            self._record(entry)
            self.open.pop(run, None)

    def _bytes_read(self, run: str) -> int:
        """Bytes that the tasks of the run's jobs have read from their sources."""
        core = self.spark._jsc.sc()
        tracker, store, total = core.statusTracker(), core.statusStore(), 0
        stages = set()
        for job in tracker.getJobIdsForTag(run):
            info = tracker.getJobInfo(job)
            if info.isDefined():
                stages.update(info.get().stageIds())
        for stage in stages:
            try:
                total += store.lastStageAttempt(stage).inputBytes()
            except Exception:  # noqa: BLE001  a skipped stage, or one that Spark has forgotten
                continue
        return total

    def cancel(self, run: str) -> bool:
        """Stop a run that waits or runs, and return when it has ended; false when it had
        before. Jobs that the run starts meanwhile are stopped, too."""
        found = self.open.get(run)
        if found is None:
            return False
        future, entry = found
        self.stopped.add(run)
        if future.cancel():   # it has not begun
            entry.update(state=CANCELLED, reason="cancelled before it ran", bytes_scanned=0, elapsed_ms=0)
            self._record(entry)
            self.open.pop(run, None)
        while not future.done():
            self.spark.sparkContext.cancelJobsWithTag(run)
            wait([future], timeout=0.2)
        return True

    def wait(self, run: str) -> None:
        found = self.open.get(run)
        if found:
            wait([found[0]])

    def result_path(self, run: str) -> str:
        return f"{self.base}/results/{run}"

    def state(self, run: str, org: str) -> str | None:
        """The state of one of the org's runs; reads its entry without a job, so it does
        not wait for a run that holds all cores."""
        for day in reversed(self._days(org)):
            if f"{run}.json" in child_names(self.spark, day):
                return json.loads(get_text(self.spark, f"{day}/{run}.json"))["state"]
        return None

    def result(self, run: str, org: str) -> DataFrame:
        state = self.state(run, org)
        if state != SUCCEEDED:
            raise ValueError(f"no results: the query is {state or 'not known'}")
        return self.spark.read.parquet(self.result_path(run))

    def _days(self, org: str) -> list[str]:
        names = child_names(self.spark, f"{self.base}/history/org={org}")
        first = _day(int((self.clock() - HISTORY_DAYS * 86400) * 1000))
        return [f"{self.base}/history/org={org}/{n}" for n in sorted(names) if n.startswith("day=") and n >= f"day={first}"]

    def log(self, org: str) -> DataFrame:
        """The entries of an org's live days."""
        days = self._days(org)
        if not days:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(days)

    def history(self, org: str, n: int = HISTORY_PAGE) -> DataFrame:
        """The org's own live entries, latest first."""
        return history(self.log(org), org, F.lit(int(self.clock())), n)

    def expire(self, org: str) -> int:
        """Delete the days of an org's history that have ended their life."""
        first = _day(int((self.clock() - HISTORY_DAYS * 86400) * 1000))
        old = [n for n in child_names(self.spark, f"{self.base}/history/org={org}") if n.startswith("day=") and n < f"day={first}"]
        for name in old:
            delete_path(self.spark, f"{self.base}/history/org={org}/{name}")
        return len(old)
