"""Read-only SQL over an org's lake tables, result pages and query history."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.format import as_text
from ..functions.sqlgate import NotReadOnly, check_plan, check_read_only
from ..schemas import small_df
from ..session import prepare
from ..sources.lake import read_lake

Loader = Callable[[SparkSession], DataFrame]

# fixed values: page sizes and the life of a history entry
RESULT_PAGE, RESULT_PAGE_MAX = 100, 1000
HISTORY_PAGE, HISTORY_PAGE_MAX = 50, 100
HISTORY_DAYS = 7

_READS = re.compile(r"(?is)^[\s(]*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(select|with|values|table|from|show|describe|desc|explain)\b")


def table_name(topic: str) -> str:
    return "stream_" + re.sub(r"[^A-Za-z0-9_]", "_", topic)


def lake_tables(path: str, org: str, schemas: dict[str, str]) -> dict[str, Loader]:
    """Tables of one org: a view per topic, reading that topic's folders only."""
    return {
        table_name(topic): (lambda s, t=topic, d=ddl: read_lake(s, path, d, org=org, topic=t))
        for topic, ddl in schemas.items()
    }


def org_session(spark: SparkSession, tables: dict[str, Loader]) -> SparkSession:
    """A session in which only the given tables exist, and no files by path."""
    session = prepare(spark.newSession())
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, load in tables.items():
        load(session).createOrReplaceTempView(name)
    return session


def run_sql(spark: SparkSession, tables: dict[str, Loader], sql: str) -> DataFrame:
    """Check the text, by its words and as parsed, and hand it to Spark in the org's own
    session. Only the org's tables can be named; nothing outside SQL can be called."""
    check_read_only(sql)
    if not _READS.match(sql):
        raise NotReadOnly("only queries are allowed")
    if not tables:
        raise LookupError("database not found: the org has no tables")
    check_plan(spark, sql, tables)
    # a table the text does not name cannot be read by it: no need to open it
    named = {n: load for n, load in tables.items() if re.search(rf"(?i)\b{re.escape(n)}\b", sql)}
    return org_session(spark, named).sql(sql)


def database_schema(spark: SparkSession, tables: dict[str, Loader]) -> DataFrame:
    """Tables and their columns; an org without tables is not found."""
    if not tables:
        raise LookupError("database not found: the org has no tables")
    rows = [dict(table=name, position=i, column=f.name, type=f.dataType.simpleString())
            for name, load in sorted(tables.items())
            for i, f in enumerate(load(spark).schema.fields)]
    return small_df(spark, rows, "table string, position int, column string, type string")


def page(df: DataFrame, order_cols: list[str], after: list | None = None, n: int = RESULT_PAGE,
         state: str = "SUCCEEDED") -> DataFrame:
    """One page of a result as text cells. ``order_cols`` must be a total order;
    pass the last row's values as ``after``. Finding a page is a top-n, so no
    earlier page is sorted or moved again. A size outside 1 to ``RESULT_PAGE_MAX``
    is refused."""
    if not 1 <= n <= RESULT_PAGE_MAX:
        raise ValueError(f"a page has 1 to {RESULT_PAGE_MAX} rows, not {n}")
    if state != "SUCCEEDED":
        raise ValueError(f"no results: the query is {state}")
    if after is not None:
        df = df.where(_beyond(order_cols, after))
    return as_text(df.orderBy(*order_cols).limit(n))


def _beyond(cols: list[str], after: list) -> Column:
    """``cols > after`` in column order; the leading comparison stays a plain
    predicate so that it reaches the scan."""
    cond = F.col(cols[-1]) > F.lit(after[-1])
    for c, v in zip(reversed(cols[:-1]), reversed(after[:-1])):
        cond = (F.col(c) > F.lit(v)) | ((F.col(c) == F.lit(v)) & cond)
    return (F.col(cols[0]) >= F.lit(after[0])) & cond


def with_history_ttl(log: DataFrame) -> DataFrame:
    return log.withColumn("ttl", F.floor(F.col("submitted_ms") / 1000) + HISTORY_DAYS * 86400)


def history(log: DataFrame, org: str, now: Column, n: int = HISTORY_PAGE) -> DataFrame:
    """The org's own live entries, latest first."""
    return (with_history_ttl(log).where((F.col("org") == org) & (F.col("ttl") >= now))
            .orderBy(F.col("submitted_ms").desc(), F.col("query_id").desc())
            .limit(max(1, min(n, HISTORY_PAGE_MAX))))
