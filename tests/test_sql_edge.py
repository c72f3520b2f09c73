import pytest
from pyspark.sql import functions as F

from millrace.functions import format as fmt
from millrace.functions.sqlgate import FORBIDDEN, NotReadOnly, check_read_only, gate
from millrace.session import child_names
from millrace.plans.sql import database_schema, history, page, run_sql, table_name

REFUSED = [f"{w} x" for w in FORBIDDEN] + ["select 1;\ndrop table x", "drop table x", "  Insert into t values (1)", "", "  "]
ALLOWED = ["SELECT inserted FROM t", "SELECT 'drop' AS w", "SELECT 1 -- update later", "SELECT 1 /* delete\nthis */",
           'SELECT "it\'s; drop" AS w', "SELECT 'a''drop' AS w", "SELECT updated_at, creates FROM t"]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(sql):
    with pytest.raises(NotReadOnly):
        check_read_only(sql)


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(sql):
    assert check_read_only(sql) == sql


def test_gate_column_agrees(spark):
    rows = [(s, False) for s in REFUSED] + [(s, True) for s in ALLOWED]
    df = spark.createDataFrame(rows, "sql string, ok boolean").withColumn("g", gate(F.col("sql")) == "ok")
    assert df.where("g <> ok").count() == 0


def test_run_sql_scope(spark):
    tables = {"stream_a": lambda s: s.range(3).toDF("n")}
    assert run_sql(spark, tables, "SELECT sum(n) AS s FROM stream_a").first().s == 3
    spark.range(1).createOrReplaceTempView("stream_other_org")
    for sql in ("SELECT * FROM stream_other_org", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`"):
        with pytest.raises(Exception):
            run_sql(spark, tables, sql).collect()
    for sql in ("SET spark.sql.shuffle.partitions = 1", "CACHE TABLE stream_a", "USE x"):
        with pytest.raises(NotReadOnly):
            run_sql(spark, tables, sql)
    with pytest.raises(LookupError):
        run_sql(spark, {}, "SELECT 1")


def test_catalog(spark):
    tables = {table_name("events"): lambda s: s.createDataFrame([], "timestamp bigint, event_type string, user_id string")}
    got = [(r.table, r.column, r.type) for r in database_schema(spark, tables).orderBy("position").collect()]
    assert got == [("stream_events", "timestamp", "bigint"), ("stream_events", "event_type", "string"), ("stream_events", "user_id", "string")]
    assert table_name("my-topic") == "stream_my_topic"
    with pytest.raises(LookupError):
        database_schema(spark, {})


def test_pages_cover_everything(spark):
    df = spark.range(25).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    seen, after = [], None
    while True:
        rows = page(df, ["a", "b"], after, n=10).collect()
        if not rows:
            break
        seen += [(r.a, r.b) for r in rows]
        after = [int(rows[-1].a), int(rows[-1].b)]
    assert seen == sorted(((str(i % 3), str(i)) for i in range(25)), key=lambda x: (int(x[0]), int(x[1])))
    with pytest.raises(ValueError):
        page(df, ["b"], state="RUNNING")
    for n in (0, 1001):
        with pytest.raises(ValueError):
            page(df, ["b"], n=n)


def test_history(spark):
    ddl = "org string, query_id string, submitted_ms long"
    log = spark.createDataFrame([("o", "a", 1000), ("o", "b", 2000), ("p", "c", 3000), ("o", "d", 1)], ddl)
    now = 7 * 86400 + 1
    assert [r.query_id for r in history(log, "o", F.lit(now)).collect()] == ["b", "a"]
    assert history(log.where("org = 'x'"), "x", F.lit(0)).count() == 0


def test_csv_and_json(spark):
    df = spark.createDataFrame([("1,5;2", 1), ('the "big" one', 2), ("up\ndown", 3), (None, 4), ("", 5)], "c string, n int")
    lines = [r.line for r in fmt.to_csv_lines(df).collect()]
    assert lines == ['"1,5;2",1', '"the ""big"" one",2', '"up\ndown",3', ",4", ",5"]
    assert fmt.csv_header(["a", "b,c"]) == 'a,"b,c"'
    assert [r.line for r in fmt.to_json_lines(df.where("n = 4")).collect()] == ['{"c":null,"n":"4"}']
    assert fmt.to_json_lines(df.limit(0)).count() == 0


def test_formats(spark):
    df = spark.createDataFrame([(None,), (0,), (999,), (1000,), (1023,), (1024,), (59_999,), (60_000,), (5 * 1024 ** 4,)], "n long")
    got = df.select(fmt.fmt_bytes(F.col("n")).alias("b"), fmt.fmt_duration(F.col("n")).alias("d")).collect()
    assert [r.b for r in got][:6] == ["0 B", "0 B", "999.00 B", "1000.00 B", "1023.00 B", "1.00 KB"] and got[-1].b == "5.00 TB"
    assert [r.d for r in got][:5] == ["0ms", "0ms", "999ms", "1.0s", "1.0s"] and got[7].d == "1.0m"
    t = spark.createDataFrame([("abcdefgh",), ("abc",), (None,)], "t string")
    assert [r[0] for r in t.select(fmt.fmt_truncate(F.col("t"), 5)).collect()] == ["ab...", "abc", ""]
    assert t.select(fmt.fmt_truncate(F.col("t"), 5, total=False)).first()[0] == "abcde..."


def test_parsed_plan_is_checked(spark, scratch):
    tables = {"stream_a": lambda s: s.range(3).toDF("n")}
    spark.range(2).write.mode("overwrite").saveAsTable("foreign_table")
    target = scratch("stolen")
    refused = [
        rf"WITH x AS (SELECT r'\' AS a) INSERT OVERWRITE DIRECTORY '{target}' USING parquet SELECT 1",
        "SELECT * FROM foreign_table", "SELECT * FROM default.foreign_table",
        "SELECT n FROM stream_a WHERE n IN (SELECT id FROM foreign_table)",
        "WITH y AS (SELECT * FROM foreign_table) SELECT * FROM y",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT n FROM stream_a ORDER BY java_method('java.lang.Math', 'random')",
        "SELECT * FROM IDENTIFIER('foreign_table')", "SELECT * FROM parquet.`/tmp`",
    ]
    for sql in refused:
        with pytest.raises(NotReadOnly):
            run_sql(spark, tables, sql)
    assert not child_names(spark, target)
    fine = "WITH y AS (SELECT n FROM stream_a) SELECT (SELECT max(n) FROM y) + count(*) AS s FROM y, range(2)"
    assert run_sql(spark, tables, fine).first().s == 8


def test_gate_knows_raw_literals(spark):
    log = spark.createDataFrame([(r"SELECT r'\' AS a, 'drop' AS b",), (r"SELECT r'\'; DROP TABLE t",)], "sql string")
    assert [r[0] for r in log.select(gate(F.col("sql"))).collect()] == ["ok", "forbidden"]
