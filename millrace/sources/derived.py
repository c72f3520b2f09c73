"""Platform-shaped inputs that Spark derives from the given tables.

Nothing here is sampled: every row of the named table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import MAX_BODY_BYTES, store_def, topic_row, topics_df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with ``ts`` as an instant (session time zone UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def messages_from(ev: DataFrame) -> DataFrame:
    """Messages with missing keys and ids, every content type, bad and oversized
    bodies, a copy 60 s later (inside the dedup interval) and one 600 s later."""
    eid = F.col("event_id")
    delays = F.concat(
        F.array(F.lit(0)),
        F.when(eid % 10 == 0, F.array(F.lit(60))).otherwise(F.array().cast("array<int>")),
        F.when(eid % 25 == 0, F.array(F.lit(600))).otherwise(F.array().cast("array<int>")),
    )
    json_body = F.concat(
        F.lit('{"event_id":'), eid.cast("string"), F.lit(',"event_type":"'), F.col("event_type"),
        F.lit('","user_id":'), F.col("user_id").cast("string"), F.lit(',"value":'),
        F.col("value").cast("decimal(18,2)").cast("string"), F.lit(',"props":'), F.col("props"),
        F.lit("}"),
    )
    body = (
        F.when(eid % 50 == 49, F.lit("{bad"))
        .when(eid % 500 == 5, F.repeat(F.lit("x"), MAX_BODY_BYTES + 1))
        .when(eid % 500 == 6, F.repeat(F.lit("x"), MAX_BODY_BYTES))
        .otherwise(json_body)
    )
    content_type = (
        F.when(eid % 20 == 0, F.lit(None).cast("string"))
        .when(eid % 20 == 1, F.lit("text/plain"))
        .when(eid % 20 == 2, F.lit("application/avro"))
        .when(eid % 20 == 3, F.lit("image/png"))
        .otherwise(F.lit("application/json"))
    )
    key = F.when(eid % 200 == 199, F.lit("")).otherwise(F.col("user_id").cast("string"))
    message_id = F.when(eid % 7 != 0, F.concat(F.lit("m"), eid.cast("string")))
    return ev.withColumn("delay", F.explode(delays)).select(
        eid.alias("seq"),
        F.concat(F.lit("org"), (F.col("user_id") % 3).cast("string")).alias("org"),
        F.col("event_type").alias("topic"),
        key.alias("message_key"),
        message_id.alias("message_id"),
        content_type.alias("content_type"),
        body.cast("binary").alias("body"),
        (F.col("ts") + F.make_interval(secs=F.col("delay"))).alias("received_at"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than cores over all of them; a table with
    enough splits is left alone and costs no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(spread(events(spark, sf_dir)))


def topics(spark: SparkSession) -> DataFrame:
    """The topic configuration that goes with :func:`messages`."""
    return topics_df(spark, [
        topic_row("org0", "click", has_batch=True, retention="YEAR", streams=["s_click", "s_all"]),
        topic_row("org0", "purchase", has_batch=True, retention="THREE_YEARS", streams=["s_all"],
                  store=store_def(["user_id"], ["event_id"], "p", 1000, blacklist=["props"])),
        topic_row("org0", "error", streams=["s_err"]),
        topic_row("org0", None, allow_undefined=True, has_batch=True, retention="WEEK"),
        topic_row("org1", "view", has_batch=True, retention="DAY", streams=["s_view"],
                  store=store_def(["user_id"], [], "last", 60, whitelist=["user_id", "value"])),
        topic_row("org1", None, allow_undefined=False),
    ])


def state_ops_from(ev: DataFrame) -> DataFrame:
    """Keyed-state operations: one register, two counters, one set per user."""
    eid, kind = F.col("event_id"), F.col("event_type")
    even = eid % 2 == 0
    bucket = (eid % 5).cast("string")
    attr = (F.when(kind == "signup", "last_type").when(kind == "click", "clicks")
            .when(kind == "purchase", "spend").when(kind == "view", "seen")
            .when(even, "clicks").otherwise("seen"))
    op = (F.when(kind == "signup", "set_string").when(kind.isin("click", "purchase"), "add_number")
          .when(kind == "view", "add_to_set").when(even, "delete").otherwise("remove_from_set"))
    value = (F.when(kind == "signup", kind).when(kind == "click", "1")
             .when(kind == "purchase", F.col("value").cast("decimal(18,2)").cast("string"))
             .when(kind == "view", bucket).when(even, F.lit(None)).otherwise(bucket))
    return ev.select(
        F.array(F.lit("task"), F.lit("t"), F.lit("key"), F.col("user_id").cast("string")).alias("key_parts"),
        eid.alias("seq"), F.col("ts").alias("at"),
        attr.alias("attr"), op.alias("op"), value.cast("string").alias("value"),
    )


def state_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_ops_from(events(spark, sf_dir))


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log from the page addresses: path, parameters, headers, cookies."""
    url = F.col("url")
    no_fragment = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(no_fragment, r"\?(.*)$", 1)
    mod = F.col("page_id") % 4
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, "get").when(F.col("page_id") % 3 == 1, "GET")
        .otherwise("POST").alias("method"),
        F.regexp_extract(no_fragment, r"^https?://[^/]+(/[^?]*)", 1).alias("raw_path"),
        F.when(query != "", F.str_to_map(query, F.lit("&"), F.lit("=")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("query"),
        F.when(mod == 0, F.create_map(F.lit("AUTHORIZATION"), F.concat(F.lit("t"), F.col("page_id").cast("string")),
                                      F.lit("Content-Type"), F.lit("application/json")))
        .otherwise(F.create_map(F.lit("content-type"), F.lit("text/html"))).alias("headers"),
        F.when(mod < 2, F.array(F.lit("session=a"), F.lit("SESSION=b"), F.lit("flag")))
        .otherwise(F.array().cast("array<string>")).alias("cookies"),
    )


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint definitions from the page addresses, so that they grow with the pages: paths
    of two parts of which one or both are fixed, and one that takes what is left."""
    address = F.regexp_replace("url", "#.*$", "")
    lang, last = (F.regexp_extract(address, r"^https?://[^/]+/([^/?]*)/([^/?]*)/*(\?|$)", i) for i in (1, 2))
    pages, kind, flags = table(spark, sf_dir, "pages"), F.col("page_id") % 5, "map<string,boolean>"
    none = F.create_map().cast(flags)
    json = F.array(F.lit("application/json"))
    some = pages.where((last != "") & (kind < 3)).select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), F.col("page_id").alias("position"),
        F.when(kind == 2, "post").otherwise("GET").alias("method"),
        F.when(kind == 0, F.concat(F.lit("/{lang}/"), last)).when(kind == 1, F.concat(F.lit("/"), lang, F.lit("/"), last))
        .otherwise(F.concat(F.lit("/"), lang, F.lit("/{id}"))).alias("path"),
        F.when(kind < 2, F.create_map(F.lit("page"), kind == 1)).otherwise(none).alias("query"),
        F.when(kind == 2, F.create_map(F.lit("Authorization"), F.lit(True))).otherwise(none).alias("headers"),
        none.alias("cookies"), F.when(kind == 2, json).otherwise(F.array().cast("array<string>")).alias("content_types"))
    rest = pages.agg((F.max("page_id") + 1).alias("position")).select(
        F.lit("rest").alias("name"), "position", F.lit("GET").alias("method"), F.lit("/{lang}/{id}").alias("path"),
        none.alias("query"), none.alias("headers"), F.create_map(F.lit("Session"), F.lit(True)).alias("cookies"),
        F.array().cast("array<string>").alias("content_types"))
    return some.unionByName(rest)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of submitted SQL texts, one per event."""
    eid, kind = F.col("event_id"), F.col("event_type")
    n = eid.cast("string")
    sql = (
        F.when(eid % 11 == 0, F.lit(""))
        .when(eid % 11 == 1, F.concat(F.lit("drop table stream_"), kind))
        .when(eid % 11 == 2, F.concat(F.lit("SELECT inserted FROM stream_"), kind))
        .when(eid % 11 == 3, F.concat(F.lit("SELECT 1;\nDELETE FROM stream_"), kind))
        .when(eid % 11 == 4, F.concat(F.lit("SELECT 'drop' AS w, "), n, F.lit(" AS n -- update later")))
        .when(eid % 11 == 5, F.concat(F.lit("Merge INTO t USING s ON t.id = "), n))
        .otherwise(F.concat(F.lit("SELECT * FROM stream_"), kind, F.lit(" WHERE event_id = "), n))
    )
    state = (F.when(kind == "error", "FAILED").when(kind == "signup", "CANCELLED")
             .when(kind == "view", "RUNNING").otherwise("SUCCEEDED"))
    return events(spark, sf_dir).select(
        F.concat(F.lit("org"), (F.col("user_id") % 3).cast("string")).alias("org"),
        F.concat(F.lit("q"), n).alias("query_id"),
        F.unix_millis("ts").alias("submitted_ms"),
        sql.alias("sql"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        state.alias("state"),
        (F.floor(F.col("value") * 100).cast("long") * eid).alias("bytes_scanned"),
        (eid * 37 % 200000).alias("elapsed_ms"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task graph: an order is a task of its customer's org; it reads one queue
    and writes one or two, chosen by its price, date and priority."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    q = lambda c: F.concat(F.lit("q"), c.cast("string"))
    day = F.dayofmonth("o_orderdate")
    return o.select(
        F.concat(F.lit("org"), F.col("o_custkey").cast("string")).alias("org"),
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("task"),
        F.array(q(cents % 12)).alias("inputs"),
        F.when(F.col("o_orderstatus") == "F", F.array(q(day % 12), q(F.month("o_orderdate") % 12)))
        .otherwise(F.array(q(day % 12))).alias("outputs"),
    )
