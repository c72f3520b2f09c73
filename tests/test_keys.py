from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.functions.keys import merge_key, split_key
from millrace.functions.lakekey import parse_lake_key


def roundtrip(spark, lists):
    df = spark.createDataFrame([(x,) for x in lists], "p array<string>")
    df = df.select("p", merge_key(F.col("p")).alias("k"))
    return df.select("p", "k", split_key(F.col("k")).alias("s")).collect()


def test_merge_literals(spark):
    rows = roundtrip(spark, [["a:b", "c\\d", "e"], ["a", "", ""], []])
    assert [r.k for r in rows] == ["a\\:b:c\\\\d:e", "a::", None]
    assert rows[0].s == ["a:b", "c\\d", "e"] and rows[1].s == ["a", "", ""] and rows[2].s is None


def test_stray_escape(spark):
    df = spark.createDataFrame([("a\\x:b",)], "k string")
    assert df.select(split_key(F.col("k")).alias("s")).first().s == ["ax", "b"]


part = st.text(alphabet=st.sampled_from(list("ab:\\\n é\x01\x02")), max_size=6)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(part, min_size=1, max_size=4), min_size=1, max_size=40))
def test_split_inverts_merge(spark, lists):
    for r in roundtrip(spark, lists):
        assert r.s == r.p


def test_lake_key(spark):
    df = spark.createDataFrame(
        [("retention=YEAR/organization=o/topic=t/year=2025/month=01/day=02/hour=03/f.gz",), ("x/y",)],
        "k string")
    rows = [r.p for r in df.select(parse_lake_key(F.col("k")).alias("p")).collect()]
    assert tuple(rows[0]) == ("YEAR", "o", "t", "2025", "01", "02", "03", "f.gz")
    assert rows[1].filename == "x/y" and rows[1].topic is None
