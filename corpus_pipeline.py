"""From raw documents to packed sequences: quality rules, toxicity, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard, packing, quality, toxicity
from millrace.llm.common import settle, table
from millrace.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a risk-controlled cutoff rejects go."""
    return quality.quality(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely toxic than not go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not toxic").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays."""
    return jaccard.one_of_each(docs, width=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the packed sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("toxicity", clean), ("near_copies", near_copies), ("packing", pack)]

# The toxicity model is trained, so the rows of the whole run have no SQL; the tests
# compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
