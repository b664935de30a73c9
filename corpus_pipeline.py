"""From raw documents to packed sequences: quality rules, near duplicates, personal data, mixing, packing.

Every stage but the last returns the columns that it is given, whatever else they are named. An empty table
passes through as one. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import mixing, near_duplicates, packing, personal_data, quality_rules
from veritab.llm.common import documents, few_or_many, new_path, stored


#: Token shares asked of the mix. The quality rules have taken out nearly all junk before: its share is what they leave.
TARGETS = {"clean": 0.985, "toxic": 0.01, "junk": 0.005}


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id has no verdict to keep; repeated rows share their doc_id's verdict, null ids too.

    Only what goes is looked up: while it is few, texts aren't moved.
    """
    gone = verdicts.groupBy("doc_id").agg(F.bool_or("kept").alias("_kept")).where("not _kept").select(F.col("doc_id").alias("_id"))
    gone = few_or_many(stored(gone, "gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject. A null or empty text has too few words and goes; repeated rows are judged alike."""
    return quality_rules.kept_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id. Null and blank texts, which are like nothing,
    and rows without doc_id stay; repeated rows of a kept doc_id all stay, as they are one document.
    """
    return _kept(docs, near_duplicates.near_duplicates(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind. Null texts stay null; repeated rows are rewritten alike."""
    return personal_data.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so none of some and several of others; ties of rates are settled by a hash of doc_id,
    so repeated rows of one doc_id are taken alike. Null texts have no tokens and are taken at their rate. TARGETS are met as they
    stand; where they can't be, the nearest mix is taken and a warning says what is missed. An empty table gives one.
    """
    return mixing.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. A null or empty text is the end mark alone; repeated rows are packed one by one."""
    return packing.packed(docs)


STAGES = [("quality rules", quality), ("near duplicates", deduplicate), ("personal data", redact), ("mixing", mix), ("packing", pack)]

#: Near duplicates, expectation-maximisation and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
