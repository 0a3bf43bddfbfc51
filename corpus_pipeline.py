"""A training corpus from documents: each stage reads what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomrec.llm import decontaminate, jaccard, language, mixing, sharding
from bomrec.llm.common import document_table, fresh, shared_dir


CLEAR_FROM = 200


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a key of their id and their text, so that rows with one id and two texts stay apart."""
    (key,) = fresh(docs, "row_key")
    return docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))), key


def matching(docs: DataFrame, key: str, found: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the key; null ids match each other."""
    found = found.select(F.col(f"{found.columns[0]}.id").alias("found_id"), F.col(f"{found.columns[0]}.text").alias("found_text"))
    return docs.join(found, docs[key]["id"].eqNullSafe(found["found_id"]) & (docs[key]["text"] == found["found_text"]), how)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; learned from those that state one.

    Rejected are texts without a letter, and texts of ``CLEAR_FROM`` characters or more between two
    languages. Shorter ones have too few n-grams to be held against them and stay.
    """
    told = language.identify(docs, docs.select("text", "lang"))
    unclear = F.col("ambiguous") & (F.length("text") >= CLEAR_FROM)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & ~unclear).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of 0.75 similarity lead between, the one with the smallest id.

    Documents without a word are linked with nothing and stay. Of rows that repeat an id and a text one stays.
    """
    rows, key = keyed(docs)
    found = jaccard.jaccard_components(rows, id_col=key)
    first = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    once = Window.partitionBy(f"{key}.id", f"{key}.text").orderBy(F.lit(1))
    (nth,) = fresh(rows, "nth")
    return matching(rows, key, first, "left_semi").withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows, key = keyed(docs)
    found = decontaminate.decontaminate(rows, document_table(spark, sf_dir, "benchmark"), id_col=key)
    return matching(rows, key, found.where("contaminated").select(key).distinct(), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them; those it takes no copy of go."""
    taken = mixing.entropy_mix(docs)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return taken.where("copies > 0").withColumn("copies", times).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return sharding.interleaved_shards(docs, shards=24)


STAGES = [
    ("language_id", known_languages),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", uncontaminated),
    ("mixing_to_weights", mixed),
    ("sharding", shards),
]

#: SQL can express neither the trained model nor the iterative balance.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = document_table(spark, sf_dir)
    base = f"{shared_dir(spark)}/bomrec-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
