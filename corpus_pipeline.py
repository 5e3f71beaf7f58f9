"""The corpus pipeline: documents from raw to sharded, stage by stage.

Each stage works on everything its predecessor kept, is written as Parquet and
read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import columns, decontamination, mixing, near_duplicates, quality, sharding
from driftmark.plans.scratch import clear, mark, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs."""
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return columns.without_rows(docs, judged.where("not kept"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: its first copy by doc_id."""
    rows = near_duplicates.groups(docs).groupBy("doc_id", "text_hash").agg(F.bool_or("first_copy").alias("stays"), F.count("*").alias("n"))
    rows = materialise(rows, "copies")
    repeated = rows.where("stays and n > 1")
    kept = columns.without_rows(docs, rows.where("not stays or n > 1"))
    if repeated.isEmpty():
        return kept
    some = columns.few(repeated.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    once = docs.join(some, docs["doc_id"].eqNullSafe(some["_id"]) & (F.xxhash64(docs["text"]) == some["_hash"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(once)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    found = decontamination.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return columns.without_rows(docs, materialise(found.where("n_hit > 0").select("doc_id", "text_hash"), "contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row, and its place there."""
    return sharding.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Near-duplicate components and the dealing of slots are loops that SQL cannot express; tests/llm checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Once a stage is written, what earlier stages wrote is deleted; the tables
    and the slot map of the last one stay.
    """
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES:
        begun = mark()
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear(spark, since, begun)
    return docs
