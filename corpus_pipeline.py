"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailcorpus.llm import decontaminate, minhash, mixing, pii, toxicity

#: Stages give back exactly these columns of ``documents``.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rejected = toxicity.toxicity(_named(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out).where("predicted = 1").select("doc_id").distinct()
    return _without(docs, rejected)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, and one row of each repeated document."""
    gone = minhash.near_duplicates(_named(docs)).where("NOT kept").select("doc_id").distinct()
    return _without(docs, gone).dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contaminated(_named(docs), benchmark).select("doc_id").distinct())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights, with their weight and probability; a row for each copy."""
    keyed = docs.select(*COLUMNS).withColumn("key", F.xxhash64("doc_id", "text"))
    chosen = mixing.mixture(keyed.withColumn("doc_id", F.col("key"))).where("kept").select(F.col("doc_id").alias("key"), "tokens", "topic", "weight", "probability", "copies").dropDuplicates(["key"])
    return keyed.join(chosen, "key").drop("key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def _name() -> Column:
    """doc_id, or where it is null a hash of the text, larger than any id in use."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", _name())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    gone = gone.withColumnRenamed("doc_id", "name")
    return docs.select(*COLUMNS).withColumn("name", _name()).join(gone, "name", "left_anti").drop("name")


STAGES = [
    ("toxicity", toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("mixing", target_mix),
]
#: Trained classifiers, sketches and sampling have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    from mailcorpus.llm._stage import stage as written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
