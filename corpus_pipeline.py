"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

toxicity -> near duplicates -> benchmark decontamination -> mixing -> sharding.  All stages but
the last return the columns of documents; rows that a stage rejects are gone for the next one.
The order in which mixing writes the rows is their order in each shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, minhash, mixing, sharding, staging, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not call toxic.

    Null and empty texts show no evidence and stay, as does every row where labels of both classes
    are missing; equal texts fare alike; an empty table stays empty; all columns are kept as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.ordinary_documents(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class; of rows equal in id and text, one.

    Rows are told apart by a 64-bit hash of id and text, so different texts under one id stay.
    Rows without an id are not compared and stay; texts without words are copies of each other; a
    tie between equal ids goes to the lesser hash; an empty table stays empty; all columns are kept.
    """
    keyed = docs.where("doc_id is not null").withColumn("__dup_row", F.xxhash64("doc_id", "text"))
    classes = minhash.near_duplicates(keyed, doc_id="__dup_row").select(F.col("doc_id").alias("__dup_row"), "class_id")
    ids = keyed.select("__dup_row", "doc_id").distinct()
    heads = classes.distinct().join(ids, "__dup_row").groupBy("class_id").agg(F.min(F.struct("doc_id", "__dup_row")).alias("least")).select("least.__dup_row")
    named = keyed.join(heads.hint("shuffle_hash"), "__dup_row", "left_semi").dropDuplicates(["__dup_row"])
    return named.drop("__dup_row").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, however short beside the rest of the text.

    Null and empty texts stay, as do all where the benchmark is empty; equal texts fare alike; an
    empty table stays empty; all columns are kept as they are.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixture order: files and their rows follow the schedule, and so does each shard made of them.

    Nothing is dropped: null sources are a source, null and empty texts count one byte, repeated
    rows are rows; an empty table stays empty; columns named like the mixture's own are kept.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = {c: f"held {i}" for i, c in enumerate(docs.columns) if c.startswith(("mix_", "__mix_"))}
    ordered = mixing.mix_in_order(docs.withColumnsRenamed(taken), n)
    return ordered.select(*[F.col(taken.get(c, c)).alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every document; see ``sharding.shard_documents`` for nulls, repeats, long texts and empty tables.

    Places follow the order of the files, so reading a shard from 0 on is reading the mixture.
    """
    return sharding.shard_documents(docs, ordered=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None  # a trained classifier and connected components have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
