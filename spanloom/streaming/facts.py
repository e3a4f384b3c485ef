"""Additive facts over streams of documents: exact under complete mode, one document a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.tokens import tokens
from spanloom.sources.shared import shared_dir


def word_counts(stream: DataFrame, keep: str = "word-like") -> DataFrame:
    """Running (token, count) of a stream of texts."""
    return tokens(stream.select("text"), keep).groupBy(F.col("raw").alias("token")).agg(F.count(F.lit(1)).alias("count"))


def drain(spark: SparkSession, counts: DataFrame, name: str) -> DataFrame:
    """Run an aggregated stream over what its source holds now and return the final table."""
    path = f"{shared_dir(spark)}/stream-{name}"

    def keep_last(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/log").foreachBatch(keep_last).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/result")


def variant_counts(stream: DataFrame, keep: str = "word-like") -> DataFrame:
    """Running (key, form, count) of a stream of texts: what a variant index is made of."""
    from spanloom.operators.tokens import case_fold

    return tokens(stream.select("text"), keep).groupBy(case_fold(F.col("raw")).alias("key"), F.col("raw").alias("form")).agg(F.count(F.lit(1)).alias("count"))
