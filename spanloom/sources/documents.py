"""Document sources: any table, text files or binary files as (doc_id, text), with safe ids and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def from_table(spark: SparkSession, path: str, form: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(form).options(**options).load(path)


def from_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file; the id is the path."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("doc_id"), decode_utf8(F.col("content")).alias("text"))


def decode_utf8(raw: Column, strict: bool = True) -> Column:
    """UTF-8 bytes as a string: invalid bytes are an error, or null where not ``strict``."""
    as_text = raw.cast("string")
    return F.validate_utf8(as_text) if strict else F.try_validate_utf8(as_text)


def with_ids(docs: DataFrame, order: str, id_column: str = "doc_id") -> DataFrame:
    """Blank ids become doc-N by place in ``order`` among the blank ones; a repeated id gets #2, #3, ... in that order.

    Null counts as blank; ties in ``order`` are numbered either way.  Places come from range
    partitions: each numbers its own rows, and only the partitions' counts meet in one task.
    """
    given = F.trim(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    rows = docs.withColumn("__id", given)
    named = rows.where("__id <> ''").unionByName(_numbered(rows.where("__id = ''"), order))
    n = F.row_number().over(Window.partitionBy("__id").orderBy(order))
    final = F.when(n == 1, F.col("__id")).otherwise(F.concat("__id", F.lit("#"), n.cast("string")))
    return named.withColumn(id_column, final).drop("__id")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """``__id`` doc-1, doc-2, ... by ``order``: the place in its range plus the rows of the ranges before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    placed = ranged.withColumn("__place", inside)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), F.min(order).alias("__first"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    joined = placed.join(F.broadcast(offsets), "__part")
    return joined.withColumn("__id", F.concat(F.lit("doc-"), (F.col("__before") + F.col("__place")).cast("string"))).drop("__part", "__place", "__before")


def spread(docs: DataFrame, least_bytes: int = 64 << 20) -> DataFrame:
    """Rows dealt to all cores where the table is small: then it may be one row group, which one task would read.

    Tables over ``least_bytes`` (as the plan estimates them) for each core stay as they are read.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(cores) if size < cores * least_bytes else docs
