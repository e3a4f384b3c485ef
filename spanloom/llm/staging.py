"""Tables written between jobs, in the folder that the cluster shares (``sources.shared``).

A staged table cuts lineage the way ``checkpoint()`` does, survives lost executors
and is columnar.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.shared import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanloom-{name}-{uuid.uuid4().hex[:12]}"


#: Tables that stand, since lazy results may still read them, until the driver ends.
_standing: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def clear() -> None:
    """Delete all tables that this process has staged; their readers must have finished."""
    for path, spark in list(_standing.items()):
        with contextlib.suppress(Exception):  # the session may be gone, with what it could delete
            _remove(spark, path)
        _standing.pop(path, None)


#: Spark removes an execution's shuffle files as it ends, rather than when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if held is None else spark.conf.set(_CLEANUP, held)


def stage(df: DataFrame, name: str, path: str | None = None, cleanup: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it read back; with ``cleanup`` its shuffle files are gone then."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    _standing[path] = spark
    with _cleaned_up(spark) if cleanup else contextlib.nullcontext():
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_place(table: DataFrame) -> Column:
    meta = table.metadataColumn("_metadata")
    part = F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1).try_cast("long")  # names are ordered as text up to 99999 only
    return F.struct(F.coalesce(part, F.lit(-1).cast("long")).alias("part"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def written_order(table: DataFrame) -> tuple[DataFrame, Column]:
    """The table and each row's place (part, file, row) in the Parquet files it is read from, in the order they were written.

    A table that is not read from such files is written first, its partitions in their order.
    """
    try:
        place = _file_place(table)
        table.select(place)
    except AnalysisException:
        table = stage(table, "ordered")
        place = _file_place(table)
    return table, place


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables whose readers have all finished, and let go of the shuffle files of finished jobs.

    Spark deletes those files only once the driver has collected the plans that made them.
    """
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            _remove(spark, folder)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
