"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fxlake.session import ship_package

#: Rows in one Arrow batch to Python. Texts are long, so the default of 10,000 would hold too much at once.
BATCH_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local master, whose executors
    are the driver, gets a temporary folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    The files outlive any executor, so a later stage never goes back past this point. `release` deletes them.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete materialised tables whose last reader has been written, and let Spark drop the shuffle files of finished
    jobs: it does so when the driver's plans of them are collected."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables and shuffles:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, and not at its next cleaning."""
    gc.collect()
    spark._jvm.System.gc()


def small_enough(df: DataFrame, bytes_a_row: F.Column, limit: int) -> bool:
    """Whether df, measured, may be broadcast."""
    return (df.agg(F.sum(bytes_a_row)).first()[0] or 0) <= limit


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold, and let the workers import this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) <= 0 or int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
