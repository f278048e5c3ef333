"""Shared storage, table access and crash-safe materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (tests on one machine) a temporary folder of this machine is taken.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder for one run of one operator."""
    return f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a table to shared storage and read it back; this cuts the lineage."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in smaller batches than Spark's default, unless the session chose its own.

    The setting stays changed, because results are lazy and their tasks read it when they run.
    """
    if spark.conf.get(ARROW_ROWS, None) in (None, "10000"):
        spark.conf.set(ARROW_ROWS, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with a null text as the empty one."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage, by whichever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession, hours: float = 0.0) -> int:
    """Delete the operators' work folders that are older than ``hours`` and return how many; results must have been written by then."""
    jvm, deleted = spark.sparkContext._jvm, 0
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftline")
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return 0
    before = jvm.System.currentTimeMillis() - int(hours * 3_600_000)
    for status in store.listStatus(root):
        if status.getModificationTime() <= before:
            deleted += store.delete(status.getPath(), True)
    return deleted
