"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new local folder if driver and executors are one
    process or machine, else ValueError: each executor would write to a disk of its own."""
    context = spark.sparkContext
    if not (folder := spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.gettempdir()}/checkpoints")
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Results that still read them fail after
    this, so write what is to be kept first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts the lineage, and a lost
    executor costs no recomputation."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables (as `table` returns them) that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if f"/tables-{spark.sparkContext.applicationId}/" in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(rows: DataFrame, by: list[Column], *keep: str) -> DataFrame:
    """`keep` and rank, each row's place in a total order, without a task that holds all rows: a
    global sort is written, rows are numbered within its partitions, and the partitions' sizes (a row
    for each, so a bounded broadcast) give the offsets."""
    place = table(rows.orderBy(*by).select(*keep, F.monotonically_increasing_id().alias("_id")), "sorted").withColumn("_part", F.shiftright("_id", 33))
    sizes = place.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))
    return place.join(F.broadcast(before), "_part").select(*keep, (F.col("before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))
