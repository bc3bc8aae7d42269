"""Tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where one machine holds all,
    one of our own if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="exonloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/exonloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._exonloom_path = path
    return out


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join, so that the driver never gathers it for a broadcast."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote and nothing will read again."""
    path = getattr(df, "_exonloom_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
