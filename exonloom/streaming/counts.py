"""Counts that go on as files arrive, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from exonloom.sources.files import BED6


def arriving_junctions(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of BED6 rows of the files that are put into ``folder``, with their sample."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_juncounts|_intcounts)?\.bed(?:\.gz)?$", 1)
    return spark.readStream.schema(BED6).option("sep", "\t").option("maxFilesPerTrigger", files_per_batch).csv(folder).withColumn("sample", stem)


def running_totals(stream: DataFrame) -> DataFrame:
    """(sample, chrom, start, end, count) over all that has arrived."""
    return stream.groupBy("sample", "chrom", "start", "end").agg(F.sum("score").alias("count"))


def windowed_events(stream: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n, total) per tumbling window; rows that come later than ``late`` after it are left out."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("_w"), F.col(kind).alias("kind"))
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("window_start"), "kind", "n", "total")


def into_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there now and stop; a rerun goes on from the checkpoint."""
    if mode == "append":
        return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(replace).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals that into_table(mode='complete') wrote."""
    all_ = spark.read.parquet(path)
    newest = all_.agg(F.max("batch")).first()[0]
    return all_.filter(F.col("batch") == newest).drop("batch")
