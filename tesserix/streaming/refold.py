"""Incremental day buckets of a stream of event files; the folded table equals the batch query over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def day_buckets(events: DataFrame, *extra: str) -> DataFrame:
    return events.groupBy(*extra, "user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def _parts(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType, files_per_batch: int, extra: tuple[str, ...]) -> DataFrame:
    """Partial buckets of each micro-batch under its number, so that a batch that runs twice replaces itself."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def fold(batch: DataFrame, batch_id: int) -> None:
        day_buckets(batch, *extra).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)


def stream_fold(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1, schema: StructType | None = None) -> DataFrame:
    """Rows of files that are only ever added to; late rows land in the bucket of their own day. Returns the folded table."""
    parts = _parts(spark, source, target, checkpoint, schema or spark.read.parquet(source).schema, files_per_batch, ())
    return parts.groupBy("user_id", "day").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


def stream_fold_sessions(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1, schema: StructType | None = None) -> DataFrame:
    """Files are versions of sessions (columns session and version): a later version replaces all that earlier ones said, whatever
    order they come in, so the table equals a fold of the newest versions alone."""
    parts = _parts(spark, source, target, checkpoint, schema or spark.read.parquet(source).schema, files_per_batch, ("session", "version"))
    newest = F.max("version").over(Window.partitionBy("session"))
    live = parts.withColumn("_newest", newest).filter("version = _newest")
    return live.groupBy("session", "user_id", "day").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
