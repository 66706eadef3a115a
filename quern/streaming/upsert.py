"""Structured Streaming: versioned upserts and idempotent scoring of arriving posts, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.relational import versioned


def start_versioned_upsert(posts: DataFrame, history_path: str, checkpoint: str, key: str, compared: Sequence[str], version: str = "version") -> StreamingQuery:
    """Append every new or changed post with its next version to a history table.

    A batch is written under its own number, replacing what an earlier try of it left, and compares with
    the batches before it alone: a repeated batch gives the same rows. Of a key that a batch has twice,
    the greatest by the compared columns counts.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(key).agg(F.max(F.struct(*compared)).alias("r")).select(key, "r.*")
        schema = latest.withColumn(version, F.lit(0).cast("bigint")).withColumn("input_change", F.lit("")).withColumn("batch", F.lit(0).cast("bigint")).schema
        path = spark._jvm.org.apache.hadoop.fs.Path(history_path)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        history = spark.read.schema(schema).parquet(history_path).where(F.col("batch") < number) if there else spark.createDataFrame([], schema)
        changed = versioned(latest, history.select(key, *compared, version), key, compared, version).where("input_change <> 'unchanged'")
        changed.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(history_path)

    return posts.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_scoring(posts: DataFrame, score: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str) -> StreamingQuery:
    """Score each batch once; a repeated batch replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path)

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per event-time window and group; events later than the watermark are left out, as declared."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean_value"))
