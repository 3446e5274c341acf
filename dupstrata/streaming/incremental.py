"""Incremental redundancy over a growing folder of chunk files: an extension with Structured Streaming.

Each micro-batch's fingerprints are joined against an index table in shared storage; what the index lacks is counted as
new and appended, so state is a table and not executor memory, and a query restarts from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

INDEX = "fp string, chunksize long, batch long"


def unique_chunks(stream: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First occurrences of fingerprints; with an event time, state older than delay is dropped."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fp"])
    return stream.dropDuplicates(["fp"])


def maintain_index(spark: SparkSession, source: str, schema: StructType | str, index: str, totals: str, checkpoint: str) -> StreamingQuery:
    """Reads new Parquet chunk files below source; appends unseen fingerprints to index and one row of sums a batch to totals.

    A repeated batch replaces what an earlier try of it wrote: each batch has a folder of its own in index and totals, and
    is compared with the other batches' only.
    """
    spark.createDataFrame([], INDEX).drop("batch").write.mode("overwrite").parquet(f"{index}/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(INDEX).parquet(index).where(F.col("batch") != number).select("fp").distinct().withColumn("_known", F.lit(True))
        per = batch.groupBy("fp").agg(F.sum("chunksize").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("chunksize").alias("chunksize")).join(known, "fp", "left")
        new = per.where("_known is null")
        new.select("fp", "chunksize").write.mode("overwrite").parquet(f"{index}/batch={number}")
        real = F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("chunksize"))), F.lit(0))
        per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"), real.alias("real")).write.mode("overwrite").parquet(f"{totals}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
