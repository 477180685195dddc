"""First-wins content history: a stream of documents against everything seen before, over restarts.

The history is a Parquet table of content hashes, partitioned by their first two digits so that a batch reads
only matching partitions. A micro-batch writes under its own number, and a batch that is run again after a crash
overwrites what it wrote before: each document is saved once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as T
from tessera.sources.files import exists


def seeded(spark: SparkSession, saved: str, history: str, text: str = "text", url: str = "url") -> None:
    """Starts a history from saved documents, if there is none yet."""
    if exists(spark, history) or not exists(spark, saved):
        return
    docs = spark.read.parquet(saved)
    firsts = docs.where(F.col(text).isNotNull()).groupBy(T.content_hash(F.col(text)).alias("content_hash")).agg(F.min(url).alias("url"))
    firsts.withColumn("batch", F.lit(-1)).withColumn("head", F.substring("content_hash", 1, 2)).write.partitionBy("batch", "head").parquet(history)


def known(spark: SparkSession, history: str, before: int | None = None) -> DataFrame:
    """content_hash, url of all content seen (before a batch)."""
    schema = "content_hash string, url string, batch int, head string"
    if not exists(spark, history):
        return spark.createDataFrame([], schema).select("content_hash", "url", "head")
    rows = spark.read.schema(schema).parquet(history)
    return (rows if before is None else rows.where(F.col("batch") < before)).select("content_hash", "url", "head")


def save_unseen(batch: DataFrame, number: int, saved: str, history: str, text: str = "text", url: str = "url", order: str = "url") -> None:
    """Saves the first document of each content that the history does not hold, then adds it there. A null text is never saved."""
    spark = batch.sparkSession
    docs = batch.where(F.col(text).isNotNull()).withColumn("content_hash", T.content_hash(F.col(text)))
    rest = [c for c in docs.columns if c != "content_hash"]
    first = docs.groupBy("content_hash").agg(F.min_by(F.struct(*rest), order).alias("d")).select("content_hash", "d.*").withColumn("head", F.substring("content_hash", 1, 2))
    new = first.join(known(spark, history, number), ["head", "content_hash"], "left_anti")
    new.drop("head").write.mode("overwrite").parquet(f"{saved}/batch={number}")
    made = spark.read.parquet(f"{saved}/batch={number}").select("content_hash", F.col(url).alias("url"))
    made.withColumn("head", F.substring("content_hash", 1, 2)).write.mode("overwrite").partitionBy("head").parquet(f"{history}/batch={number}")


def save_stream(stream: DataFrame, saved: str, history: str, checkpoint: str, text: str = "text", url: str = "url") -> StreamingQuery:
    """Runs save_unseen for all there is in a stream of documents, in micro-batches."""
    seeded(stream.sparkSession, saved, history, text, url)
    write = stream.writeStream.foreachBatch(lambda b, n: save_unseen(b, n, saved, history, text, url)).option("checkpointLocation", checkpoint)
    return write.trigger(availableNow=True).start()
