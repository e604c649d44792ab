"""Lifetimes and failures by key, as a stream with state by key and event time.

A key's uses that follow each other within a time to live are one life. A life ends when the watermark reaches
its last use and that time; it was dropped if its uses failed more often than may be tried again. State holds
open lives only, one row each, and uses may come in any order within the watermark's delay: one that touches
two lives joins them. Lives are session windows, so no row or key passes through Python.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from serialis.operators.planning import RETRIES


def lives(uses: DataFrame, key: str, time: str, failed: str, ttl_seconds: int, delay: str = "1 hour", retries: int = RETRIES) -> DataFrame:
    """A stream (key, first, last, uses, failures, dropped) of the lives that have ended. `failed` is a boolean column;
    a null one counts as not failed. A use later than the delay still counts, in an open life or as a life of its own,
    unless the watermark has reached its own time to live: then it is lost."""
    told = uses.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.col(failed).alias("__failed")).withWatermark("__time", delay)
    ended = told.groupBy("__key", F.session_window("__time", f"{ttl_seconds} seconds").alias("__life")).agg(F.max("__time").alias("last"), F.count(F.lit(1)).alias("uses"), F.count_if("__failed").alias("failures"))
    return ended.select(F.col("__key").alias(key), F.col("__life.start").alias("first"), "last", "uses", "failures", (F.col("failures") > retries).alias("dropped"))


def run(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has come to a table, and end; a later run with the same checkpoint goes on from there."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return query
