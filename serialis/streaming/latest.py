"""Streams of incoming issues, and of deliveries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from serialis.operators.merging import insert_only


def latest_sync(incoming: DataFrame, time: str, key: str, titles: DataFrame, title: str, title_key: str, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Append new issues of known titles to the table at `path`, each key once. A batch that runs
    again after a failure finds its keys stored and adds nothing."""
    once = incoming.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])

    def add(batch: DataFrame, _: int) -> None:
        stored = batch.sparkSession.read.schema(batch.schema).parquet(path)
        insert_only(stored, batch, titles, title, title_key, [key]).write.mode("append").parquet(path)

    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage(deliveries: DataFrame, time: str, user: str, window: str = "22 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Deliveries per user in sliding windows; works on streams and tables alike."""
    return deliveries.withWatermark(time, delay).groupBy(F.window(time, window, slide), user).agg(F.count(F.lit(1)).alias("n"))
