"""The append-only logs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumora.operators import store


def log_stream(spark: SparkSession, path: str, at: str = "ts") -> DataFrame:
    """A log written as parquet, as a stream of its files; ``at`` becomes a time with zone, as watermarks need."""
    schema = spark.read.parquet(path).schema
    # as a pattern the path may be a folder or one file
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn(at, F.col(at).cast("timestamp"))


def daily_counts(log: DataFrame, key: str, at: str = "ts", lateness: str = "10 days") -> DataFrame:
    """(day, n): rows of each day, each ``key`` once, final once ``lateness`` has passed; later rows are dropped."""
    seen = log.select(key, at).withWatermark(at, lateness).dropDuplicates([key, at])
    return seen.groupBy(F.window(at, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def keep_counters(log: DataFrame, counters: Callable[[], DataFrame], save: Callable[[DataFrame], None], checkpoint: str, key: str = "episode_id") -> StreamingQuery:
    """Counters by episode, kept in a table: each batch is counted and added to the rows it touches.

    ``counters`` reads the table (episode_id, n, last), ``save`` replaces it. State lies in the table and not in the
    stream, so it grows with the episodes and not with the log.
    """

    def add(batch: DataFrame, _: int) -> None:
        new = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
        both = counters().select(key, "n", "last").unionByName(new).groupBy(key).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        save(store.upserted(counters(), both.join(new.select(key), key, "left_semi"), key))

    return log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream in append mode has to say about all files there are now, written to ``folder`` and read again."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
