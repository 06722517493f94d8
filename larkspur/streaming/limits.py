"""Streams: the query log's two sinks, index upkeep, the limiter, and windowed counts with late data."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from larkspur.operators import analytics
from larkspur.settings import SETTINGS


def log_stream(events: DataFrame, path: str, checkpoint: str):
    """Each batch goes to the search events, and its empty results to their own table."""
    return events.writeStream.foreachBatch(lambda df, _: analytics.record(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_stream(changes: DataFrame, base: str, checkpoint: str):
    """Each batch of upserts (rows) and deletes (``deleted`` true) is appended with its number as version; a batch that
    comes again after a failure replaces itself."""

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/version={n}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, base: str, id: str = "course_id", seq: str = "doc_seq") -> DataFrame:
    """The catalogue that the versions add up to: of each id the last write, unless it is a delete."""
    every = spark.read.option("basePath", base).parquet(base)
    by = Window.partitionBy(id)
    last = every.withColumn("rn", F.row_number().over(by.orderBy(F.desc("version"), F.desc(seq)))).withColumn("first_seen", F.min(F.struct("version", seq)).over(by))
    return last.where("rn = 1 and not coalesce(deleted, false)").withColumn(seq, F.col(f"first_seen.{seq}")).drop("rn", "first_seen", "deleted", "version")


def limiter_stream(requests: DataFrame, limit: int = SETTINGS.rate_limit, window: int = SETTINGS.rate_window_seconds) -> DataFrame:
    """The sliding-log limiter over a stream of (key, event_id, t in seconds): a key's state is the times of its last
    allowed requests, ``limit`` at most."""

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = deque(state.get[0] if state.exists else [])
        f = pd.concat(list(frames)).sort_values(["t", "event_id"])
        wait = [analytics.step(kept, t, limit, window) for t in f["t"]]
        state.update((list(kept),))
        yield pd.DataFrame({"event_id": f["event_id"], "key": key[0], "allowed": [w == 0 for w in wait], "retry_after": wait})

    return requests.groupBy("key").applyInPandasWithState(decide, "event_id long, key string, allowed boolean, retry_after int", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def requests_per_window(events: DataFrame, ts: str, key: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
