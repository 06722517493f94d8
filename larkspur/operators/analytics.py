"""The query log: sinks, latest rows, counts, latencies; and request guards."""

from __future__ import annotations

import datetime
import json
import logging
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import lexicon as L
from larkspur.errors import ServiceError
from larkspur.settings import SETTINGS
from larkspur.sources.store import materialised

SEARCH_EVENT = "at timestamp, query_text string, normalized_query string, corrected_query string, route_type string, result_count int, latency_ms double, zero_results boolean, degraded boolean, metadata_json string"
CORRECTION_EVENT = "at timestamp, original_query string, corrected_query string, route_type string"
MOCK_CONFIDENCE = 0.64
log = logging.getLogger(__name__)


def record(events: DataFrame, path: str) -> None:
    """Appends search events, and those without results to a table of their own; the rows are read once."""
    events = materialised(events)
    events.write.mode("append").partitionBy("route_type").parquet(f"{path}/search_events")
    events.where("result_count = 0").select("query_text", "normalized_query", "route_type", "metadata_json").write.mode("append").parquet(f"{path}/zero_result_events")


class QueryLog:
    """Search and correction events as tables; a write that fails is logged and doesn't fail the search."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, row: tuple, schema: str, write) -> None:
        try:
            write(self.spark.createDataFrame([row], schema))
        except Exception as e:
            log.warning("query log write failed: %s", e)

    def search(self, query: str, normalized: str | None, corrected: str | None, n: int, latency_ms: float, route: str = "search", metadata: dict | None = None, degraded: bool = False) -> None:
        row = (datetime.datetime.now(), query, normalized, corrected, route, n, latency_ms, n == 0, degraded, json.dumps(metadata or {}, ensure_ascii=False))
        self._append(row, SEARCH_EVENT, lambda df: record(df, self.path))

    def correction(self, original: str, corrected: str, route: str = "search") -> None:
        self._append((datetime.datetime.now(), original, corrected, route), CORRECTION_EVENT, lambda df: df.write.mode("append").parquet(f"{self.path}/correction_events"))

    def events(self, name: str = "search_events") -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def recent(self, n: int = 20) -> DataFrame:
        return latest(self.events(), n, "at")

    def count(self) -> int:
        return self.events().count()

    def health(self) -> dict:
        try:
            mean = mean_of_latest(self.events(), "latency_ms", "at").first()["mean_latency"]
            return {"status": "up", "details": {"path": self.path, "search_event_count": self.count(), "avg_latency_ms": mean}}
        except Exception as e:
            return {"status": "degraded", "details": {"path": self.path, "reason": str(e).splitlines()[0]}}


def popularity(events: DataFrame, query: str = "query_text") -> DataFrame:
    """How often each query was asked."""
    return events.groupBy(query).agg(F.count("*").alias("n"))


def suggestion_count(groups: DataFrame, items: str = "items") -> DataFrame:
    """One row: the number of items in all groups."""
    return groups.agg(F.coalesce(F.sum(F.size(items)), F.lit(0)).cast("long").alias("n"))


def latest(events: DataFrame, n: int, id: str) -> DataFrame:
    return events.orderBy(F.desc(id)).limit(n)


def mean_of_latest(events: DataFrame, value: str, id: str, n: int = SETTINGS.mean_of_latest) -> DataFrame:
    return latest(events, n, id).agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), 2).alias("mean_latency"), F.count("*").alias("n"))


def allowed(key: str, ts: str, rows: DataFrame, limit: int = SETTINGS.rate_limit, window: int = SETTINGS.rate_window_seconds) -> DataFrame:
    """Sliding-log limiter: rejected requests aren't stored, so a key's decisions depend on each other in order of time.

    Rows are dealt by key and sorted in their partition; a task walks through them and keeps at most
    ``limit`` times, however many requests a key has.
    """
    slim = rows.select("event_id", F.col(key).alias("key"), F.col(ts).cast("timestamp").cast("double").alias("t"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: deque[float] = deque()
        now = object()
        for f in batches:
            ok, wait = [], []
            for k, t in zip(f["key"], f["t"], strict=True):
                if k != now:
                    now, kept = k, deque()
                w = step(kept, t, limit, window)
                ok.append(w == 0)
                wait.append(w)
            yield f[["event_id", "key"]].assign(allowed=ok, retry_after=wait)

    kind = slim.schema["key"].dataType.simpleString()
    return slim.where("key is not null and t is not null").repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(walk, f"event_id long, key {kind}, allowed boolean, retry_after int")


def step(kept: deque, t: float, limit: int, window: int) -> int:
    """0 if a request at this time may pass, which stores it; else the seconds to wait."""
    while kept and kept[0] < t - window:
        kept.popleft()
    if len(kept) >= limit:
        return max(1, int(kept[0] + window - t))
    kept.append(t)
    return 0


def requests_in_window(rows: DataFrame, key: str, ts: str, window: int = SETTINGS.rate_window_seconds) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-window, 0)
    return rows.withColumn("in_window", F.count("*").over(w))


def size_allowed(length: Column, path: Column) -> Column:
    return length <= F.when(path.endswith("/search/voice"), SETTINGS.max_audio_bytes).otherwise(SETTINGS.max_request_bytes)


def audio_allowed(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(L.AUDIO_TYPES)


def check_audio(content_type: str, length: int) -> None:
    kind = (content_type or "").strip().lower().split(";", 1)[0].strip()
    if kind not in L.AUDIO_TYPES:
        raise ServiceError("unsupported_audio_type", "Unsupported audio format", 415, {"allowed_types": L.AUDIO_TYPES, "received_type": content_type, "normalized_type": kind})
    if length > SETTINGS.max_audio_bytes:
        raise ServiceError("audio_too_large", "Audio payload exceeds configured size limit", 413, {"max_audio_upload_bytes": SETTINGS.max_audio_bytes, "received_bytes": length})


def exempt(path: Column) -> Column:
    """Routes that need no key and have no limit."""
    open_ = ["/demo", "/docs", "/redoc", "/openapi.json", *(f"{SETTINGS.api_prefix}/{x}" for x in ("health", "ready", "live"))]
    out = path == "/"
    for p in open_:
        out = out | (path == p) | path.startswith(f"{p}/")
    return out


def authorised(api_key: Column, path: Column, keys: list[str]) -> Column:
    """200, or 401 for a missing and 403 for an unknown key."""
    return F.when(exempt(path), 200).when(api_key.isNull() | (api_key == ""), 401).when(api_key.isin(keys), 200).otherwise(403)


def identity(api_key: Column, forwarded: Column, host: Column, path: Column) -> Column:
    """Whom the limiter counts: the key, else the first forwarded address, else the host; by route."""
    address = F.when(forwarded.isNotNull() & (forwarded != ""), F.trim(F.substring_index(forwarded, ",", 1))).otherwise(F.coalesce(host, F.lit("unknown")))
    return F.concat(F.when(api_key.isNotNull() & (api_key != ""), F.concat(F.lit("key:"), api_key)).otherwise(F.concat(F.lit("ip:"), address)), F.lit(":"), path)


def mock_transcript(path: Column) -> Column:
    """The file name's stem as words, without fillers."""
    from larkspur.functions.text import remove_fillers

    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return remove_fillers(F.translate(stem, "_-", "  "))
