"""Streams against the batch forms of what they do."""

import random

from larkspur.operators import analytics
from larkspur.streaming import limits


def stream(spark, path, batches, schema):
    """A file source that takes one file at a time, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return [spark.read.parquet(f"{path}/{i}") for i in range(len(batches))]


def requests(n=120):
    r = random.Random(4)
    t, out = 0.0, []
    for i in range(n):
        t += r.choice([0.0, 0.5, 3.0, 20.0])
        out.append((r.choice(["a", "b", "hot", "hot"]), i, t))
    return out


def brute(rows, limit, window):
    kept, out = {}, {}
    for k, i, t in sorted(rows, key=lambda x: (x[2], x[1])):
        mine = kept[k] = [x for x in kept.get(k, []) if x >= t - window]
        out[i] = (len(mine) < limit, 0 if len(mine) < limit else max(1, int(mine[0] + window - t)))
        if len(mine) < limit:
            mine.append(t)
    return out


def test_limiter(spark, tmp_path):
    rows = requests()
    want = brute(rows, 3, 30)
    batch = spark.createDataFrame(rows, "key string, event_id long, t double").withColumn("ts", analytics.F.timestamp_seconds("t"))
    assert {r.event_id: (r.allowed, r.retry_after) for r in analytics.allowed("key", "ts", batch, 3, 30).collect()} == want
    got = {}
    for k in range(3):  # three runs of the stream, each with new files and the state of those before
        spark.createDataFrame(rows[40 * k : 40 * k + 40], "key string, event_id long, t double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("key string, event_id long, t double").parquet(str(tmp_path / "in"))

        def keep(df, _):
            got.update({r.event_id: (r.allowed, r.retry_after) for r in df.collect()})

        limits.limiter_stream(source, 3, 30).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert got == want


def test_changes(spark, tmp_path):
    schema = "course_id string, doc_seq long, title string, deleted boolean"
    runs = [[("a", 0, "one", False), ("b", 1, "two", False)], [("a", 0, "one again", False), ("c", 1, "three", None)], [("b", 0, None, True)]]
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        limits.changes_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "base"), str(tmp_path / "cp")).awaitTermination()
    now = {r.course_id: (r.title, r.doc_seq) for r in limits.current(spark, str(tmp_path / "base")).collect()}
    assert now == {"a": ("one again", 0), "c": ("three", 1)}


def test_log_and_windows(spark, tmp_path):
    schema = "query_text string, normalized_query string, route_type string, metadata_json string, result_count int"
    rows = [("x", "x", "search", "{}", 2), ("y", "y", "search", "{}", 0), ("z", None, "suggest", "{}", 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    limits.log_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log/search_events")).count() == 3 and spark.read.parquet(str(tmp_path / "log/zero_result_events")).count() == 2
    times = [(f"2024-01-01 00:00:{s:02d}", "k") for s in (1, 2, 59)] + [("2024-01-01 00:01:05", "k")]
    df = spark.createDataFrame(times, "t string, key string").selectExpr("cast(t as timestamp) ts", "key")
    assert sorted(r.n for r in limits.requests_per_window(df, "ts", "key").collect()) == [1, 3]
