"""Streams of several batches against the batch forms: late copies, late records, batches that run again, bounded state."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tracelake.streaming import operators as streams
from tracelake.streaming import sinks

HOUR = 3_600_000
T0 = 1_700_000_000_000 // HOUR * HOUR


def at(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).replace(tzinfo=None)


def batches(spark, folder, schema, parts):
    """A stream whose batches are parts, in order: each its own file, by time of its last change."""
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


SPAN = "trace_id string, span_id string, service string, name string, kind string, status_code string, start_ms double, end_ms double, ts timestamp"


def span(i, end, name="n", ts=T0):
    return ("t", str(i), "s", name, "SERVER", "OK", float(T0), float(T0 + end), at(ts))


def test_the_copy_that_ends_last_replaces_an_earlier_one(spark, tmp_path):
    parts = [[span(1, 5), span(2, 9, "first"), (None, "x", "s", "n", "SERVER", "OK", 0.0, 1.0, at(T0))], [span(1, 7, "longer"), span(2, 3, "shorter")], [span(1, 6, "between"), span(3, 1), span(2, 20, "other window", T0 + 2 * HOUR)]]
    stream = batches(spark, f"{tmp_path}/in", SPAN, parts)
    sinks.start_latest_spans(stream, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    got = {r["span_id"]: (r["name"], r["end_ms"] - T0) for r in sinks.read_latest_spans(spark, f"{tmp_path}/out").collect()}
    assert got == {"1": ("longer", 7), "2": ("other window", 20), "3": ("n", 1)}


def test_state_of_spans_is_bounded(spark, tmp_path):
    """Windows behind the watermark leave the state."""
    parts = [[span(100 * k + i, 1, ts=T0 + 6 * k * HOUR) for i in range(50)] for k in range(5)]
    query = sinks.start_latest_spans(batches(spark, f"{tmp_path}/in", SPAN, parts), f"{tmp_path}/out", f"{tmp_path}/state", once=True)
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) <= 100 and sinks.read_latest_spans(spark, f"{tmp_path}/out").count() == 250


VOLUME = "service string, signal string, time_ms double, bytes long"


def test_late_records_are_in_the_totals(spark, tmp_path):
    row = lambda minute, size=10: ("s", "logs", float(T0 + minute * 60_000), size)
    parts = [[row(0), row(1)], [row(100), row(99), row(30)], [row(41), row(40), row(100, 1)]]
    sinks.start_volume(batches(spark, f"{tmp_path}/in", VOLUME, parts), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    buckets, totals = sinks.read_volume(spark, f"{tmp_path}/out")
    assert {((r["from_ms"] - T0) // 60_000): (r["n_records"], r["bytes"]) for r in buckets.collect()} == {100: (2, 11), 99: (1, 10), 41: (1, 10)}
    assert [tuple(r) for r in totals.collect()] == [("s", "logs", 8, 71, 2)]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    made = []
    rows = spark.createDataFrame([("s", "logs", float(T0), 3), ("s", "logs", float(T0 + 1), 4)], VOLUME)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(VOLUME).parquet(f"{tmp_path}/in")

    class Twice:
        """Stands for the stream; takes the sink's function and calls it twice with each batch."""

        def __getattr__(self, name):
            return lambda *a, **k: (made.append(a[0]) if name == "foreachBatch" else None, self)[1]

    class Frame:
        writeStream = Twice()

    sinks.start_volume(Frame(), f"{tmp_path}/out", "unused", once=True)
    for batch in (0, 1, 1):
        made[0](rows, batch)
    assert stream.isStreaming
    assert sinks.read_volume(spark, f"{tmp_path}/out")[1].first()["n_records"] == 4  # two batches of two


def test_distinct_over_batches(spark, tmp_path):
    parts = [[("a", str(k), at(T0)) for k in range(30)], [("a", str(k), at(T0 + 30 * HOUR)) for k in range(20, 50)] + [("b", "x", at(T0))], [("b", "x", at(T0 + 30 * HOUR)), ("a", None, at(T0))]]
    query = sinks.start_distinct(batches(spark, f"{tmp_path}/in", "key string, value string, ts timestamp", parts), f"{tmp_path}/out", f"{tmp_path}/state", "100 hours", once=True)
    query.awaitTermination()
    assert {r["key"]: r["n_distinct"] for r in sinks.read_distinct(spark, f"{tmp_path}/out").collect()} == {"a": 50, "b": 1}
    later = sinks.read_distinct(spark, f"{tmp_path}/out", F.col("from_ts") > F.lit(at(T0)))
    assert {r["key"]: r["n_distinct"] for r in later.collect()} == {"a": 30, "b": 1}
    assert sinks.compact(spark, f"{tmp_path}/out", lambda rows: rows.groupBy("from_ts", "key").agg(F.hll_union_agg("sketch").alias("sketch")), 100) == 3
    assert {r["key"]: r["n_distinct"] for r in sinks.read_distinct(spark, f"{tmp_path}/out").collect()} == {"a": 50, "b": 1}


def test_latest_spans_as_a_batch(spark):
    rows = spark.createDataFrame([span(1, 5), span(1, 8, "b"), span(2, 1)], SPAN)
    assert {(r["span_id"], r["name"]) for r in streams.latest_spans(rows).collect()} == {("1", "b"), ("2", "n")}


def test_copies_of_spans_need_no_state(spark, tmp_path):
    """However late a copy is and however many spans there are: all are kept, and the one that ends last is read."""
    parts = [[span(1, 5), span(2, 9, "first"), (None, "x", "s", "n", "SERVER", "OK", 0.0, 1.0, at(T0))], [span(1, 7, "longer", T0 + 900 * HOUR), span(2, 3, "shorter")], [span(1, 6, "between"), span(3, 1), span(2, 20, "late")]]
    query = sinks.start_span_copies(batches(spark, f"{tmp_path}/in", SPAN, parts), f"{tmp_path}/out", f"{tmp_path}/state", once=True)
    query.awaitTermination()
    assert len(query.recentProgress) >= 3 and not any(p["stateOperators"] for p in query.recentProgress)
    got = {r["span_id"]: (r["name"], r["end_ms"] - T0) for r in sinks.read_latest_spans(spark, f"{tmp_path}/out").collect()}
    assert got == {"1": ("longer", 7), "2": ("late", 20), "3": ("n", 1)}


def test_points_of_a_series_in_several_frames(spark, tmp_path):
    """A batch of more points than a frame holds, newest first: all are kept, each time once; the next batch's older ones are not."""
    n, schema = 25_000, "k string, time_ms double, value double"
    parts = [[("a", float(n - i), 1.0) for i in range(n)] + [("a", float(n - i), 2.0) for i in range(0, n, 100)], [("a", float(n + 1), 3.0), ("a", 5.5, 3.0), ("b", 1.0, 3.0)]]
    points = streams.stream_series_points(batches(spark, f"{tmp_path}/in", schema, parts), ["k"])
    points.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("time_ms").alias("times"), F.max("time_ms").alias("last"))
    assert {tuple(r) for r in rows.collect()} == {("a", n + 1, n + 1, n + 1.0), ("b", 1, 1, 1.0)}


def test_distinct_values_are_exact(spark, tmp_path):
    """Far more values than a sketch tells apart, over batches and windows; a fold keeps them."""
    n, schema = 20_000, "key string, value string, ts timestamp"
    parts = [[("a", str(k), at(T0)) for k in range(n)], [("a", str(k), at(T0 + 30 * HOUR)) for k in range(n // 2, n + 5)] + [("b", None, at(T0))]]
    sinks.start_distinct_values(batches(spark, f"{tmp_path}/in", schema, parts), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    counts = lambda *where: {r["key"]: r["n_distinct"] for r in sinks.read_distinct_values(spark, f"{tmp_path}/out", *where).collect()}
    assert counts() == {"a": n + 5, "b": 0} and counts(F.col("from_ts") > F.lit(at(T0))) == {"a": n // 2 + 5}
    assert sinks.compact(spark, f"{tmp_path}/out", lambda rows: rows.distinct(), 100) == 2 and counts() == {"a": n + 5, "b": 0}
