"""Streaming forms: volume, dedupe, windows of calls, trace sessions, series without stale points, distinct counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000.0


def event_time(time_ms: Column, now_ms: Column) -> Column:
    """Timestamp of a record; one that is missing or over a day ahead takes the arrival clock."""
    ok = time_ms.isNotNull() & (time_ms > 0) & (time_ms <= now_ms + DAY_MS)
    return F.timestamp_micros((F.when(ok, time_ms).otherwise(now_ms) * 1000).cast("bigint"))


def stream_volume(records: DataFrame, late: str = "60 minutes", width: str = "1 minute") -> DataFrame:
    """Records and bytes per service, signal and window of ts, for sinks that take windows; sinks.start_volume also keeps what comes late."""
    rows = records.withWatermark("ts", late).groupBy(F.window("ts", width), "service", "signal").agg(F.count("*").alias("n_records"), F.sum("bytes").alias("bytes"))
    return rows.select(F.col("window.start").alias("from_ts"), "service", "signal", "n_records", "bytes")


#: Order in which one copy of a span wins: the greatest end, then fixed columns.
COPY_ORDER = ("end_ms", "start_ms", "service", "name", "kind", "status_code")


def latest_spans(spans: DataFrame, late: str = "60 minutes", width: str = "1 hour") -> DataFrame:
    """Of the copies of each span in a window of ts the one that ends last; for output mode update, which gives it anew when it changes.

    Spans without ids are dropped. State is one copy for each span and window, and goes when the watermark passes the window. Copies in
    different windows are told apart by the sink.
    """
    known = spans.where((F.coalesce("trace_id", F.lit("")) != "") & (F.coalesce("span_id", F.lit("")) != ""))
    columns = [c for c in spans.columns if c != "ts"]
    rest = [c for c in columns if c not in COPY_ORDER]
    best = F.max(F.struct(*COPY_ORDER, F.struct(*rest).alias("rest")))
    rows = known.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("trace_id").alias("_t"), F.col("span_id").alias("_s")).agg(best.alias("best"))
    return rows.select(*(F.col(f"best.{c}" if c in COPY_ORDER else f"best.rest.{c}").alias(c) for c in columns))


def stream_dedupe_spans(spans: DataFrame, late: str = "60 minutes") -> DataFrame:
    """The first copy of each span, for sinks that only append; state is dropped behind the watermark. See latest_spans for the last copy."""
    return spans.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def stream_service_map(calls: DataFrame, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Calls, errors and p95 (of a mergeable sketch) of each edge in sliding windows."""
    rows = calls.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "source", "target").agg(F.count("*").alias("n_calls"), F.count_if("is_error").alias("n_errors"), F.expr("kll_sketch_agg_double(ms)").alias("sketch"))
    return rows.select(F.col("window.start").alias("from_ts"), "source", "target", "n_calls", "n_errors", F.expr("kll_sketch_get_quantile_double(sketch, 0.95D)").alias("p95_ms"))


def stream_trace_sessions(spans: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """A trace is complete when no span of it came for gap: its extent, spans and errors."""
    rows = spans.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "trace_id").agg(F.count("*").alias("n_spans"), F.count_if(F.col("status_code") == "ERROR").alias("n_errors"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return rows.drop("session_window")


def stream_series_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, time_ms, value) without those that are not newer than all that their series had in earlier batches; of equal times one.

    The points of a batch come in any order and in several frames, so each is held against the batches before, not against other frames.
    """
    schema = points.select(*keys, "time_ms", "value").schema

    def unseen(runs: list[np.ndarray], times: np.ndarray) -> np.ndarray:
        """Which of times (each there once) are in none of runs, to which they are added: sorted, and each over twice as long as the next."""
        new = np.ones(len(times), bool)
        for run in runs:
            new &= run[np.minimum(np.searchsorted(run, times), len(run) - 1)] != times
        if new.any():
            runs.append(np.sort(times[new]))
        while len(runs) > 1 and len(runs[-2]) <= 2 * len(runs[-1]):
            runs[-2:] = [np.sort(np.concatenate(runs[-2:]))]
        return new

    def fresh(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = last = state.get[0] if state.exists else float("-inf")
        seen: list[np.ndarray] = []
        for frame in frames:
            frame = frame[frame["time_ms"] > before].drop_duplicates("time_ms")
            frame = frame[unseen(seen, frame["time_ms"].to_numpy(float))]
            if len(frame):
                last = max(last, float(frame["time_ms"].max()))
                yield frame[schema.names]
        state.update((last,))

    return points.select(*keys, "time_ms", "value").groupBy(*keys).applyInPandasWithState(fresh, schema, "last double", "append", "NoTimeout")
