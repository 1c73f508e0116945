"""Metrics: series summaries, rates, rollups, reductions across series, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.identity import attrs_key

AGGREGATES = ("last", "avg", "min", "max", "sum", "count", "stddev", "p50", "p90", "p95", "p99")
MAX_BUCKETS = 5000


def list_metrics(points: DataFrame) -> DataFrame:
    """Per instance and metric: type, whether monotonic, points and distinct series."""
    return points.groupBy("instance_id", "metric").agg(F.first("type").alias("type"), F.max("monotonic").alias("monotonic"), F.count("*").alias("n_points"), F.count_distinct(attrs_key(F.col("attrs"))).alias("n_series"))


def finite(points: DataFrame) -> DataFrame:
    return points.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def summarize_series(points: DataFrame, *keys: str) -> DataFrame:
    """Per series: points, times, last, min, max, mean, quantiles, change from first to last, and rate a second."""
    last, first = F.max_by("value", F.struct("time_ms", "seq")), F.min_by("value", F.struct("time_ms", "seq"))
    out = finite(points).groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.min("time_ms").alias("from_ms"), F.max("time_ms").alias("to_ms"), last.alias("last"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("avg"), F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"), (last - first).alias("delta"),
    )
    seconds = (F.col("to_ms") - F.col("from_ms")) / 1000
    return out.withColumn("per_second", F.when(seconds > 0, F.col("delta") / seconds))


def counter_rate(points: DataFrame, keys: list[str], monotonic: bool = True) -> DataFrame:
    """Change per second from point to point; null for the first, and for a counter where it was reset."""
    order = Window.partitionBy(*keys).orderBy("time_ms", "seq")
    change = F.col("value") - F.lag("value").over(order)
    seconds = (F.col("time_ms") - F.lag("time_ms").over(order)) / 1000
    rate = F.when(seconds > 0, change / seconds)
    return points.withColumn("rate", F.when(change >= 0, rate) if monotonic else rate)


def aggregate(name: str) -> Column:
    """One of AGGREGATES over value; stddev is that of the population, quantiles are interpolated."""
    if name[0] == "p":
        return F.percentile("value", F.lit(int(name[1:]) / 100))
    return {"last": F.max_by("value", F.struct("time_ms", "seq")), "avg": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "sum": F.sum("value"), "count": F.count("value").cast("double"), "stddev": F.stddev_pop("value")}[name]


def rollup_over_time(points: DataFrame, keys: list[str], step_ms: int, *names: str) -> DataFrame:
    """Buckets of step_ms aligned to 0, from each key's first to its last, empty ones null.

    Of a key with a span of over MAX_BUCKETS buckets only those with points are returned, so that no point is lost and no row is made
    up without bound.
    """
    bucket = (F.floor(F.col("time_ms") / step_ms) * step_ms).cast("bigint")
    found = finite(points).groupBy(*keys, bucket.alias("bucket_ms")).agg(*(aggregate(n).alias(n) for n in names))
    ends = found.groupBy(*keys).agg(F.min("bucket_ms").alias("lo"), F.max("bucket_ms").alias("hi"))
    long = F.col("hi") - F.col("lo") >= MAX_BUCKETS * step_ms
    spine = ends.where(~long).select(*keys, F.explode(F.sequence("lo", "hi", F.lit(step_ms).cast("bigint"))).alias("bucket_ms"))
    filled = spine.join(found, [*keys, "bucket_ms"], "left")
    return filled.unionByName(found.join(ends.where(long).select(*keys), keys, "left_semi"))


NICE_STEPS_MS = (1_000, 2_000, 5_000, 10_000, 15_000, 30_000, 60_000, 120_000, 300_000, 600_000, 900_000, 1_800_000, 3_600_000, 7_200_000, 14_400_000, 21_600_000, 43_200_000, 86_400_000)


def auto_step(points: DataFrame, keys: list[str], target: int = 120) -> DataFrame:
    """Per series the bucket that gives about target buckets, at least the upper median spacing, at the next nice step."""
    order = Window.partitionBy(*keys).orderBy("time_ms", "seq")
    gaps = points.withColumn("gap", F.col("time_ms") - F.lag("time_ms").over(order))
    n = F.count("gap").over(Window.partitionBy(*keys))
    gaps = gaps.withColumn("n", n).withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("gap").asc_nulls_last())))
    out = gaps.groupBy(*keys).agg((F.max("time_ms") - F.min("time_ms")).alias("range_ms"), F.max(F.when(F.col("at") == F.floor(F.col("n") / 2) + 1, F.col("gap"))).alias("spacing_ms"))
    want = F.greatest(F.col("range_ms") / target, F.coalesce("spacing_ms", F.lit(0.0)))
    step = F.lit(NICE_STEPS_MS[-1])
    for s in reversed(NICE_STEPS_MS):
        step = F.when(want <= s, s).otherwise(step)
    return out.withColumn("step_ms", step.cast("bigint"))


def window_series(points: DataFrame, keys: list[str], range_ms: float) -> DataFrame:
    """Points in the range before each series' newest, and the one point before it."""
    series = Window.partitionBy(*keys)
    rows = points.withColumn("_from", F.max("time_ms").over(series) - range_ms)
    rows = rows.withColumn("_before", F.max(F.when(F.col("time_ms") < F.col("_from"), F.col("time_ms"))).over(series))
    return rows.where((F.col("time_ms") >= F.col("_from")) | (F.col("time_ms") == F.col("_before"))).drop("_from", "_before")


def reduce_across_series(points: DataFrame, step_ms: int) -> DataFrame:
    """Sum, mean, extremes and p95 across all series of a metric at each time (rounded down to step_ms)."""
    at = (F.floor(F.col("time_ms") / step_ms) * step_ms).cast("bigint").alias("time_ms")
    return finite(points).groupBy("metric", at).agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("value", F.lit(0.95)).alias("p95"))


def align_series(points: DataFrame, keys: list[str], step_ms: int) -> DataFrame:
    """Every series of a metric on one axis of times that any of them has; gaps are null."""
    at = (F.floor(F.col("time_ms") / step_ms) * step_ms).cast("bigint")
    found = finite(points).groupBy("metric", *keys, at.alias("bucket_ms")).agg(aggregate("last").alias("value"))
    axis = found.select("metric", "bucket_ms").distinct()
    spine = found.select("metric", *keys).distinct().join(axis, "metric")
    return spine.join(found, ["metric", *keys, "bucket_ms"], "left")


def stack_series(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Running total over the series of a metric, in order of their keys, at each time."""
    order = Window.partitionBy("metric", "bucket_ms").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return aligned.withColumn("stacked", F.sum(F.coalesce("value", F.lit(0.0))).over(order))


def histogram_quantile(bounds: Column, counts: Column, q: float) -> Column:
    """Quantile by linear interpolation within the bucket it falls in; the open last bucket gives the last bound."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    rank = total * q
    # Walk the buckets: (seen before, index, found value).
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("v"))

    def step(s, n):
        low = F.when(s["i"] == 0, 0.0).otherwise(F.get(bounds, s["i"] - 1))
        high = F.coalesce(F.get(bounds, s["i"]), F.element_at(bounds, -1))
        inside = F.when(s["i"] >= F.size(bounds), F.element_at(bounds, -1)).otherwise(low + (high - low) * F.when(n > 0, (rank - s["seen"]) / n).otherwise(0.0))
        v = F.coalesce(s["v"], F.when((n > 0) & (s["seen"] + n >= rank), inside))
        return F.struct((s["seen"] + n).alias("seen"), (s["i"] + 1).alias("i"), v.alias("v"))

    return F.when(total > 0, F.aggregate(counts, start, step)["v"])


def histogram_mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count)


def histogram_buckets(histograms: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Labelled bucket counts of the latest histogram of each key (bounds, counts)."""
    latest = histograms.groupBy(*keys).agg(F.max_by(F.struct("bounds", "counts"), time).alias("h"))
    rows = latest.select(*keys, F.col("h.bounds").alias("bounds"), F.posexplode("h.counts").alias("i", "n"))
    low, high = F.get("bounds", F.col("i") - 1), F.get("bounds", F.col("i"))
    text = lambda c: c.cast("bigint").cast("string")
    label = F.when(F.col("i") == 0, F.concat(F.lit("≤ "), text(high))).when(high.isNull(), F.concat(F.lit("> "), text(low))).otherwise(F.concat(text(low), F.lit(" – "), text(high)))
    return rows.select(*keys, "i", label.alias("label"), F.col("n").cast("bigint").alias("n"))


def summary_quantiles(series: DataFrame, keys: list[str]) -> DataFrame:
    """Latest value of each quantile series (fields that begin with q)."""
    return series.where(F.col("field").startswith("q")).groupBy(*keys, "field").agg(F.max_by("value", "time_ms").alias("value"))
