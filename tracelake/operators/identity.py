"""Identity, series, retention and overview of telemetry records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.store import stored


def attrs_key(attrs: Column) -> Column:
    """Text of a map's entries in key order: equal maps have equal keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ",")


def instance_id(service: Column, service_instance: Column, resource_attrs: Column) -> Column:
    """service::instance, or the service and 16 digits of a hash of its resource attributes."""
    digest = F.left(F.sha1(F.concat_ws("\n", service, attrs_key(resource_attrs))), F.lit(16))
    own = F.when(F.coalesce(service_instance, F.lit("")) != "", service_instance)
    return F.concat(service, F.lit("::"), F.coalesce(own, digest))


def series_points(points: DataFrame) -> DataFrame:
    """Scalar series of metric points (metric, attrs, time_ms, value, count, sum, quantiles): one row per field."""
    field = lambda name, value: F.struct(F.lit(name).alias("field"), value.cast("double").alias("value"))
    plain = F.array(field("value", F.col("value")), field("count", F.col("count")), field("sum", F.col("sum")))
    quantiles = F.coalesce(F.transform("quantiles", lambda q: F.struct(F.concat(F.lit("q"), q["quantile"].cast("string")).alias("field"), q["value"].cast("double").alias("value"))), F.array().cast("array<struct<field:string,value:double>>"))
    rows = points.withColumn("_f", F.explode(F.filter(F.concat(plain, quantiles), lambda f: f["value"].isNotNull())))
    return rows.select(*(c for c in ("instance_id", "metric", "attrs", "time_ms", "seq") if c in points.columns), F.col("_f.field").alias("field"), F.col("_f.value").alias("value"), attrs_key(F.col("attrs")).alias("attrs_key"))


def drop_stale_points(points: DataFrame, keys: list[str], arrival: str = "seq") -> DataFrame:
    """Points whose time is greater than that of every earlier-arrived point of their series."""
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_far", F.max("time_ms").over(before)).where("_far is null or time_ms > _far").drop("_far")


def latest_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """The newest point of each series, ties to the later arrival."""
    return points.groupBy(*keys).agg(F.max("time_ms").alias("time_ms"), F.max_by("value", F.struct("time_ms", "seq")).alias("value"))


def retain_newest(df: DataFrame, keys: list[str], n: int, time: str = "time_ms", tie: str = "seq") -> DataFrame:
    """The newest n rows of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def newest_n(df: DataFrame, n: int, time: str = "time_ms", tie: str = "seq") -> DataFrame:
    """The newest n rows, oldest first."""
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n).orderBy(time, tie)


def list_services(spans: DataFrame, logs: DataFrame, points: DataFrame) -> DataFrame:
    """Per service and instance: traces, counts of each signal and the times seen, with totals per service and of all (level, as of a rollup).

    Spans are folded to one row for each trace and instance first; a trace of several instances or services counts once in each total.
    """
    counts = ("n_spans", "n_logs", "n_points")
    part = lambda df, signal, time, *by: df.groupBy("service", "instance_id", *by).agg(*((F.count("*") if s == signal else F.lit(0).cast("long")).alias(s) for s in counts), F.min(time).alias("first_ms"), F.max(time).alias("last_ms"))
    by_trace = stored(part(spans, "n_spans", "start_ms", "trace_id"))
    rows = by_trace.drop("trace_id").unionByName(part(logs, "n_logs", "time_ms")).unionByName(part(points, "n_points", "time_ms"))
    sums = rows.rollup("service", "instance_id").agg(F.grouping_id().cast("long").alias("level"), *(F.sum(c).alias(c) for c in counts), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    own = by_trace.groupBy("service", "instance_id").agg(F.count("*").alias("n_traces"), F.lit(0).cast("long").alias("level"))
    each = by_trace.select("service", "trace_id").distinct().groupBy("service", F.lit(None).cast("string").alias("instance_id")).agg(F.count("*").alias("n_traces"), F.lit(1).cast("long").alias("level"))
    whole = by_trace.select("trace_id").distinct().agg(F.count("*").alias("n_traces"), F.lit(3).cast("long").alias("level")).select(F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("instance_id"), "n_traces", "level")
    traces = own.unionByName(each).unionByName(whole)
    same = (F.col("s.level") == F.col("t.level")) & F.col("s.service").eqNullSafe(F.col("t.service")) & F.col("s.instance_id").eqNullSafe(F.col("t.instance_id"))
    return sums.alias("s").join(traces.alias("t"), same, "left").select("s.service", "s.instance_id", "s.level", F.coalesce("t.n_traces", F.lit(0)).alias("n_traces"), *(f"s.{c}" for c in counts), "s.first_ms", "s.last_ms")
