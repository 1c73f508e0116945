"""Logs: filters, queries, order, correlation with traces and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import typed
from tracelake.functions.scalars import severity_label


def filter_logs(logs: DataFrame, min_severity: int = 0, text: str = "", attrs: dict[str, str] | None = None, range_ms: float | None = None) -> DataFrame:
    """Logs of a severity or more that hold text in body, attributes or level (any case), with attributes, in the newest range."""
    rows = logs.where(F.col("severity_number") >= min_severity)
    if text:
        where = F.lower(F.concat_ws(" ", "body", severity_label(F.col("severity_number")), F.array_join(F.map_values("attrs"), " ")))
        rows = rows.where(where.contains(text.lower()))
    for k, v in (attrs or {}).items():
        rows = rows.where(F.element_at("attrs", k) == v)
    if range_ms is not None:
        newest = F.broadcast(logs.agg(F.max("time_ms").alias("_newest")).withColumn("_k", F.lit(1)))  # one row
        rows = rows.withColumn("_k", F.lit(1)).join(newest, "_k").where(F.col("time_ms") >= F.col("_newest") - range_ms).drop("_k", "_newest")
    return rows


def severity_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy(severity_label(F.col("severity_number")).alias("level")).agg(F.count("*").alias("n_logs"))


def newest_logs(logs: DataFrame, n: int) -> DataFrame:
    return logs.orderBy(F.desc("time_ms"), F.desc("seq")).limit(n)


def sort_logs(logs: DataFrame, column: Column, descending: bool = False) -> DataFrame:
    """Logs in order of a column of text or typed values: numbers (also as text), text, booleans, structured values; missing ones last both
    ways, ties by seq."""
    kind = logs.select(column.alias("v")).schema["v"].dataType.simpleString()
    key = typed.sort_key(typed.typed(column, kind))
    rows = logs.withColumn("_key", key)
    order = F.col("_key").desc() if descending else F.col("_key").asc()
    return rows.orderBy(F.col("_key.rank") == 4, order, "seq").drop("_key")


def log_attr_keys(logs: DataFrame) -> DataFrame:
    return logs.select(F.explode(F.map_keys("attrs")).alias("key")).distinct()


def log_counts(logs: DataFrame, *by: str) -> DataFrame:
    """Logs per trace (or other keys); those without a trace id are left out before they could gather on one key."""
    return logs.where(F.coalesce("trace_id", F.lit("")) != "").groupBy(*by).agg(F.count("*").alias("n_logs"))


def logs_for_trace(logs: DataFrame, trace_id: str, span_id: str | None = None, n: int = 100) -> DataFrame:
    """The newest n logs of a trace (or span), oldest first, and whether there were more."""
    rows = logs.where(F.col("trace_id") == trace_id)
    rows = rows if span_id is None else rows.where(F.col("span_id") == span_id)
    order = Window.partitionBy("trace_id").orderBy(F.desc("time_ms"), F.desc("seq"))
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("is_truncated", F.count("*").over(Window.partitionBy("trace_id")) > n)
    return rows.where(F.col("_n") <= n).drop("_n").orderBy("time_ms", "seq")


def attach_logs_to_spans(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Logs with a trace id beside their (deduped) span: before, within or after it, or of the trace only."""
    one = spans.select("trace_id", "span_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.lit(True).alias("_there"))
    rows = logs.where("trace_id is not null").join(one, ["trace_id", "span_id"], "left")
    place = F.when(F.col("_there").isNull(), "trace").when(F.col("time_ms") < F.col("_s"), "before").when(F.col("time_ms") > F.col("_e"), "after").otherwise("within")
    return rows.withColumn("place", place).withColumn("offset_ms", F.col("time_ms") - F.col("_s")).drop("_s", "_e", "_there")


#: Marks of a bar: buckets of the trace's duration in hundredths, doubled until a bar has so few of them.
BUCKET, MARKS = 0.5, 50


def log_markers(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """Logs grouped on their span's bar: trace_id, span_id, width, bucket, n_logs, pct, severity (highest), is_clamped.

    A log's place is a share in hundredths of its trace's duration, held within its span. Buckets are BUCKET wide; a bar with over MARKS of
    them takes buckets of twice the width, and so on. Logs are first counted by the narrowest, which wider ones are made of.
    """
    extents = spans.groupBy("trace_id").agg(F.min("start_ms").alias("_t0"), (F.max("end_ms") - F.min("start_ms")).alias("_total"))
    one = spans.select("trace_id", "span_id", F.col("start_ms").alias("_s"), "duration_ms").join(extents, "trace_id")
    rows = placed.where("place <> 'trace'").join(one, ["trace_id", "span_id"])
    held = F.least(F.greatest(F.col("duration_ms"), F.lit(0.0)), F.greatest(F.lit(0.0), F.col("offset_ms")))
    pct = F.when(F.col("_total") > 0, (F.col("_s") - F.col("_t0") + held) * 100 / F.col("_total")).otherwise(0.0)
    rows = rows.select("trace_id", "span_id", pct.alias("pct"), "severity_number", (held != F.col("offset_ms")).alias("is_clamped"))
    keys = ["trace_id", "span_id"]
    fine = rows.groupBy(*keys, F.floor(F.col("pct") / BUCKET).cast("int").alias("fine")).agg(F.count("*").alias("n"), F.sum("pct").alias("pct"), F.max("severity_number").alias("severity"), F.max("is_clamped").alias("is_clamped"))
    most = range(9)  # 0.5 * 2 ** 8 is over 100
    used = fine.groupBy(*keys).agg(F.collect_set("fine").alias("used"))  # 201 at most
    wide = lambda k: F.size(F.array_distinct(F.transform("used", lambda x: F.shiftright(x, k))))
    fits = F.coalesce(*(F.when(wide(k) <= MARKS, k) for k in most), F.lit(most[-1]))
    rows = fine.join(used.select(*keys, fits.alias("k")), keys).withColumn("bucket", F.expr("shiftright(fine, k)"))
    sums = rows.groupBy(*keys, "k", "bucket").agg(F.sum("n").alias("n_logs"), (F.sum("pct") / F.sum("n")).alias("pct"), F.max("severity").alias("severity"), F.max("is_clamped").alias("is_clamped"))
    return sums.select(*keys, (F.lit(BUCKET) * F.pow(F.lit(2.0), F.col("k"))).alias("width"), "bucket", "n_logs", "pct", "severity", "is_clamped")
