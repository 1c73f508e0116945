"""Spans and traces: dedupe, summaries, search, trees, self time, groups.

Spans have trace_id, span_id, parent_span_id, service, instance_id, name, kind, start_ms, end_ms, duration_ms,
status_code, attrs. Everything here is keyed by trace_id first, so one clustering by trace serves all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.ordered import quantiles
from tracelake.operators.store import stored

#: Order in which one copy of a re-exported span wins: the greatest end, then fixed columns.
_COPY_ORDER = ("end_ms", "start_ms", "service", "name", "kind", "status_code")


def _best_copy():
    return Window.partitionBy("trace_id", "span_id").orderBy(*(F.col(c).desc_nulls_last() for c in _COPY_ORDER))


def dedupe_spans(spans: DataFrame) -> DataFrame:
    """One row for each (trace_id, span_id): the copy that ends last. Spans without ids are dropped."""
    known = spans.where((F.coalesce("trace_id", F.lit("")) != "") & (F.coalesce("span_id", F.lit("")) != ""))
    return known.withColumn("_n", F.row_number().over(_best_copy())).where("_n = 1").drop("_n")


def has_parent(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def trace_summaries(spans: DataFrame) -> DataFrame:
    """Per trace: root, start, end, duration, distinct spans, errors, services.

    Extents come from all copies, the rest from deduped spans. Root: no parent first, then parent not in the
    trace, then any; within a rank the earliest start, then the smallest id.
    """
    copies = Window.partitionBy("trace_id", "span_id")
    rows = spans.select("trace_id", "span_id", "parent_span_id", "start_ms", "end_ms", "service", "name", "kind", "status_code", "attrs")
    rows = rows.withColumns({"_lo": F.min("start_ms").over(copies), "_hi": F.max("end_ms").over(copies), "_n": F.row_number().over(_best_copy())})
    # Rows without a span id count for the extents only.
    rows = stored(rows.where("_n = 1 and coalesce(trace_id, '') <> ''").drop("_n", "kind", "end_ms"))
    extent = rows.groupBy("trace_id").agg(F.min("_lo").alias("start_ms"), F.max("_hi").alias("end_ms"))
    one = rows.where("coalesce(span_id, '') <> ''").drop("_lo", "_hi")
    parents = one.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_there"))
    one = one.join(parents, ["trace_id", "parent_span_id"], "left")
    rank = F.when(~has_parent(F.col("parent_span_id")), 0).when(F.col("_there").isNull(), 1).otherwise(2)
    root = F.min_by(F.struct("span_id", "name", "service", "attrs"), F.struct(rank, "start_ms", "span_id"))
    found = one.groupBy("trace_id").agg(
        root.alias("root"), F.count("*").alias("n_spans"), F.count_if(F.col("status_code") == "ERROR").alias("n_errors"),
        F.array_sort(F.collect_set("service")).alias("services"),
    )
    found = found.join(extent, "trace_id")
    return found.select(
        "trace_id", F.col("root.span_id").alias("root_span_id"), F.col("root.name").alias("root_name"), F.col("root.service").alias("root_service"), F.col("root.attrs").alias("root_attrs"),
        "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_spans", "n_errors", "services",
    )


def search_traces(summaries: DataFrame, sort: str = "recent", limit: int = 20, since_ms: float | None = None) -> DataFrame:
    """The first traces by start, duration or errors, ties by trace id."""
    key = {"recent": "start_ms", "duration": "duration_ms", "errors": "n_errors"}[sort]
    if since_ms is not None:
        summaries = summaries.where(F.col("start_ms") >= since_ms)
    return summaries.orderBy(F.desc(key), "trace_id").limit(limit)


def _durations(column: str) -> list[Column]:
    return [F.percentile(column, F.lit(0.5)).alias("p50_ms"), F.percentile(column, F.lit(0.95)).alias("p95_ms")]


def trace_stats(summaries: DataFrame, *by: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Traces, failing traces, their share, and quantiles of the duration, of all or of each group."""
    errors = F.count_if(F.col("n_errors") > 0)
    return summaries.groupBy(*by).agg(F.count("*").alias("n_traces"), errors.alias("n_failing"), (errors / F.count("*")).alias("error_rate"), *_durations("duration_ms"), F.max("duration_ms").alias("max_ms"), *more)


def group_traces(summaries: DataFrame, key: Column) -> DataFrame:
    """Statistics and an example of each value of key: the slowest failing trace, else the slowest."""
    order = F.struct(F.col("n_errors") > 0, F.col("duration_ms"), F.col("trace_id"))
    return trace_stats(summaries.withColumn("key", key), "key", more=(F.max_by("trace_id", order).alias("example"),))


def traces_over_time(summaries: DataFrame, n: int = 12) -> DataFrame:
    """Traces and failing traces in n equal buckets from the first start to the last; empty buckets stay."""
    # One row, so it may go to every task.
    lo_hi = summaries.agg(F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n
    spine = lo_hi.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    place = F.when(width > 0, F.least(F.lit(n - 1), F.floor((F.col("start_ms") - F.col("lo")) / width))).otherwise(0).cast("int")
    counts = summaries.withColumn("_k", F.lit(1)).join(F.broadcast(lo_hi.withColumn("_k", F.lit(1))), "_k").groupBy(place.alias("bucket")).agg(F.count("*").alias("n_traces"), F.count_if(F.col("n_errors") > 0).alias("n_failing"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_traces", "n_failing")}
    return spine.join(counts, "bucket", "left").select("bucket", (F.col("lo") + F.col("bucket") * width).alias("from_ms"), "n_traces", "n_failing").withColumns(zero)


def children(spans: DataFrame) -> DataFrame:
    """(trace_id, parent_span_id, span_id) of deduped spans whose parent is in the trace."""
    one = stored(dedupe_spans(spans).select("trace_id", "span_id", "parent_span_id"))
    up = one.select("trace_id", F.col("span_id").alias("parent_span_id"))
    return one.select("trace_id", "parent_span_id", "span_id").where("parent_span_id <> span_id").join(up, ["trace_id", "parent_span_id"], "left_semi")


def self_times(spans: DataFrame) -> DataFrame:
    """Deduped spans with self_ms: the duration less the union of the children's intervals within the span.

    The union needs no loop: with children in order of start, each adds what lies beyond the furthest end before it.
    """
    one = stored(dedupe_spans(spans))  # read three times
    parent = one.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("start_ms").alias("_ps"), F.col("end_ms").alias("_pe"))
    kids = one.where("parent_span_id <> span_id").select("trace_id", "parent_span_id", "span_id", "start_ms", "end_ms").join(parent, ["trace_id", "parent_span_id"])
    kids = kids.select("trace_id", "parent_span_id", "span_id", F.greatest("start_ms", "_ps").alias("s"), F.least("end_ms", "_pe").alias("e")).where("e > s")
    before = Window.partitionBy("trace_id", "parent_span_id").orderBy("s", "e", "span_id").rowsBetween(Window.unboundedPreceding, -1)
    kids = kids.withColumn("far", F.max("e").over(before))
    covered = kids.groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum(F.greatest(F.lit(0.0), F.col("e") - F.greatest(F.col("s"), F.coalesce("far", "s")))).alias("_covered"))
    return one.join(covered, ["trace_id", "span_id"], "left").withColumn("self_ms", F.greatest(F.lit(0.0), F.col("duration_ms") - F.coalesce("_covered", F.lit(0.0)))).drop("_covered")


def group_spans(spans_with_self: DataFrame, *by: str) -> DataFrame:
    """Per group of spans: count, errors, total self time and its share, quantiles of the duration, the slowest example."""
    stats = spans_with_self.groupBy(*by).agg(
        F.count("*").alias("n_spans"), F.count_if(F.col("status_code") == "ERROR").alias("n_errors"), F.sum("self_ms").alias("self_ms"), *_durations("duration_ms"),
        F.max_by("trace_id", F.struct(F.col("status_code") == "ERROR", "duration_ms", "trace_id")).alias("example"),
    )
    whole = F.sum("self_ms").over(Window.partitionBy())  # as many rows as there are groups
    return stats.withColumn("self_share", F.when(whole > 0, F.col("self_ms") / whole).otherwise(0.0))


def duration_quantiles(spans: DataFrame, *by: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Exact quantiles of the duration of each group, whatever a group holds: durations are counted, then summed in order across tasks.

    For groups too large for one task's memory; the statistics above hold a group's distinct durations in one.
    """
    return quantiles(spans, list(by), "duration_ms", shares or {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})


def find_spans(spans_with_self: DataFrame, condition: Column, min_ms: float = 0.0, sort: str = "duration_ms", limit: int = 50) -> DataFrame:
    return spans_with_self.where(condition & (F.col("duration_ms") >= min_ms)).orderBy(F.desc(sort), "trace_id", "span_id").limit(limit)


def time_per_service(spans_with_self: DataFrame) -> DataFrame:
    """Self time of each service in each trace and its share of the trace's self time."""
    sums = spans_with_self.groupBy("trace_id", "service").agg(F.sum("self_ms").alias("self_ms"), F.count("*").alias("n_spans"))
    whole = F.sum("self_ms").over(Window.partitionBy("trace_id"))
    return sums.withColumn("share", F.when(whole > 0, F.col("self_ms") / whole).otherwise(0.0))


def top_self_time(spans_with_self: DataFrame, n: int = 10) -> DataFrame:
    """The n spans of the most self time in each trace."""
    order = Window.partitionBy("trace_id").orderBy(F.desc("self_ms"), "span_id")
    return spans_with_self.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def newest_traces(summaries: DataFrame, n: int) -> DataFrame:
    return summaries.orderBy(F.desc("start_ms"), "trace_id").limit(n)


def root_attr_keys(summaries: DataFrame, limit: int = 200) -> DataFrame:
    """Distinct attribute keys of root spans, in order."""
    return summaries.select(F.explode(F.map_keys("root_attrs")).alias("key")).distinct().orderBy("key").limit(limit)


def resolve_trace_prefix(spans: DataFrame, prefix: str) -> DataFrame:
    """Up to 6 trace ids that begin with prefix: one is the answer, more are ambiguous."""
    return spans.where(F.col("trace_id").startswith(prefix.lower())).select("trace_id").distinct().orderBy("trace_id").limit(6)


def filter_traces(spans: DataFrame, summaries: DataFrame, on_span: Column | None = None, on_trace: Column | None = None, words: tuple[str, ...] = ()) -> DataFrame:
    """Summaries of traces with one span that meets all of on_span, that meet on_trace, and hold each word in id or a span name."""
    checks = {f"_w{k}": F.bool_or(F.contains(F.lower("name"), F.lit(w.lower()))) for k, w in enumerate(words)}
    checks["_s"] = F.bool_or(F.lit(True) if on_span is None else F.coalesce(on_span, F.lit(False)))
    found = dedupe_spans(spans).groupBy("trace_id").agg(*(c.alias(n) for n, c in checks.items()))
    for k, w in enumerate(words):
        found = found.where(F.col(f"_w{k}") | F.contains("trace_id", F.lit(w.lower())))
    rows = summaries.join(found.where("_s").select("trace_id"), "trace_id", "left_semi")
    return rows if on_trace is None else rows.where(on_trace)


def trace_errors(spans: DataFrame) -> DataFrame:
    """Failing spans with up to 3 exception events and up to 10 distinct names of events."""
    rows = dedupe_spans(spans).where("status_code = 'ERROR'")
    exceptions = F.slice(F.filter("events", lambda e: e["name"] == "exception"), 1, 3)
    return rows.withColumn("exceptions", exceptions).withColumn("event_names", F.slice(F.array_sort(F.array_distinct(F.transform("events", lambda e: e["name"]))), 1, 10))


def linked_traces(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, linked_trace_id) of span links whose trace is there."""
    rows = dedupe_spans(spans).select("trace_id", "span_id", F.explode("links").alias("link")).select("trace_id", "span_id", F.col("link.trace_id").alias("linked_trace_id"))
    return rows.distinct().join(spans.select(F.col("trace_id").alias("linked_trace_id")).distinct(), "linked_trace_id", "left_semi")


def trace_list(summaries: DataFrame, log_counts: DataFrame, range_ms: float | None = None, attr_keys: tuple[str, ...] = ()) -> DataFrame:
    """Traces that start at most range_ms before the newest start, with n_logs and one column for each key of root attributes.

    log_counts has one row (trace_id, n_logs) for each trace with logs. Without range_ms all traces are listed. A root
    that lacks a key has null there.
    """
    rows = summaries
    if range_ms is not None:
        newest = summaries.agg(F.max("start_ms").alias("_newest")).withColumn("_k", F.lit(1))
        rows = rows.withColumn("_k", F.lit(1)).join(F.broadcast(newest), "_k").where(F.col("start_ms") >= F.col("_newest") - range_ms).drop("_k", "_newest")
    rows = rows.join(log_counts, "trace_id", "left").withColumn("n_logs", F.coalesce("n_logs", F.lit(0)))
    return rows.select("*", *(F.try_element_at("root_attrs", F.lit(k)).alias(k) for k in attr_keys))


# Beginnings of attribute keys that help to explain a span.
USEFUL = ("http.", "url.", "db.", "messaging.", "rpc.", "server.", "error.", "exception.", "gen_ai.operation", "gen_ai.request.model", "gen_ai.usage.", "gen_ai.tool.name")


def useful_attrs(attrs: Column, n: int = 10) -> Column:
    """Up to n attributes whose keys help to explain a span, in key order; contents of prompts are none of them."""
    keep = F.map_filter(attrs, lambda k, v: k.rlike("^(" + "|".join(p.replace(".", r"\.") for p in USEFUL) + ")"))
    return F.map_from_entries(F.slice(F.array_sort(F.map_entries(keep)), 1, n))


def comparison_peers(summaries: DataFrame, trace_id: str, peers: int = 50, baseline_id: str | None = None) -> DataFrame:
    """(trace_id, duration_ms) of what a trace is compared with: baseline_id alone, or the newest traces of the same root.

    Traces without errors are taken where there is one, those with errors only where there is none. At most peers rows.
    """
    if baseline_id is not None:
        if baseline_id == trace_id:
            raise ValueError("a trace is not its own baseline")
        return summaries.where(F.col("trace_id") == baseline_id).select("trace_id", "duration_ms")
    mine = summaries.where(F.col("trace_id") == trace_id).select(F.col("root_service").alias("_s"), F.col("root_name").alias("_n"))
    others = summaries.where(F.col("trace_id") != trace_id).join(F.broadcast(mine), (F.col("root_service") == F.col("_s")) & (F.col("root_name") == F.col("_n")))  # one row
    newest = others.orderBy(F.col("n_errors") > 0, F.desc("start_ms"), "trace_id").limit(peers).withColumn("_failed", F.col("n_errors") > 0)
    any_healthy = ~F.bool_and("_failed").over(Window.partitionBy(F.lit(1)))  # of at most peers rows
    return newest.withColumn("_healthy", any_healthy).where(~(F.col("_failed") & F.col("_healthy"))).select("trace_id", "duration_ms")


def representative_peer(peers: DataFrame) -> DataFrame:
    """One row of comparison_peers' rows: the trace whose duration is nearest to their median, ties to the smaller id.

    With the median as baseline_ms and n_peers. No row without peers.
    """
    middle = peers.agg(F.percentile("duration_ms", F.lit(0.5)).alias("baseline_ms"), F.count("*").alias("n_peers"))
    return peers.join(F.broadcast(middle)).orderBy(F.abs(F.col("duration_ms") - F.col("baseline_ms")), "trace_id").limit(1)  # middle is one row


def compare_trace(spans_with_self: DataFrame, summaries: DataFrame, trace_id: str, peers: int = 50, baseline_id: str | None = None) -> DataFrame:
    """Self time of one trace by service and name beside the median of comparison_peers, the largest excess first.

    A group that a peer lacks counts as 0 there. state: new (no peer has the group), missing (the trace lacks it) or both.
    is_newly_failing: the trace's group has failing spans (n_errors) and that of no peer has. top_span_id: the trace's
    span of most self time in the group, ties to the smaller id. ratio is null where the median is 0.
    """
    others = stored(comparison_peers(summaries, trace_id, peers, baseline_id).select("trace_id"))
    number = others.agg(F.count("*").alias("_peers")).withColumn("_k", F.lit(1))
    failed = F.count_if(F.coalesce(F.col("status_code") == "ERROR", F.lit(False)))
    groups = lambda df: df.groupBy("trace_id", "service", "name").agg(F.sum("self_ms").alias("self_ms"), failed.alias("n_errors"), F.min_by("span_id", F.struct(-F.col("self_ms"), "span_id")).alias("_top"))
    theirs = groups(spans_with_self.join(F.broadcast(others), "trace_id", "left_semi"))  # at most peers ids
    theirs = theirs.groupBy("service", "name").agg(F.array_sort(F.collect_list("self_ms")).alias("held"), F.sum("n_errors").alias("_failed"))  # at most peers values
    target = groups(spans_with_self.where(F.col("trace_id") == trace_id)).drop("trace_id")
    both = target.join(theirs, ["service", "name"], "full_outer").withColumn("_k", F.lit(1)).join(F.broadcast(number), "_k")
    held = F.coalesce("held", F.array().cast("array<double>"))
    padded = F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.col("_peers").cast("int") - F.size(held))), held)
    n = F.size(padded)
    middle = (F.get(padded, F.floor((n - 1) / 2).cast("int")) + F.get(padded, F.floor(n / 2).cast("int"))) / 2
    state = F.when(F.col("self_ms").isNull(), "missing").when(F.col("held").isNull(), "new").otherwise("both")
    failing = (F.coalesce("n_errors", F.lit(0)) > 0) & (F.coalesce("_failed", F.lit(0)) == 0)
    rows = both.select(
        "service", "name", F.coalesce("self_ms", F.lit(0.0)).alias("self_ms"), F.coalesce(middle, F.lit(0.0)).alias("median_ms"), state.alias("state"),
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"), failing.alias("is_newly_failing"), F.col("_top").alias("top_span_id"),
    )
    rows = rows.withColumn("excess_ms", F.col("self_ms") - F.col("median_ms")).withColumn("ratio", F.when(F.col("median_ms") > 0, F.col("self_ms") / F.col("median_ms")))
    return rows.orderBy(F.desc("excess_ms"), "service", "name")
