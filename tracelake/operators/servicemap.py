"""Service map: calls between services, nodes and edges with latency and errors, health, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.scalars import classify_target, operation_key, peer_of
from tracelake.operators.store import stored
from tracelake.operators.traces import dedupe_spans, has_parent

MIN_RATE_MS = 10_000
TYPE_ORDER = {"service": 0, "database": 1, "queue": 2, "external": 3}


#: Columns of calls() beside source, target and type; each is stored and shuffled only where it is asked for.
CALL_COLUMNS = ("trace_id", "span_id", "end_ms", "instance_id", "code_file", "code_line", "is_error", "operation", "ms")


def calls(spans: DataFrame, *columns: str) -> DataFrame:
    """One row for each call: into a service (source null, or the calling service), and to each classified target.

    An edge between services takes the parent's duration if the parent is a CLIENT or PRODUCER, else the span's own. columns: those of
    CALL_COLUMNS that are needed, all by default. What attributes say is worked out of them first, so they are not shuffled.
    """
    columns = columns or CALL_COLUMNS
    node, attrs = classify_target(F.col("kind"), F.col("attrs")), F.col("attrs")
    rows = spans.withColumns({"_node": node, "_op": operation_key(F.col("name"), attrs)}).withColumn("_peer", F.when(F.col("_node.type") == "external", peer_of(attrs)))
    own = [c for c in CALL_COLUMNS[2:6] if c in columns]
    one = dedupe_spans(rows.withColumns({"_id": F.col("_node.id"), "_type": F.col("_node.type")}).drop("attrs", "_node"))
    one = one.select("trace_id", "span_id", "parent_span_id", "service", "kind", "duration_ms", *own, *(["_op"] if "operation" in columns else []), (F.col("status_code") == "ERROR").alias("is_error"), "_id", "_type", "_peer")
    one = stored(one)  # read for peers, parents and calls
    # A peer that is a service is not external; spans without an external peer stay where they are.
    names = one.select(F.col("service").alias("_peer")).distinct().withColumn("_known", F.lit(True))
    target = F.when(F.col("_id").isNotNull(), F.struct(F.col("_id").alias("id"), F.col("_type").alias("type")))
    named = one.where("_peer is not null").join(names, "_peer", "left").withColumn("target", F.when(F.col("_known").isNull(), target)).drop("_known")
    known = one.where("_peer is null").withColumn("target", target).unionByName(named).drop("_peer", "_id", "_type")
    parent = one.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("p_service"), F.col("kind").alias("p_kind"), F.col("duration_ms").alias("p_ms"))
    rows = known.join(parent, ["trace_id", "parent_span_id"], "left")
    me, none = F.concat(F.lit("svc:"), F.col("service")), F.lit(None).cast("string")
    call = lambda source, target, kind, ms: F.struct(source.alias("source"), target.alias("target"), kind.alias("type"), ms.alias("ms"))
    crossing = F.col("p_service").isNotNull() & (F.col("p_service") != F.col("service"))
    waited = F.when(F.col("p_kind").isin("CLIENT", "PRODUCER"), F.col("p_ms")).otherwise(F.col("duration_ms"))
    service = F.lit("service")
    all_ = F.array(
        F.when(~has_parent(F.col("parent_span_id")) | crossing, call(none, me, service, F.col("duration_ms"))),
        F.when(crossing, call(F.concat(F.lit("svc:"), F.col("p_service")), me, service, waited)),
        F.when(F.col("target").isNotNull(), call(none, F.col("target.id"), F.col("target.type"), F.col("duration_ms"))),
        F.when(F.col("target").isNotNull(), call(me, F.col("target.id"), F.col("target.type"), F.col("duration_ms"))),
    )
    named = [F.col("_op").alias(c) if c == "operation" else F.col(c) for c in CALL_COLUMNS[:-1] if c in columns]
    rows = rows.select(*named, F.explode(F.filter(all_, lambda c: c.isNotNull())).alias("c"))
    return rows.select(*(c for c in CALL_COLUMNS[:-1] if c in columns), "c.source", "c.target", "c.type", *(["c.ms"] if "ms" in columns else []))


def service_graph(spans: DataFrame) -> DataFrame:
    """Edges with calls and failing calls: dependency calls, and parent to child across services."""
    return calls(spans, "is_error").where("source is not null").groupBy("source", "target").agg(F.count("*").alias("n_calls"), F.count_if("is_error").alias("n_errors"))


def window_bounds(spans: DataFrame, range_ms: float | None) -> DataFrame:
    """One row: anchor (newest end), oldest start, from, whether the range reaches back beyond the data, minutes for rates."""
    ends = spans.agg(F.max("end_ms").alias("anchor_ms"), F.min("end_ms").alias("oldest_ms"))
    start = F.lit(None).cast("double") if range_ms is None else F.col("anchor_ms") - range_ms
    since = F.greatest(F.coalesce(start, F.col("oldest_ms")), F.col("oldest_ms"))
    span = F.col("anchor_ms") - since
    return ends.select("anchor_ms", "oldest_ms", since.alias("from_ms"), F.coalesce(start < F.col("oldest_ms"), F.lit(False)).alias("is_partial"), F.when(span >= MIN_RATE_MS, span / 60_000).alias("minutes"))


def service_map(spans: DataFrame, range_ms: float | None = None) -> DataFrame:
    """Nodes (source null) and edges: calls, errors, rate, p50, p95, calls per minute, last seen.

    Which nodes and edges there are comes from all calls, the figures from those that end in the window.
    """
    # One row of bounds, joined on a constant, so it goes to every task.
    bounds = F.broadcast(window_bounds(spans, range_ms).withColumn("_k", F.lit(1)))
    rows = calls(spans, "end_ms", "is_error", "ms").withColumn("_k", F.lit(1)).join(bounds, "_k")
    inside = F.col("end_ms") >= F.col("from_ms")
    ms = F.when(inside, F.col("ms"))
    found = rows.groupBy("source", "target", "type").agg(
        F.count_if(inside).alias("n_calls"), F.count_if(inside & F.col("is_error")).alias("n_errors"),
        F.percentile(ms, F.lit(0.5)).alias("p50_ms"), F.percentile(ms, F.lit(0.95)).alias("p95_ms"), F.max("end_ms").alias("last_ms"), F.first("minutes").alias("minutes"),
    )
    rate = F.when(F.col("n_calls") > 0, F.col("n_errors") / F.col("n_calls"))
    return found.withColumn("error_rate", rate).withColumn("per_minute", F.col("n_calls") / F.col("minutes")).drop("minutes")


def health(n_calls: Column, error_rate: Column, p95_ms: Column, warn_rate: float = 0.01, bad_rate: float = 0.05, warn_ms: float = 500, bad_ms: float = 2000) -> Column:
    """idle, ok, warn or bad: the worse of error rate and p95; with fewer than 5 calls never worse than warn."""
    level = F.greatest(F.when(error_rate >= bad_rate, 2).when(error_rate >= warn_rate, 1).otherwise(0), F.when(p95_ms >= bad_ms, 2).when(p95_ms >= warn_ms, 1).otherwise(0))
    level = F.when(n_calls < 5, F.least(level, F.lit(1))).otherwise(level)
    return F.when(F.coalesce(n_calls, F.lit(0)) == 0, "idle").when(level == 2, "bad").when(level == 1, "warn").otherwise("ok")


def sparklines(spans: DataFrame, range_ms: float | None = None, n: int = 30) -> DataFrame:
    """Calls and errors of each node in n equal buckets of the window, zeros included."""
    bounds = F.broadcast(window_bounds(spans, range_ms).withColumn("_k", F.lit(1)))
    rows = calls(spans, "end_ms", "is_error").where("source is null").withColumn("_k", F.lit(1)).join(bounds, "_k").where("end_ms >= from_ms")
    width = (F.col("anchor_ms") - F.col("from_ms")) / n
    bucket = F.when(width > 0, F.least(F.lit(n - 1), F.floor((F.col("end_ms") - F.col("from_ms")) / width))).otherwise(0).cast("int")
    counts = rows.groupBy("target", bucket.alias("bucket")).agg(F.count("*").alias("n_calls"), F.count_if("is_error").alias("n_errors"))
    spine = counts.select("target").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spine.join(counts, ["target", "bucket"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_calls", "n_errors")})


def cap_nodes(nodes: DataFrame, limit: int = 250) -> DataFrame:
    """Nodes (target, type, n_calls, last_ms) with is_hidden: of the dependencies, the least called beyond limit nodes."""
    order = Window.orderBy(F.when(F.col("type") == "service", 0).otherwise(1), F.desc("n_calls"), F.desc("last_ms"), "target")  # nodes are few
    return nodes.withColumn("is_hidden", (F.row_number().over(order) > limit) & (F.col("type") != "service"))


def node_operations(spans: DataFrame, n: int = 10) -> DataFrame:
    """The n most called operations of every node, with errors and p95."""
    rows = calls(spans, "is_error", "operation", "ms").where("source is null").groupBy("target", "operation").agg(F.count("*").alias("n_calls"), F.count_if("is_error").alias("n_errors"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"))
    order = Window.partitionBy("target").orderBy(F.desc("n_calls"), "operation")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def node_traces(spans: DataFrame, n: int = 5) -> DataFrame:
    """For every node its n newest failing traces and n slowest traces, each trace once a list."""
    rows = calls(spans, "trace_id", "end_ms", "is_error", "ms").where("source is null").groupBy("target", "trace_id").agg(F.max("ms").alias("ms"), F.max(F.when(F.col("is_error"), F.col("end_ms"))).alias("failed_ms"))
    by = lambda c: Window.partitionBy("target").orderBy(F.desc_nulls_last(c), "trace_id")
    failing = rows.where("failed_ms is not null").withColumn("rank", F.row_number().over(by("failed_ms"))).withColumn("list", F.lit("failing"))
    slow = rows.withColumn("rank", F.row_number().over(by("ms"))).withColumn("list", F.lit("slowest"))
    return failing.unionByName(slow).where(F.col("rank") <= n).select("target", "list", "rank", "trace_id", "ms")


def node_sources(spans: DataFrame, n: int = 10) -> DataFrame:
    """The n source lines that most calls of every node come from."""
    rows = calls(spans, "code_file", "code_line").where("source is null and code_file is not null").groupBy("target", "code_file", "code_line").agg(F.count("*").alias("n_calls"))
    order = Window.partitionBy("target").orderBy(F.desc("n_calls"), "code_file", "code_line")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def node_edges(spans: DataFrame) -> DataFrame:
    """For every node its edges in and out: target, way (inbound, outbound), peer, calls, errors, p95; the peer's calls count."""
    edges = calls(spans, "is_error", "ms").where("source is not null").groupBy("source", "target").agg(F.count("*").alias("n_calls"), F.count_if("is_error").alias("n_errors"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"))
    numbers = ("n_calls", "n_errors", "p95_ms")
    both = F.array(F.struct(F.col("target").alias("node"), F.lit("inbound").alias("way"), F.col("source").alias("peer")), F.struct(F.col("source").alias("node"), F.lit("outbound").alias("way"), F.col("target").alias("peer")))
    return edges.select(F.inline(both), *numbers).withColumnRenamed("node", "target")


def node_instances(spans: DataFrame) -> DataFrame:
    """Of every service the instances that took its calls: target, instance_id, calls, errors, last seen."""
    rows = calls(spans, "end_ms", "instance_id", "is_error").where("source is null and type = 'service'")
    return rows.groupBy("target", "instance_id").agg(F.count("*").alias("n_calls"), F.count_if("is_error").alias("n_errors"), F.max("end_ms").alias("last_ms"))
