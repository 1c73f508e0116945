"""One trace explained: summary, critical path, self time, errors, services, bottleneck and logs, as rows of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.redact import redact_text
from tracelake.functions.scalars import severity_label, truncate_message
from tracelake.operators import tree
from tracelake.operators.logs import logs_for_trace
from tracelake.operators.store import stored
from tracelake.operators.traces import dedupe_spans, self_times, trace_summaries

TOP, MAX_LOGS, MAX_EXCEPTIONS = 10, 20, 3


def _rows(df: DataFrame, section: str, rank: Column, **columns: Column) -> DataFrame:
    kinds = {"span_id": "string", "service": "string", "name": "string", "duration_ms": "double", "self_ms": "double", "share": "double", "detail": "map<string,string>"}
    return df.select(F.lit(section).alias("section"), rank.cast("int").alias("rank"), *(columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def trace_detail(spans: DataFrame, trace_id: str, span_id: str | None = None, logs: DataFrame | None = None, steps: int = tree.STEPS) -> DataFrame:
    """Rows (section, rank, span_id, service, name, duration_ms, self_ms, share, detail) about one trace; none if it is not there.

    Sections: trace (one row: root, duration, detail with spans, errors, orphans, services, whether the path was cut); criticalPath (by
    step, share of the trace's duration); topSelfTime (10, share of the trace's duration); errors (the first 10 in depth-first order, with
    message, up to 3 exceptions and 10 names of events); byService (share of the self time); bottleneck (the path's span of most self
    time); logs (the newest 20, oldest first). With span_id all but trace are of that span's subtree, and the path starts there; detail
    of trace then has its spans. Texts come without secrets.
    """
    one = spans.where(F.col("trace_id") == trace_id)
    trees = tree.forest(one)
    places = tree.places(trees)
    full = stored(self_times(one).join(trees.select("span_id", "node", "depth", "is_orphan"), "span_id").join(places, "node"))
    scope = full
    if span_id is not None:
        top = full.where(F.col("span_id") == span_id).select(F.col("place").alias("_from"), F.col("last").alias("_to"))
        scope = full.join(F.broadcast(top), F.col("place").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")  # one row
    summary = stored(trace_summaries(one).join(full.groupBy("trace_id").agg(F.count_if("is_orphan").alias("orphans")), "trace_id"))
    total = summary.agg(F.max("duration_ms")).scalar()
    whole = scope.agg(F.sum("self_ms")).scalar()
    path = stored(tree.critical_path(one, steps, None if span_id is None else (trace_id, span_id), trees).drop("duration_ms").join(full, ["trace_id", "span_id"]))
    cut = path.agg(F.coalesce(F.max("truncated"), F.lit(False))).scalar()
    held = scope.agg(F.count("*")).scalar()

    text = lambda c: F.col(c).cast("string")
    pairs = {"start_ms": text("start_ms"), "spans": text("n_spans"), "errors": text("n_errors"), "orphans": text("orphans"), "services": F.array_join("services", ","), "path_truncated": cut.cast("string"), "scope_spans": held.cast("string")}
    detail = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v)))
    own = {c: F.col(c) for c in ("span_id", "service", "name", "duration_ms", "self_ms")}
    out = _rows(summary, "trace", F.lit(1), span_id=F.col("root_span_id"), service=F.col("root_service"), name=F.col("root_name"), duration_ms=F.col("duration_ms"), detail=detail)
    out = out.unionByName(_rows(path, "criticalPath", F.col("step") + 1, **own, share=_share(F.col("duration_ms"), total)))
    slow = scope.orderBy(F.desc("self_ms"), "span_id").limit(TOP)
    rank = F.row_number().over(Window.orderBy(F.desc("self_ms"), "span_id"))  # of TOP rows
    out = out.unionByName(_rows(slow.withColumn("rank", rank), "topSelfTime", F.col("rank"), **own, share=_share(F.col("self_ms"), total)))
    failed = scope.where("status_code = 'ERROR'").orderBy("place").limit(TOP)
    parts = {}
    if "status_message" in spans.columns:
        parts["message"] = redact_text(truncate_message(F.col("status_message")))
    if "events" in spans.columns:
        is_exception = lambda e: (e["name"] == "exception") | F.exists(F.map_keys(e["attrs"]), lambda k: k.startswith("exception."))
        kept = F.transform(F.slice(F.filter("events", is_exception), 1, MAX_EXCEPTIONS), lambda e: F.map_filter(e["attrs"], lambda k, v: k.startswith("exception.")))
        parts |= {"exceptions": redact_text(F.to_json(kept)), "events": redact_text(F.array_join(F.slice(F.array_distinct(F.transform("events", lambda e: e["name"])), 1, TOP), ","))}
    said = F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v))) if parts else F.lit(None)
    rank = F.row_number().over(Window.orderBy("place"))  # of TOP rows
    out = out.unionByName(_rows(failed.withColumn("rank", rank), "errors", F.col("rank"), **own, detail=said))
    services = scope.groupBy("service").agg(F.sum("self_ms").alias("self_ms"))
    rank = F.row_number().over(Window.orderBy(F.desc("self_ms"), "service"))  # as many rows as a trace has services
    out = out.unionByName(_rows(services.withColumn("rank", rank), "byService", F.col("rank"), service=F.col("service"), self_ms=F.col("self_ms"), share=_share(F.col("self_ms"), whole)))
    worst = path.orderBy(F.desc("self_ms"), "step").limit(1)
    out = out.unionByName(_rows(worst, "bottleneck", F.lit(1), **own, share=_share(F.col("self_ms"), total)))
    if logs is not None:
        some = logs_for_trace(logs, trace_id, span_id, MAX_LOGS)
        rank = F.row_number().over(Window.orderBy("time_ms", "seq"))  # of MAX_LOGS rows
        said = F.create_map(F.lit("time_ms"), text("time_ms"), F.lit("severity"), severity_label(F.col("severity_number")), F.lit("body"), redact_text(truncate_message(F.col("body"))), F.lit("truncated"), text("is_truncated"))
        out = out.unionByName(_rows(some.withColumn("rank", rank), "logs", F.col("rank"), span_id=F.col("span_id"), service=F.col("service"), detail=said))
    return out
