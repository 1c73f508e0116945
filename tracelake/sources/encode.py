"""Records as OTLP/JSON text: entries, their exact sizes, the framing around them, and saved sessions.

An entry's JSON is written by Spark and its size is that of the text, so escapes and number forms are right by construction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scalars import ms_to_nano
from tracelake.operators.usage import _framed, _text, attrs_bytes
from tracelake.sources import otlp

# Names and numbers of the format.
KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
CODES = ("UNSET", "OK", "ERROR")
PARTS = {"traces": ("resourceSpans", "scopeSpans", "spans"), "logs": ("resourceLogs", "scopeLogs", "logRecords"), "metrics": ("resourceMetrics", "scopeMetrics", "metrics")}
FORMAT, VERSION = "tracelake-session", 1
MAX_LINE = 4 << 20  # bytes of a session's line, unless one record has more
HELD = 32 << 20  # bytes of lines that a task has begun


def _number(names: tuple[str, ...], column: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, k))), F.col(column))


def _given(df: DataFrame, column: str, kind: str = "string") -> Column:
    """A column that df may lack."""
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def _nano(ms: Column) -> Column:
    return ms_to_nano(ms).cast("string")


def attributes(attrs: Column) -> Column:
    """Attribute list of a map of texts."""
    return F.transform(F.map_entries(F.coalesce(attrs, F.create_map().cast("map<string,string>"))), lambda e: F.named_struct(F.lit("key"), e["key"], F.lit("value"), F.named_struct(F.lit("stringValue"), e["value"])))


def _not_empty(c: Column) -> Column:
    return F.when(c != "", c)


def span_json(df: DataFrame) -> Column:
    event = lambda e: F.named_struct(F.lit("timeUnixNano"), _nano(e["time_ms"]), F.lit("name"), e["name"], F.lit("attributes"), attributes(e["attrs"]))
    link = lambda k: F.named_struct(F.lit("traceId"), k["trace_id"], F.lit("spanId"), k["span_id"], F.lit("traceState"), k["trace_state"], F.lit("attributes"), attributes(k["attrs"]))
    status = F.struct(_number(CODES, "status_code").alias("code"), _not_empty(_given(df, "status_message")).alias("message"))
    fields = [
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), _not_empty(F.col("parent_span_id")).alias("parentSpanId"), "name", _number(KINDS, "kind").alias("kind"),
        _nano(F.col("start_ms")).alias("startTimeUnixNano"), _nano(F.col("end_ms")).alias("endTimeUnixNano"), attributes(F.col("attrs")).alias("attributes"),
    ]
    fields += [F.transform("events", event).alias("events")] if "events" in df.columns else []
    fields += [F.transform("links", link).alias("links")] if "links" in df.columns else []
    return F.to_json(F.struct(*fields, status.alias("status")))


def log_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(
        _nano(F.col("time_ms")).alias("timeUnixNano"), F.col("severity_number").alias("severityNumber"), _not_empty(_given(df, "severity_text")).alias("severityText"),
        F.when(F.col("body").isNotNull(), F.struct(F.col("body").alias("stringValue"))).alias("body"), attributes(F.col("attrs")).alias("attributes"), F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
    ))


def point_json(df: DataFrame) -> Column:
    counts = F.transform(_given(df, "counts", "array<bigint>"), lambda c: c.cast("string"))
    return F.to_json(F.struct(
        attributes(F.col("attrs")).alias("attributes"), _nano(F.col("time_ms")).alias("timeUnixNano"), F.col("value").alias("asDouble"), _given(df, "count", "bigint").cast("string").alias("count"), _given(df, "sum", "double").alias("sum"),
        _given(df, "bounds", "array<double>").alias("explicitBounds"), counts.alias("bucketCounts"), _given(df, "quantiles", "array<struct<quantile:double,value:double>>").alias("quantileValues"),
    ))


def _resource(df: DataFrame) -> Column:
    """Resource attributes with the service's name and the instance's own id."""
    own = F.create_map(F.lit("service.name"), F.col("service"), F.lit("service.instance.id"), F.substring_index("instance_id", "::", -1))
    given = F.coalesce(_given(df, "resource_attrs", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(given, lambda k, v: ~k.isin("service.name", "service.instance.id")), own)


def entries(spans: DataFrame | None = None, logs: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """(signal, service, instance_id, resource, scope, metric, time_ms, entry): every record as JSON text.

    resource is JSON too. metric is that of a point, as the JSON before and after its points: name, unit and type.
    """
    parts = []
    for signal, df, time, text in (("traces", spans, "start_ms", span_json), ("logs", logs, "time_ms", log_json), ("metrics", points, "time_ms", point_json)):
        if df is not None:
            metric = F.lit(None).cast("string")
            if signal == "metrics":
                kind = F.when(F.col("type") == "exponential_histogram", "exponentialHistogram").otherwise(F.col("type"))
                flag = F.when(F.col("type") == "sum", F.concat(F.lit('"isMonotonic":'), F.coalesce(F.col("monotonic"), F.lit(False)).cast("string"), F.lit(","))).otherwise("")
                named = F.to_json(F.struct(F.col("metric").alias("name"), _not_empty(_given(df, "unit")).alias("unit")))
                metric = F.concat(F.expr("left(_named, length(_named) - 1)"), F.lit(',"'), kind, F.lit('":{'), flag, F.lit('"dataPoints":['))
                df = df.withColumn("_named", named)
            resource = F.to_json(F.struct(attributes(_resource(df)).alias("attributes")))
            scope = F.coalesce(_given(df, "scope"), F.lit(""))
            parts.append(df.select(F.lit(signal).alias("signal"), "service", "instance_id", resource.alias("resource"), scope.alias("scope"), metric.alias("metric"), F.col(time).cast("double").alias("time_ms"), text(df).alias("entry")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_GROUP = ["signal", "service", "instance_id", "resource", "scope"]


def _framing() -> tuple[Column, Column]:
    """What stands before and after a group's entries in a request of its own."""
    of = lambda k: F.element_at(F.create_map(*(F.lit(x) for s, p in PARTS.items() for x in (s, p[k]))), F.col("signal"))
    scope = F.when(F.col("scope") != "", F.to_json(F.struct(F.struct(F.col("scope").alias("name")).alias("scope")))).otherwise('{"scope":{}}')
    inner = F.concat(F.left(scope, F.char_length(scope) - 1), F.lit(',"'), of(2), F.lit('":['))
    metric = F.coalesce("metric", F.lit(""))
    before = F.concat(F.lit('{"'), of(0), F.lit('":[{"resource":'), F.col("resource"), F.lit(',"'), of(1), F.lit('":['), inner, metric)
    after = F.concat(F.when(metric != "", "]}}").otherwise(""), F.lit("]}]}]}"))
    return before, after


def _lines(max_line: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whole(key: tuple[str, str], texts: list[str]) -> str:
        return key[0] + ",".join(texts) + key[1]

    def made(lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[tuple[str, str], tuple[int, list[str]]] = {}  # bytes with a comma each, texts
        held = 0
        for batch in batches:
            before = batch.column("before").dictionary_encode()
            codes = before.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(before.dictionary)))
            entry, after = batch.column("entry").take(pa.array(order)), batch.column("after")
            sizes = pc.binary_length(entry).to_numpy().astype(np.int64) + 1
            for k, name in enumerate(before.dictionary.to_pylist()):
                at, end = int(ends[k - 1]) if k else 0, int(ends[k])
                key = (name, after[int(order[at])].as_py())
                room = max_line - len(key[0].encode()) - len(key[1].encode()) + 1
                texts, upto = entry.slice(at, end - at).to_pylist(), np.cumsum(sizes[at:end])
                taken, done = 0, 0
                size, line = begun.pop(key, (0, []))
                held -= size
                while taken < len(texts):
                    fit = int(np.searchsorted(upto, done + room - size, "right"))
                    if fit == taken and line:
                        yield made([whole(key, line)])
                        size, line = 0, []
                        continue
                    fit = max(fit, taken + 1)  # one that is too large has a line of its own
                    line = line + texts[taken:fit]
                    size, done, taken = size + int(upto[fit - 1]) - done, int(upto[fit - 1]), fit
                begun[key] = (size, line)
                held += size
            if held > HELD:
                yield made([whole(key, line) for key, (_, line) in begun.items()])
                begun, held = {}, 0
        if begun:
            yield made([whole(key, line) for key, (_, line) in begun.items()])

    return pack


def packed(rows: DataFrame, max_line: int = MAX_LINE, gather: bool = True) -> DataFrame:
    """Export requests as JSON text (value), each of max_line bytes at most unless a single record and its framing have more.

    Each task fills lines of one resource, scope (and metric) from its own rows as they come, so a trace or resource of any size is many
    lines, and no task holds more than HELD bytes of begun lines and one batch. With gather, rows of one resource, scope and metric come to
    one task first, so they have as few lines as they can; without it nothing is shuffled, and no task takes a whole resource.
    """
    rows = rows.repartition(*_GROUP, "metric") if gather else rows
    before, after = _framing()
    return rows.select(before.alias("before"), after.alias("after"), "entry").mapInArrow(_lines(max_line), "value string")


def write_session(path: str, spans: DataFrame | None = None, logs: DataFrame | None = None, points: DataFrame | None = None, max_line: int = MAX_LINE, compression: str = "none") -> None:
    """Save records of any of the signals as JSON lines: one with format and version, then export requests.

    compression is that of Spark's text files (gzip, lz4, ...), which read_session() knows by the files' names.
    """
    lines = packed(entries(spans, logs, points), max_line, gather=False)
    head = lines.sparkSession.range(1).select(F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"))).alias("value"))
    head.unionByName(lines).write.option("compression", compression).text(path)


def read_session(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Spans, logs, points and lines that are none of them, of a saved session or of plain export requests.

    A session saved by a newer version is an error.
    """
    head = spark.read.schema("format string, version int").json(path).where(F.col("format") == FORMAT)
    newest = head.agg(F.max("version")).first()[0]
    if newest is not None and newest > VERSION:
        raise ValueError(f"the session has version {newest}; this library reads up to {VERSION}")
    spans, logs, points, bad = otlp.read_otlp_jsonl(spark, path)
    return spans, logs, points, bad.where(F.coalesce(F.get_json_object("value", "$.format"), F.lit("")) != FORMAT)


def json_sizes(rows: DataFrame) -> DataFrame:
    """Per service and signal of entries(): records and the bytes of their JSON."""
    return rows.groupBy("service", "signal").agg(F.count("*").alias("n_records"), F.sum(F.octet_length("entry")).alias("json_bytes"))


def request_overhead(rows: DataFrame) -> DataFrame:
    """Per service and signal: n_requests (one for each resource), n_scopes, and the JSON bytes around the records, commas included.

    Two levels of groups: scopes (for points with their metrics) of a resource, then resources.
    """
    before, after = _framing()
    scope = F.when(F.col("scope") != "", F.to_json(F.struct(F.struct(F.col("scope").alias("name")).alias("scope")))).otherwise('{"scope":{}}')
    record = F.element_at(F.create_map(*(F.lit(x) for s, p in PARTS.items() for x in (s, len(p[2])))), F.col("signal"))
    metrics = rows.groupBy(*_GROUP, "metric").agg((F.count("*") - 1).alias("commas"))
    around = F.when(F.col("metric").isNotNull(), F.octet_length("metric") + 3).otherwise(0) + F.col("commas")
    scopes = metrics.groupBy(*_GROUP).agg((F.sum(around) + F.when(F.max("metric").isNotNull(), F.count("*") - 1).otherwise(0)).alias("inner"))
    scopes = scopes.withColumn("inner", F.col("inner") + F.octet_length(scope) + record + 6)  # ,"records":[]
    names = F.element_at(F.create_map(*(F.lit(x) for s, p in PARTS.items() for x in (s, len(p[0]) + len(p[1])))), F.col("signal"))
    resources = scopes.groupBy("signal", "service", "instance_id", "resource").agg(F.count("*").alias("n"), F.sum("inner").alias("inner"))
    size = F.col("inner") + F.col("n") - 1 + F.octet_length("resource") + names + len('{"":[{"resource":,"":[]}]}')
    return resources.groupBy("service", "signal").agg(F.count("*").alias("n_requests"), F.sum("n").alias("n_scopes"), F.sum(size).alias("json_bytes"))


def proto_overhead(records: DataFrame) -> DataFrame:
    """Per service and signal: the protobuf bytes around the records of (service, signal, instance_id, scope, resource_attrs, bytes)."""
    inner = records.groupBy("service", "signal", "instance_id", "scope", "resource_attrs").agg(F.sum("bytes").alias("held"))
    name = F.when(F.coalesce("scope", F.lit("")) != "", _framed(_text(F.col("scope")))).otherwise(0)
    inner = inner.withColumn("whole", _framed(name + F.col("held")))
    outer = inner.groupBy("service", "signal", "instance_id", "resource_attrs").agg(F.sum("whole").alias("whole"), F.sum("held").alias("held"))
    size = _framed(_framed(attrs_bytes(_resource(outer))) + F.col("whole")) - F.col("held")
    return outer.groupBy("service", "signal").agg(F.sum(size).cast("bigint").alias("proto_bytes"))
