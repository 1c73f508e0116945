"""Log files of other kinds: JSON lines without a fixed schema, plain exports, CSV."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scalars import epoch_to_ms, severity_number

MAX_DEPTH = 8
MAX_FIELDS = 512

# Well-known fields, the first that a line has is taken.
FIELDS = {
    "time": ("timestamp", "@timestamp", "time", "ts", "datetime", "date"),
    "severity": ("severity", "level", "log.level", "loglevel", "severity.text", "severitytext", "lvl"),
    "body": ("message", "msg", "body", "log", "text", "event"),
    "service": ("service.name", "service", "app", "application", "logger"),
    "trace_id": ("trace.id", "traceid", "dd.trace.id"),
    "span_id": ("span.id", "spanid", "dd.span.id"),
}


def _flat(value, prefix: str, depth: int, out: dict[str, str]) -> None:
    for k, v in value.items():
        if len(out) >= MAX_FIELDS:
            return
        key = (f"{prefix}.{k}" if prefix else str(k)).lower().replace("_", ".").replace("-", ".")
        if isinstance(v, dict) and depth < MAX_DEPTH:
            _flat(v, key, depth + 1, out)
        elif v not in (None, "", {}, []):
            out.setdefault(key, v if isinstance(v, str) else json.dumps(v))


def _flatten(batches):
    for batch in batches:
        rows = []
        for line in batch.column("value").to_pylist():
            out: dict[str, str] | None = {}
            try:
                _flat(json.loads(line), "", 1, out)
            except (ValueError, AttributeError):
                out = None
            rows.append(None if out is None else list(out.items()))
        yield pa.record_batch({"value": batch.column("value"), "fields": pa.array(rows, pa.map_(pa.string(), pa.string()))})


def vendor_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Logs of JSON lines (value) without a schema, and the lines that are no JSON object.

    Nested objects become dotted keys; the well-known fields are picked by FIELDS, the other keys become attributes.
    """
    flat = lines.where(F.trim("value") != "").select("value").mapInArrow(_flatten, "value string, fields map<string,string>")
    pick = lambda k: F.coalesce(*(F.element_at("fields", n) for n in FIELDS[k]))
    used = [n for names in FIELDS.values() for n in names]
    attrs = F.map_filter("fields", lambda k, v: ~k.isin(*used))
    logs = flat.where("fields is not null").select(epoch_to_ms(pick("time")).alias("time_ms"), severity_number(F.coalesce(pick("severity"), F.lit("0"))).alias("severity_number"), pick("body").alias("body"), F.coalesce(pick("service"), F.lit("unknown_service")).alias("service"), pick("trace_id").alias("trace_id"), pick("span_id").alias("span_id"), attrs.alias("attrs"))
    return logs, flat.where("fields is null").select("value")


def read_vendor_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return vendor_lines(spark.read.text(path))


def read_plain_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs of an earlier plain export: one JSON array a file; times in milliseconds or ISO."""
    schema = "time string, severity string, body string, service string, trace_id string, span_id string, attrs map<string,string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(epoch_to_ms(F.col("time")).alias("time_ms"), severity_number(F.coalesce("severity", F.lit("0"))).alias("severity_number"), "body", "service", "trace_id", "span_id", "attrs")


def detect_log_format(spark: SparkSession, path: str) -> str:
    """otlp, plain or jsonl, from the first 20 lines."""
    head = [r["value"].strip() for r in spark.read.text(path).limit(20).collect()]
    if any('"resourceLogs"' in x or '"resourceSpans"' in x or '"resourceMetrics"' in x for x in head):
        return "otlp"
    return "plain" if head and head[0].startswith("[") else "jsonl"


def _guarded(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_table(logs: DataFrame, columns: list[str]) -> DataFrame:
    """The table that write_logs_csv writes: columns, then attr.<key> for every attribute key, as guarded text."""
    keys = [r["k"] for r in logs.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().orderBy("k").collect()]
    attrs = [_guarded(F.element_at("attrs", k)).alias(f"attr.{k}") for k in keys]
    return logs.select(*(_guarded(F.col(c).cast("string")).alias(c) for c in columns), *attrs)


def write_logs_csv(logs: DataFrame, path: str, columns: list[str]) -> None:
    csv_table(logs, columns).write.option("header", True).option("lineSep", "\r\n").csv(path)


def json_lines(logs: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(value): one JSON line for each log. Without columns all fields as they are, nulls left out; else {label: field} as a table
    shows them: each as text under its label, empty where null."""
    if columns is None:
        return logs.select(F.to_json(F.struct(*logs.columns)).alias("value"))
    return logs.select(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(label) for label, c in columns.items()))).alias("value"))


def write_logs_json(logs: DataFrame, path: str, columns: dict[str, str] | None = None) -> None:
    json_lines(logs, columns).write.text(path)


def save_baseline(entries: DataFrame, path: str) -> None:
    entries.write.parquet(path)


# The longest node id and operation key of a baseline, most samples of an entry.
MAX_NODE, MAX_OPERATION, MAX_SAMPLES = 2000, 200, 1000
_NODE, _TRACE = "^(svc|db|queue|ext):", "^[0-9a-f]{32}$"


def entry_faults(entries: DataFrame) -> DataFrame:
    """Entries with faults, the names of what is wrong with each: empty for a good one.

    target, source: no node, over MAX_NODE long, or (source) a node that is no entry's target of its own; operation: too long;
    errors: more than calls, or either negative; samples: out of order, too many, null or not finite; example: no trace id;
    key: it occurs twice (both rows have the fault).
    """
    nodes = entries.where("source is null and operation is null").select(F.col("target").alias("_node")).distinct().withColumn("_listed", F.lit(True))
    twice = entries.groupBy("source", "target", "operation").agg((F.count("*") > 1).alias("_twice")).where("_twice")
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("source", "target", "operation")]
    rows = entries.alias("l").join(twice.alias("r"), match[0] & match[1] & match[2], "left").select("l.*", "_twice")
    rows = rows.join(nodes, F.col("source") == F.col("_node"), "left")
    bad_node = lambda c: ~F.coalesce(F.col(c).rlike(_NODE) & (F.char_length(c) <= MAX_NODE), F.lit(False))
    broken = F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    example = lambda c: F.coalesce(~F.col(c).rlike(_TRACE), F.lit(False))
    checks = {
        "target": bad_node("target"),
        "source": F.col("source").isNotNull() & (bad_node("source") | F.col("_listed").isNull()),
        "operation": F.char_length("operation") > MAX_OPERATION,
        "errors": (F.col("n_errors") > F.col("n_calls")) | (F.least("n_errors", "n_calls") < 0) | F.col("n_calls").isNull(),
        "samples": broken | (F.size("samples") > MAX_SAMPLES) | (F.array_sort("samples") != F.col("samples")),
        "example": example("slowest") | example("last_error"),
        "key": F.col("_twice").isNotNull(),
    }
    named = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return rows.withColumn("faults", named).drop("_twice", "_node", "_listed")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a stored baseline. One with a fault (entry_faults) is an error that names the first few."""
    rows = spark.read.parquet(path)
    bad = entry_faults(rows).where(F.size("faults") > 0).select("source", "target", "operation", "faults").limit(5).collect()
    if bad:
        raise ValueError("faults in a baseline: " + "; ".join(f"{r['source']} -> {r['target']} {r['operation']}: {', '.join(r['faults'])}" for r in bad))
    return rows
