"""Volume, cardinality and cost: bytes of records, attribute statistics, growth, findings, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.redact import REDACTED, is_sensitive_key, redact_text
from tracelake.functions.scalars import ID_CLASSES, classify_value, has_id_part
from tracelake.operators import templates
from tracelake.operators.ordered import running
from tracelake.operators.store import stored

DOMINANT_SHARE = 0.8


def _varint(n: Column) -> Column:
    return F.when(n < 128, 1).when(n < 16_384, 2).when(n < 2_097_152, 3).when(n < 268_435_456, 4).otherwise(5)


def _framed(n: Column) -> Column:
    """A length-delimited protobuf field of n bytes with a one-byte tag."""
    return F.lit(1) + _varint(n) + n


def _text(c: Column) -> Column:
    n = F.octet_length(F.coalesce(c, F.lit("")))
    return F.when(n > 0, _framed(n)).otherwise(0)


def attr_bytes(key: Column, value: Column) -> Column:
    """Protobuf bytes of one string attribute."""
    size = _framed(F.octet_length(value))
    return _framed(_framed(F.octet_length(key)) + _framed(size))


def attrs_bytes(attrs: Column) -> Column:
    return F.aggregate(F.map_entries(attrs), F.lit(0), lambda s, e: s + attr_bytes(e["key"], e["value"]))


def span_bytes() -> Column:
    """Protobuf bytes of a span row with text attributes, as an entry of its scope."""
    ids = F.lit(18 + 10) + F.when(F.coalesce("parent_span_id", F.lit("")) != "", 10).otherwise(0)
    kind = F.when(F.col("kind") == "UNSPECIFIED", 0).otherwise(2)
    status = F.when(F.col("status_code") == "UNSET", 0).otherwise(4)
    return _framed(_text(F.col("name")) + ids + kind + 18 + attrs_bytes(F.col("attrs")) + status).cast("bigint")


def log_bytes() -> Column:
    """Protobuf bytes of a log row with a text body and attributes."""
    ids = F.when(F.col("trace_id").isNotNull(), 18).otherwise(0) + F.when(F.col("span_id").isNotNull(), 10).otherwise(0)
    severity = F.when(F.col("severity_number") > 0, 2).otherwise(0)
    return _framed(F.lit(9) + severity + _framed(_framed(F.octet_length("body"))) + attrs_bytes(F.col("attrs")) + ids).cast("bigint")


def point_bytes() -> Column:
    return _framed(attrs_bytes(F.col("attrs")) + 9 + 9).cast("bigint")


def records(spans: DataFrame, logs: DataFrame, points: DataFrame) -> DataFrame:
    """(service, signal, scope, metric, time_ms, bytes, attrs) of all records of the three signals.

    metric is null but for points. Where spans have events, their attributes are one more column, events.
    """
    has = "events" in spans.columns
    none = F.array().cast("array<map<string,string>>")

    def part(df, signal, scope, time, size, metric, events=none):
        columns = ["service", F.lit(signal).alias("signal"), F.lit(scope).alias("scope"), metric.alias("metric"), F.col(time).alias("time_ms"), size.alias("bytes"), "attrs"]
        return df.select(*columns, *([events.alias("events")] if has else []))

    no_metric = F.lit(None).cast("string")
    events = F.coalesce(F.transform("events", lambda e: e["attrs"]), none) if has else none
    out = part(spans, "traces", "span", "end_ms", span_bytes(), no_metric, events).unionByName(part(logs, "logs", "log", "time_ms", log_bytes(), no_metric))
    return out.unionByName(part(points, "metrics", "metric", "time_ms", point_bytes(), F.col("metric")))


def volume(rows: DataFrame) -> DataFrame:
    """Records and bytes per service and signal, with totals (rollup)."""
    return rows.rollup("service", "signal").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n_records"), F.sum("bytes").alias("bytes"))


def volume_over_time(rows: DataFrame, n: int = 60, width_ms: int = 60_000) -> DataFrame:
    """Records and bytes per signal in the newest n buckets of a whole number of width_ms that fit all data; zeros stay."""
    ends = rows.agg(F.min("time_ms").alias("lo"), F.max("time_ms").alias("hi"))
    width = F.greatest(F.lit(1), F.ceil((F.floor(F.col("hi") / width_ms) - F.floor(F.col("lo") / width_ms) + 1) / n)) * width_ms
    ends = ends.where("lo is not null").select(width.cast("bigint").alias("width"), F.col("hi"), F.lit(1).alias("_k"))
    ends = ends.withColumn("last", F.floor(F.col("hi") / F.col("width")).cast("bigint"))
    placed = rows.withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k").withColumn("at", F.floor(F.col("time_ms") / F.col("width")).cast("bigint")).where(F.col("at") > F.col("last") - n)
    found = placed.groupBy("signal", "at").agg(F.count("*").alias("n_records"), F.sum("bytes").alias("bytes"))
    spine = ends.withColumn("at", F.explode(F.sequence(F.col("last") - n + 1, F.col("last")))).withColumn("signal", F.explode(F.array(*map(F.lit, ("traces", "logs", "metrics")))))
    return spine.join(found, ["signal", "at"], "left").select("signal", (F.col("at") * F.col("width")).alias("from_ms"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


def rates_per_minute(rows: DataFrame, window_ms: int = 15 * 60_000, width_ms: int = 60_000) -> DataFrame:
    """Records and bytes a minute of each signal over the newest window_ms, or over all data if that is less.

    The window begins with a whole bucket of width_ms and ends with the newest record; it counts as a minute at least.
    Signals without records there have rates of 0; without any records there are no rows.
    """
    ends = rows.agg(F.min("time_ms").alias("lo"), F.max("time_ms").alias("hi")).where("lo is not null")
    first = (F.floor(F.col("hi") / width_ms) - (window_ms // width_ms - 1)) * width_ms
    ends = ends.withColumn("from_ms", F.greatest("lo", first)).withColumn("minutes", F.greatest(F.lit(1.0), (F.col("hi") - F.col("from_ms")) / 60_000))
    ends = ends.withColumn("_k", F.lit(1))
    found = rows.withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k").where("time_ms >= from_ms")
    found = found.groupBy("signal").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    spine = ends.withColumn("signal", F.explode(F.array(*map(F.lit, ("traces", "logs", "metrics")))))
    rate = lambda c: F.coalesce(c, F.lit(0)) / F.col("minutes")
    return spine.join(found, "signal", "left").select("signal", "minutes", rate("n").alias("records_per_minute"), rate("b").alias("bytes_per_minute"))


#: What tells an attribute: the same key is apart in spans, their events, logs and each metric.
KEYS = ["service", "signal", "scope", "metric", "key"]


def counted(rows: DataFrame, *more: str) -> DataFrame:
    """(KEYS, value, n, bytes, first_ms, last_ms), stored: each distinct value, so that hot keys are split; and the records' own bytes,
    key null.

    One pass over the records serves values, statistics and totals. more are columns of rows to group by besides.
    """
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    own = F.coalesce(F.map_entries("attrs"), F.slice(whole, 2, 1))
    fixed = [*more, "service", "signal", "metric", "time_ms", "bytes"]
    each = rows.select(*fixed, "scope", F.explode(F.concat(whole, own)).alias("e")).select(*fixed, "scope", "e.key", "e.value")
    if "events" in rows.columns:
        inner = rows.where(F.size("events") > 0).select(*fixed, F.lit("span.event").alias("scope"), F.explode("events").alias("m"))
        each = each.unionByName(inner.select(*fixed, "scope", F.explode("m").alias("key", "value")))
    size = F.when(F.col("key").isNull(), F.col("bytes")).otherwise(attr_bytes(F.col("key"), F.col("value")))
    each = each.where("key is null or value is not null").withColumn("bytes", size)
    return stored(each.groupBy(*more, *KEYS, "value").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms")))


def values(rows: DataFrame) -> DataFrame:
    """(KEYS, value, n, bytes, first_ms): one row for each distinct value of each attribute."""
    return counted(rows).where("key is not null")


def attribute_stats(rows: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    """Per attribute (KEYS): distinct values, occurrences, bytes, ratio, share of the service's bytes of the signal, dominant class.

    counts is a table of counted(rows), if there is one already.
    """
    counts = counted(rows) if counts is None else counts
    vals = counts.where("key is not null")
    by_class = vals.withColumn("class", classify_value(F.col("value"))).groupBy(*KEYS, "class").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    stats = by_class.groupBy(*KEYS).agg(F.sum("k").alias("n_distinct"), F.sum("n").alias("occurrences"), F.sum("bytes").alias("bytes"), F.max(F.struct("k", "class")).alias("top"))
    dominant = F.when(F.col("top.k") >= DOMINANT_SHARE * F.col("n_distinct"), F.col("top.class"))
    rows = stats.join(signal_bytes(counts), ["service", "signal"])
    return rows.select(*KEYS, "n_distinct", "occurrences", "bytes", (F.col("n_distinct") / F.col("occurrences")).alias("ratio"), (F.col("bytes") / F.col("whole")).alias("share"), dominant.alias("class"))


def signal_bytes(counts: DataFrame) -> DataFrame:
    """(service, signal, whole): bytes of all records, of a table of counted()."""
    return counts.where("key is null").groupBy("service", "signal").agg(F.sum("bytes").alias("whole"))


def distinct_growth(vals: DataFrame, width_ms: int) -> DataFrame:
    """growing, saturated or insufficient per key: are new values still coming, by buckets of first appearance.

    With 4 or more closed buckets the last third's new values are compared with a half of the first third's.
    """
    keys = KEYS
    rows = vals.withColumn("at", F.floor(F.col("first_ms") / width_ms)).groupBy(*keys, "at").agg(F.count("*").alias("new"))
    ends = rows.groupBy(*keys).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    # Between the cumulative counts of n buckets lie n - 1 steps; the first bucket's own values are no step.
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}"))
    rows = rows.alias("r").join(ends.alias("e"), same).select("r.*", "lo", "hi").withColumn("steps", F.col("hi") - F.col("lo"))
    third = F.greatest(F.lit(1), F.floor(F.col("steps") / 3))
    step = F.col("at") - F.col("lo") - 1
    sums = rows.groupBy(*keys, "steps").agg(F.sum(F.when((step >= 0) & (step < third), F.col("new")).otherwise(0)).alias("first"), F.sum(F.when((step >= 0) & (step >= F.col("steps") - third), F.col("new")).otherwise(0)).alias("last"))
    growth = F.when(F.col("steps") < 3, "insufficient").when((F.col("last") > 0) & (F.col("last") >= 0.5 * F.col("first")), "growing").otherwise("saturated")
    return sums.select(*keys, growth.alias("growth"))


def span_name_stats(spans: DataFrame) -> DataFrame:
    """Distinct span names of each service and how many hold an id."""
    names = spans.select("service", "name").distinct()
    return names.groupBy("service").agg(F.count("*").alias("n_names"), F.count_if(has_id_part(F.col("name"))).alias("n_with_ids"))


def operation_stats(spans: DataFrame, n: int) -> DataFrame:
    """Spans, errors and bytes of each service's n most frequent names; the rest together as (other)."""
    sums = spans.groupBy("service", "name").agg(F.count("*").alias("n_spans"), F.count_if(F.col("status_code") == "ERROR").alias("n_errors"), F.sum(span_bytes()).alias("bytes"))
    order = Window.partitionBy("service").orderBy(F.desc("n_spans"), "name")
    named = sums.withColumn("name", F.when(F.row_number().over(order) <= n, F.col("name")).otherwise("(other)"))
    return named.groupBy("service", "name").agg(*(F.sum(c).alias(c) for c in ("n_spans", "n_errors", "bytes")))


def series_of(points: DataFrame) -> DataFrame:
    """A row for each series (metric, instance_id, labels in order): points, bytes, first_ms and last_ms; service kept where points have it."""
    own = ["service"] if "service" in points.columns else []
    keys = [*own, "metric", "instance_id", F.array_sort(F.map_entries("attrs")).alias("labels")]
    return points.groupBy(*keys).agg(F.count("*").alias("n_points"), F.sum(point_bytes()).alias("bytes"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))


def active_series(series: DataFrame, by: list[str], stale_ms: float = 300_000.0) -> DataFrame:
    """Per group: n_series, and peak_series, the most that were alive at once. A series lives from its first point to stale_ms after its last.

    Starts and ends are summed by time and swept in order, across partitions; ends count after starts of the same time.
    """
    ends = F.array(F.struct(F.col("first_ms").alias("at"), F.lit(0).alias("is_end")), F.struct((F.col("last_ms") + stale_ms).alias("at"), F.lit(1).alias("is_end")))
    events = series.select(*by, F.inline(ends)).groupBy(*by, "at", "is_end").agg(F.count("*").alias("n"))
    swept = running(events, by, ["at", "is_end"], alive=F.when(F.col("is_end") == 0, F.col("n")).otherwise(-F.col("n")))
    return swept.groupBy(*by).agg(F.sum(F.when(F.col("is_end") == 0, F.col("n")).otherwise(0)).alias("n_series"), F.max("alive").alias("peak_series"))


def metric_series_stats(points: DataFrame, stale_ms: float = 300_000.0) -> DataFrame:
    """Per metric: series, the most alive at once, and the label with the most distinct values (ties to the first by name)."""
    each = points.select("metric", F.explode("attrs").alias("label", "value")).groupBy("metric", "label").agg(F.count_distinct("value").alias("k"))
    driver = each.groupBy("metric").agg(F.min_by("label", F.struct(-F.col("k"), F.col("label"))).alias("driver"), F.max("k").alias("driver_distinct"))
    return active_series(series_of(points), ["metric"], stale_ms).join(driver, "metric", "left")


# Keys known to have many values, by what to do about them.
KEY_HINTS = {
    "url": ("url.full", "url.original", "url.path", "url.query", "http.url", "http.target"), "query": ("db.statement", "db.query.text"),
    "user": ("user.id", "user.email", "user.name", "user.full_name", "enduser.id", "enduser.pseudo.id", "session.id"),
    "address": ("client.address", "network.peer.address", "net.sock.peer.addr", "net.peer.ip", "http.client_ip"),
    "port": ("client.port", "network.peer.port", "net.sock.peer.port", "net.peer.port"),
    "message": ("messaging.message.id", "messaging.message.conversation_id", "request.id", "http.request.id", "gen_ai.response.id"),
    "exception": ("exception.message", "exception.stacktrace"), "agent": ("user_agent.original", "http.user_agent"),
    "destination": ("messaging.destination.name",), "trace": ("trace_id", "span_id", "traceId", "spanId"),
}


def remediation_hint(key: Column, value_class: Column) -> Column:
    """Which advice a key has by its name, else by its dominant class."""
    out = F.when(value_class.isin(*ID_CLASSES, "freeText"), value_class)
    for hint, keys in KEY_HINTS.items():
        out = F.when(key.isin(*keys), hint).otherwise(out)
    return out


#: Columns of a finding.
FINDING = ("rule", "severity", *KEYS, "n_distinct", "occurrences", "bytes", "share", "class", "growth", "driver", "hint")


def _finding(rows: DataFrame, rule: Column | str, level: Column, **more: Column) -> DataFrame:
    """Findings of FINDING's columns; level 0 info, 1 warning, 2 critical, one up where values are still growing."""
    rows = rows.withColumns(more)
    for c in FINDING:
        if c not in rows.columns and c not in ("rule", "severity"):
            rows = rows.withColumn(c, F.lit(0).cast("bigint") if c in ("n_distinct", "occurrences", "bytes") else F.lit(0.0) if c == "share" else F.lit(None).cast("string"))
    raised = F.least(F.lit(2), level + F.when(F.col("growth") == "growing", 1).otherwise(0))
    severity = F.when(raised == 2, "critical").when(raised == 1, "warning").otherwise("info")
    return rows.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), severity.alias("severity"), *FINDING[2:])


def attribute_findings(stats: DataFrame, growth: DataFrame, min_distinct: int = 100, min_ratio: float = 0.1, id_min: int = 20, critical: int = 10, critical_share: float = 0.2) -> DataFrame:
    """Of spans, their events and logs R1 (many values) and R2 (id-like); of metric labels R2 only, which is critical."""
    known = [k for keys in KEY_HINTS.values() for k in keys]
    point = F.col("scope") == "metric"
    high = ~point & (F.col("n_distinct") >= min_distinct) & (F.col("ratio") >= min_ratio)
    id_like = (F.coalesce(F.col("class").isin(*ID_CLASSES), F.lit(False)) | F.col("key").isin(*known)) & (F.col("n_distinct") >= id_min)
    same = F.lit(True)
    for k in KEYS:
        same &= F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}"))
    rows = stats.where(high | id_like).alias("s").join(growth.alias("g"), same, "left").select("s.*", "growth")
    level = F.when(point | (high & (F.col("n_distinct") >= critical * min_distinct) & (F.col("share") >= critical_share)), 2).otherwise(1)
    return _finding(rows, F.when(high, "R1").otherwise("R2"), level, hint=remediation_hint(F.col("key"), F.col("class")))


def series_findings(series: DataFrame, stats: DataFrame, counts: DataFrame, width_ms: int, max_series: int = 500, critical: int = 10) -> DataFrame:
    """R3: metrics of a service with too many series; the label with the most values drives them.

    series is series_of() with the service, stats attribute_stats(), counts counted(); growth is that of new series by buckets.
    """
    one = lambda v: F.lit(v).alias
    firsts = series.select("service", one("metrics")("signal"), F.lit(None).cast("string").alias("scope"), F.col("metric").alias("key"), F.lit(None).cast("string").alias("metric"), "first_ms")
    sums = series.groupBy("service", F.col("metric").alias("key")).agg(F.count("*").alias("n_distinct"), F.sum("n_points").alias("occurrences"), F.sum("bytes").alias("bytes"))
    sums = sums.where(F.col("n_distinct") >= max_series)
    growth = distinct_growth(firsts, width_ms).select("service", "key", "growth")
    top = F.min_by(F.struct("key", "class"), F.struct(-F.col("n_distinct"), F.col("key"))).alias("top")
    drivers = stats.where("scope = 'metric'").groupBy("service", F.col("metric").alias("_metric")).agg(top)
    rows = sums.join(growth, ["service", "key"], "left").withColumn("_metric", F.col("key")).join(drivers, ["service", "_metric"], "left")
    rows = rows.join(signal_bytes(counts).where("signal = 'metrics'"), "service", "left")
    level = F.when(F.col("n_distinct") >= critical * max_series, 2).otherwise(1)
    return _finding(rows, "R3", level, signal=F.lit("metrics"), driver=F.col("top.key"), share=F.col("bytes") / F.col("whole"), hint=remediation_hint(F.col("top.key"), F.col("top.class")))


def name_findings(names: DataFrame, max_names: int = 100, id_share: float = 0.2, least: int = 5, critical: int = 10) -> DataFrame:
    """R4: too many span names, or names that hold ids."""
    many = F.col("n_names") >= max_names
    ids = (F.col("n_names") >= least) & (F.col("n_with_ids") / F.col("n_names") >= id_share)
    rows = names.where(many | ids).select("service", F.col("n_names").alias("n_distinct"), F.col("n_with_ids").alias("occurrences"), F.when(ids, "pathId").alias("class"))
    level = F.when(F.col("n_distinct") >= critical * max_names, 2).otherwise(1)
    return _finding(rows, "R4", level, signal=F.lit("traces"), key=F.lit("span names"), growth=F.lit("insufficient"), hint=F.lit("route"))


def template_findings(templates: DataFrame, counts: DataFrame, share: float = 0.5, least: int = 100) -> DataFrame:
    """R6: a template (a row of log_templates) that makes up half of a service's logs or more, if there are enough of them."""
    whole = templates.groupBy("service").agg(F.sum("n_logs").alias("logs"))
    rows = templates.where("template <> '(other)'").join(whole, "service").where((F.col("logs") >= least) & (F.col("n_logs") >= share * F.col("logs")))
    rows = rows.select("service", F.col("template").alias("key"), F.lit(1).cast("bigint").alias("n_distinct"), F.col("n_logs").alias("occurrences"), "bytes")
    rows = rows.join(signal_bytes(counts).where("signal = 'logs'").select("service", "whole"), "service", "left")
    return _finding(rows, "R6", F.lit(0), signal=F.lit("logs"), growth=F.lit("insufficient"), share=F.col("bytes") / F.col("whole"), hint=F.lit("noisy"))


def findings(records_: DataFrame, spans: DataFrame, points: DataFrame, templates: DataFrame, width_ms: int, max_series: int = 500, **limits) -> DataFrame:
    """All findings of deduped spans, logs (by their templates) and points with their service, FINDING's columns."""
    counts = counted(records_)
    stats = stored(attribute_stats(None, counts))
    found = attribute_findings(stats, distinct_growth(counts.where("key is not null"), width_ms), **limits)
    found = found.unionByName(series_findings(stored(series_of(points)), stats, counts, width_ms, max_series))
    return found.unionByName(name_findings(span_name_stats(spans))).unionByName(template_findings(templates, counts))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per service, signal and severity with all totals (cube of signal and severity, of a service and of all)."""
    sets = [[c for k, c in enumerate(("service", "signal", "severity")) if bits >> k & 1] for bits in range(8)]
    counts = findings.groupingSets([[F.col(c) for c in s] for s in sets], "service", "signal", "severity")
    return counts.agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n_findings"))


def noisy_services(findings: DataFrame) -> DataFrame:
    """Services by what is wrong with them: critical findings, then warnings, then all, then name."""
    level = lambda s: F.count_if(F.col("severity") == s)
    sums = findings.groupBy("service").agg(level("critical").alias("n_critical"), level("warning").alias("n_warning"), F.count("*").alias("n_findings"))
    return sums.orderBy(F.desc("n_critical"), F.desc("n_warning"), F.desc("n_findings"), "service")


def top_services(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.groupBy("service").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_records")).orderBy(F.desc("bytes"), "service").limit(n)


def top_operations(spans: DataFrame, n: int = 10) -> DataFrame:
    """The n operations (service, name) of most bytes; ties to the first by service and name."""
    sums = spans.groupBy("service", "name").agg(F.sum(span_bytes()).alias("bytes"), F.count("*").alias("n_spans"))
    return sums.orderBy(F.desc("bytes"), "service", "name").limit(n)


def top_metrics(points: DataFrame, n: int = 10) -> DataFrame:
    """The n metrics of most series, then bytes; ties to the first by name. A series is first folded to one row."""
    series = points.groupBy("metric", "instance_id", F.array_sort(F.map_entries("attrs")).alias("a")).agg(F.sum(point_bytes()).alias("bytes"))
    sums = series.groupBy("metric").agg(F.count("*").alias("n_series"), F.sum("bytes").alias("bytes"))
    return sums.orderBy(F.desc("n_series"), F.desc("bytes"), "metric").limit(n)


def top_patterns(found: DataFrame, n: int = 5, chars: int = 200) -> DataFrame:
    """The n templates of most logs (rows of log_templates) with their share of their service's logs in percent.

    Ties to the first by service and text. What a service counts beyond its templates is one of them, as (other patterns);
    a longer pattern is cut.
    """
    whole = found.groupBy("service").agg(F.sum("n_logs").alias("_all"))
    text = F.when(F.col("template") == templates.OTHER, "(other patterns)").when(F.char_length("template") > chars, F.concat(F.left("template", F.lit(chars)), F.lit("…"))).otherwise(F.col("template"))
    top = found.orderBy(F.desc("n_logs"), "service", "template").limit(n)  # n rows, so whole is what is joined to them
    return top.join(whole, "service").select("service", text.alias("pattern"), "n_logs", "bytes", (F.col("n_logs") * 100 / F.col("_all")).alias("share_pct")).orderBy(F.desc("n_logs"), "service", "pattern")


def daily_usage(rates: DataFrame, points: DataFrame) -> DataFrame:
    """One row of bytes, n_spans, n_logs a day at the rates of rates_per_minute, and n_series, all series of points."""
    of = lambda signal: F.coalesce(F.sum(F.when(F.col("signal") == signal, F.col("records_per_minute"))), F.lit(0.0)) * 1440
    day = rates.agg((F.coalesce(F.sum("bytes_per_minute"), F.lit(0.0)) * 1440).alias("bytes"), of("traces").alias("n_spans"), of("logs").alias("n_logs"), F.lit(1).alias("_k"))
    series = points.select("metric", "instance_id", F.array_sort(F.map_entries("attrs")).alias("a")).distinct().agg(F.count("*").alias("n_series"), F.lit(1).alias("_k"))
    return day.join(F.broadcast(series), "_k").drop("_k")


def estimate_cost(
    daily: DataFrame, per_gb: float | None = None, per_million_spans: float | None = None, per_million_logs: float | None = None, days: float = 30.0,
    multiplier: float = 1.0, per_series: float | None = None, per_gb_retained: float | None = None, retention_days: float | None = None,
) -> DataFrame:
    """Monthly cost lines (item, quantity, monthly) and their total from a row of bytes, n_spans, n_logs and n_series a day.

    Only items with a price have a line; retention needs its days too. The multiplier is of traffic and leaves series
    as they are, which only their price asks for. Without any line there are no rows.
    """
    gb = F.col("bytes") * multiplier / 1e9
    million = lambda c: F.col(c) * multiplier * days / 1e6
    items = [("ingest", lambda: gb * days, per_gb), ("spans", lambda: million("n_spans"), per_million_spans), ("logs", lambda: million("n_logs"), per_million_logs)]
    items.append(("series", lambda: F.col("n_series").cast("double"), per_series))
    items.append(("retention", lambda: gb * retention_days, None if retention_days is None else per_gb_retained))
    line = lambda item, q, price: F.struct(F.lit(item).alias("item"), q.alias("quantity"), (q * price).alias("monthly"))
    lines = F.array(*(line(item, q(), price) for item, q, price in items if price is not None))
    if all(price is None for *_, price in items):
        return daily.select(F.lit("").alias("item"), F.lit(0.0).alias("quantity"), F.lit(0.0).alias("monthly")).where("false")
    total = F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["monthly"])
    return daily.select(F.inline(F.concat(lines, F.array(F.struct(F.lit("total").alias("item"), F.lit(None).cast("double").alias("quantity"), total.alias("monthly"))))))


def compare_usage(before: DataFrame, after: DataFrame, grown: float = 2.0, least: int = 20) -> DataFrame:
    """Keys (service, signal, key, n_distinct) that are new, grown (twice and by a minimum) or resolved; others are left out."""
    keys = ["service", "signal", "key"]
    old, new = (df.select(*keys, F.col("n_distinct").alias(c)) for df, c in ((before, "n_before"), (after, "n_after")))
    both = old.join(new, keys, "full_outer")
    change = F.when(F.col("n_before").isNull(), "new").when(F.col("n_after").isNull(), "resolved").when((F.col("n_after") >= grown * F.col("n_before")) & (F.col("n_after") >= least), "grown")
    return both.withColumn("change", change).where("change is not null")


def sample_values(vals: DataFrame, n: int = 3, size: int = 120) -> DataFrame:
    """The first n distinct values of each key by time of first appearance, then text; masked, cut to size signs."""
    order = Window.partitionBy(*KEYS).orderBy("first_ms", "value")
    rows = vals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    safe = F.when(is_sensitive_key(F.col("key")), F.lit(REDACTED)).otherwise(redact_text(F.col("value")))
    return rows.select(*KEYS, "rank", F.left(safe, F.lit(size)).alias("sample"))
