"""One trace beside others, changes by scope, faults of stored baselines, JSON sinks, and export requests as streams."""

from __future__ import annotations

import json
import statistics

import pytest
from pyspark.sql import functions as F

from tracelake.operators import baseline, traces, usage
from tracelake.sources import logfiles, otlp

SPAN = "trace_id string, span_id string, service string, name string, self_ms double, status_code string"
SUMMARY = "trace_id string, root_service string, root_name string, n_errors int, start_ms double, duration_ms double"


def compared(spark, groups, roots, **more):
    """groups: (trace, span, service, name, self, status); roots: (trace, errors, start, duration), all of one root."""
    summaries = spark.createDataFrame([(t, "web", "GET /", e, float(s), float(d)) for t, e, s, d in roots], SUMMARY)
    return traces.compare_trace(spark.createDataFrame(groups, SPAN), summaries, "t", **more).collect()


def plain(groups, peers):
    """The comparison written plainly: (service, name) to its row."""
    held = {t: {} for t in ["t", *peers]}
    for t, i, service, name, ms, status in groups:
        if t in held:
            g = held[t].setdefault((service, name), [0.0, 0, []])
            g[0], g[1], g[2] = g[0] + ms, g[1] + (status == "ERROR"), [*g[2], (-ms, i)]
    out = {}
    for key in {k for g in held.values() for k in g}:
        mine, theirs = held["t"].get(key), [held[p].get(key) for p in peers]
        median = statistics.median([g[0] if g else 0.0 for g in theirs]) if peers else 0.0
        state = "missing" if not mine else "both" if any(theirs) else "new"
        fails = bool(mine and mine[1] and not any(g and g[1] for g in theirs))
        out[key] = (mine[0] if mine else 0.0, median, state, mine[1] if mine else 0, fails, min(mine[2])[1] if mine else None)
    return out


def shown(rows):
    return {(r["service"], r["name"]): (r["self_ms"], r["median_ms"], r["state"], r["n_errors"], r["is_newly_failing"], r["top_span_id"]) for r in rows}


GROUPS = [
    ("t", "1", "web", "GET /", 10.0, "ERROR"), ("t", "2", "db", "SELECT", 50.0, "ERROR"), ("t", "4", "db", "SELECT", 60.0, "OK"), ("t", "3", "db", "SELECT", 60.0, None), ("t", "5", "new", "x", 3.0, "ERROR"),
    ("a", "1", "web", "GET /", 12.0, "ERROR"), ("a", "2", "db", "SELECT", 40.0, "OK"), ("a", "3", "gone", "y", 8.0, "OK"),
    ("b", "1", "web", "GET /", 14.0, "OK"), ("b", "2", "db", "SELECT", 44.0, "OK"), ("c", "1", "web", "GET /", 99.0, "OK"),
    ("other", "1", "new", "x", 1.0, "ERROR"),
]


def test_compare_trace(spark):
    roots = [("t", 2, 5, 120), ("a", 0, 4, 60), ("b", 0, 3, 70), ("c", 1, 9, 500)]
    rows = compared(spark, GROUPS, roots)
    assert shown(rows) == plain(GROUPS, ["a", "b"])  # c failed, and others did not
    assert [r["name"] for r in rows] == ["SELECT", "x", "GET /", "y"] and rows[1]["ratio"] is None and rows[0]["ratio"] == pytest.approx(170 / 42)
    assert shown(compared(spark, GROUPS, roots, peers=1)) == plain(GROUPS, ["a"])
    assert shown(compared(spark, GROUPS, roots, baseline_id="c")) == plain(GROUPS, ["c"])
    failed = [("t", 2, 5, 120), ("a", 1, 4, 60), ("c", 1, 9, 500)]
    assert shown(compared(spark, GROUPS, failed)) == plain(GROUPS, ["a", "c"])  # only failing ones: these are taken
    assert shown(compared(spark, GROUPS, [("t", 2, 5, 120)])) == plain(GROUPS, [])
    with pytest.raises(ValueError, match="own baseline"):
        compared(spark, GROUPS, roots, baseline_id="t")


def test_representative_peer(spark):
    summaries = spark.createDataFrame([(t, "web", "GET /", 0, float(k), float(d)) for k, (t, d) in enumerate([("t", 1), ("d", 10), ("c", 20), ("b", 30), ("a", 40)])], SUMMARY)
    row = traces.representative_peer(traces.comparison_peers(summaries, "t")).first()
    assert (row["trace_id"], row["baseline_ms"], row["n_peers"]) == ("b", 25.0, 4)  # b and c are as near
    assert traces.representative_peer(traces.comparison_peers(summaries.where("trace_id = 't'"), "t")).count() == 0


def test_changes_by_scope(spark):
    rows = [
        (None, "svc:a", None, "regressed", 100.0, 10.0, 5), (None, "svc:b", None, "regressed", 10.0, 5.0, 5), (None, "svc:c", None, "improved", 1.0, -9.0, 9), (None, "svc:d", None, "unchanged", 1.0, 0.0, 9),
        ("svc:a", "svc:b", None, "new", None, None, 7), ("svc:a", "svc:c", None, "removed", 5.0, None, None), ("svc:a", "svc:d", None, "new", None, None, 8), (None, "svc:a", "op", "regressed", 0.0, 0.2, 5), ("svc:a", "svc:b", "op", "insufficient", 5.0, 1.0, 5),
    ]
    df = spark.createDataFrame(rows, "source string, target string, operation string, verdict string, b_p95_ms double, p95_change double, a_n_calls long")
    names = lambda scope: [(r["target"], r["operation"]) for r in baseline.ranked_changes(df, 20, scope).collect()]
    assert names("services") == [("svc:b", None), ("svc:a", None), ("svc:c", None)]
    assert names("calls") == [("svc:d", None), ("svc:b", None), ("svc:c", None)]
    assert names("operations") == [("svc:a", "op")]
    assert names("all")[:4] == [("svc:b", None), ("svc:a", "op"), ("svc:a", None), ("svc:c", None)]
    assert {r["verdict"]: r["n_entries"] for r in baseline.comparison_summary(df, "operations").collect()} == {"regressed": 1, "insufficient": 1}


ENTRY = "source string, target string, operation string, n_calls long, n_errors long, p50_ms double, p95_ms double, slowest string, last_error string, is_truncated boolean, samples array<double>"
T = "0" * 31 + "1"


def entry(source=None, target="svc:a", operation=None, n_calls=2, n_errors=1, slowest=T, samples=(1.0, 2.0)):
    return (source, target, operation, n_calls, n_errors, 1.0, 2.0, slowest, None, False, list(samples))


def test_baseline_faults(spark, tmp_path):
    bad = {
        "target": entry(target="web"), "source": entry("svc:gone", "svc:b"), "operation": entry(operation="x" * 201), "errors": entry(target="svc:c", n_errors=3),
        "samples": entry(target="svc:d", samples=(2.0, 1.0)), "example": entry(target="svc:e", slowest="xyz"),
    }
    odd = [entry(target="svc:f", samples=(1.0, float("inf"))), entry(target="svc:g", samples=[1.0] * 1001), entry("svc:a", "db:x", "twice"), entry("svc:a", "db:x", "twice")]
    good = [entry(), entry("svc:a", "db:x"), entry("svc:a", "db:x", "op", 0, 0, None, ())]
    found = logfiles.entry_faults(spark.createDataFrame([*good, *bad.values(), *odd], ENTRY)).collect()
    by = {(r["source"], r["target"], r["operation"]): r["faults"] for r in found}
    assert len(found) == len(good) + len(bad) + len(odd)
    assert all(by[g[:3]] == [] for g in good) and all(by[b[:3]] == [name] for name, b in bad.items())
    assert by[None, "svc:f", None] == by[None, "svc:g", None] == ["samples"] and by["svc:a", "db:x", "twice"] == ["key"]
    logfiles.save_baseline(spark.createDataFrame(good, ENTRY), f"{tmp_path}/good")
    assert logfiles.load_baseline(spark, f"{tmp_path}/good").count() == 3
    logfiles.save_baseline(spark.createDataFrame([*good, bad["errors"]], ENTRY), f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="svc:c None: errors"):
        logfiles.load_baseline(spark, f"{tmp_path}/bad")


def test_json_lines(spark, tmp_path):
    logs = spark.createDataFrame([(1.5, 9, 'a "b"', None, {"k": "v"}), (2.0, 17, None, "s", {})], "time_ms double, severity_number int, body string, service string, attrs map<string,string>")
    read = lambda folder: sorted((json.loads(r["value"]) for r in spark.read.text(folder).collect()), key=str)
    logfiles.write_logs_json(logs, f"{tmp_path}/all")
    assert read(f"{tmp_path}/all") == sorted([{"time_ms": 1.5, "severity_number": 9, "body": 'a "b"', "attrs": {"k": "v"}}, {"time_ms": 2.0, "severity_number": 17, "service": "s", "attrs": {}}], key=str)
    logfiles.write_logs_json(logs, f"{tmp_path}/shown", {"Severity": "severity_number", "Body": "body"})
    assert read(f"{tmp_path}/shown") == [{"Severity": "17", "Body": ""}, {"Severity": "9", "Body": 'a "b"'}]


def test_top_patterns(spark):
    found = spark.createDataFrame([("a", "x <NUM>", 6, 60), ("a", "y" * 300, 3, 9), ("a", "(other)", 1, 4), ("b", "z", 3, 3)], "service string, template string, n_logs long, bytes long")
    rows = usage.top_patterns(found, 3).collect()
    assert [(r["service"], r["pattern"], r["n_logs"], r["share_pct"]) for r in rows] == [("a", "x <NUM>", 6, 60.0), ("a", "y" * 200 + "…", 3, 30.0), ("b", "z", 3, 100.0)]
    assert {r["pattern"] for r in usage.top_patterns(found).collect()} >= {"(other patterns)"}


def test_stream_otlp(spark, tmp_path):
    """Files that arrive in three batches give what a read of all of them gives, rejected lines too."""
    span = lambda i: {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "web"}}]}, "scopeSpans": [{"spans": [{"traceId": T, "spanId": f"{i:016x}", "name": f"n{i}", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000", "attributes": []}]}]}]}
    log = {"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "5000000", "severityNumber": 9, "body": {"stringValue": "hello"}, "attributes": []}]}]}]}
    point = {"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [{"timeUnixNano": "7000000", "asDouble": 1.5, "attributes": []}]}}]}]}]}
    folder = tmp_path / "in"
    folder.mkdir()
    for k, lines in enumerate([[span(1), "{broken"], [span(2), log, {"other": 1}], [point]]):
        (folder / f"{k}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    names = ("spans", "logs", "points", "rejected")
    keep = {"spans": ["trace_id", "span_id", "service", "name", "duration_ms"], "logs": ["time_ms", "body"], "points": ["metric", "time_ms", "value"], "rejected": ["value", "reason"]}
    whole = dict(zip(names, otlp.read_otlp_jsonl(spark, str(folder)), strict=True))
    for name, stream in zip(names, otlp.stream_otlp(spark, str(folder), files=1), strict=True):
        query = stream.select(*keep[name]).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state/{name}").trigger(availableNow=True).start(f"{tmp_path}/out/{name}")
        query.awaitTermination()
        assert len(query.recentProgress) >= 3
        got = spark.read.schema(whole[name].select(*keep[name]).schema).parquet(f"{tmp_path}/out/{name}")
        rows = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert rows(got) == rows(whole[name].select(*keep[name])) and got.count() == {"spans": 2, "logs": 1, "points": 1, "rejected": 2}[name]
