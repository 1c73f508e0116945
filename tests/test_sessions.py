"""Saved sessions of all signals: round trips, lines within a size, versions; sizes equal to the text's."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracelake.sources import encode, otlp

SPAN = "trace_id string, span_id string, parent_span_id string, service string, instance_id string, scope string, name string, kind string, start_ms double, end_ms double, status_code string, status_message string, attrs map<string,string>, events array<struct<time_ms:double,name:string,attrs:map<string,string>>>, links array<struct<trace_id:string,span_id:string,trace_state:string,attrs:map<string,string>>>"
LOG = "time_ms double, service string, instance_id string, scope string, severity_number int, severity_text string, body string, attrs map<string,string>, trace_id string, span_id string"
POINT = "metric string, unit string, type string, monotonic boolean, service string, instance_id string, time_ms double, value double, count long, sum double, bounds array<double>, counts array<long>, quantiles array<struct<quantile:double,value:double>>, attrs map<string,string>"
T, S = "0af7651916cd43dd8448eb211c80319c", "b7ad6b7169203331"


def tables(spark):
    spans = [(T, S, None, "a", "a::1", "lib", 'quote " \\ \n é 😀', "SERVER", 1_700_000_000_000.25, 1_700_000_000_007.5, "ERROR", "bad", {"k": "v", "n": None, "empty": ""}, [(1_700_000_000_001.0, "exception", {"exception.type": "E"})], [("1" * 32, "2" * 16, "st", {})])]
    spans += [(T, f"{k:016x}", S, "b", "b::2", None, f"op {k}", "CLIENT", 1_700_000_000_000.0 + k, 1_700_000_000_001.0 + k, "OK", None, {}, [], []) for k in range(1, 40)]
    logs = [(1_700_000_000_000.0 + k, "a", "a::1", ("lib", None)[k % 2], 9, "INFO", f"body {k} \t €", {"x": str(k)}, T, S) for k in range(20)] + [(1.0, "b", "b::2", None, 0, None, None, {}, None, None)]
    points = [("m.sum", "1", "sum", True, "a", "a::1", 1e12 + k, float(k), None, None, None, None, None, {"l": str(k)}) for k in range(5)]
    points += [("m.gauge", None, "gauge", None, "a", "a::1", 1e12, 0.5, None, None, None, None, None, {}), ("m.hist", "ms", "histogram", None, "b", "b::2", 1e12, None, 6, 12.5, [1.0, 2.0], [1, 2, 3], None, {}), ("m.q", None, "summary", None, "b", "b::2", 1e12, None, 6, 12.5, None, None, [(0.5, 2.0), (0.99, 3.0)], {})]
    return spark.createDataFrame(spans, SPAN), spark.createDataFrame(logs, LOG), spark.createDataFrame(points, POINT)


def rows(df, columns):
    return sorted(map(repr, (tuple(json.dumps(v, sort_keys=True, default=str) for v in r) for r in df.select(*columns).collect())))


def test_round_trip(spark, tmp_path):
    spans, logs, points = tables(spark)
    encode.write_session(str(tmp_path / "s"), spans, logs, points)
    s, g, p, bad = encode.read_session(spark, str(tmp_path / "s"))
    assert bad.count() == 0
    present = F.map_filter("attrs", lambda k, v: v.isNotNull()).alias("attrs")
    assert rows(s, [c for c in spans.columns if c != "attrs"]) == rows(spans, [c for c in spans.columns if c != "attrs"]) and rows(s, ["span_id", "attrs"]) == rows(spans, ["span_id", present])
    assert rows(g, logs.columns) == rows(logs, logs.columns)
    assert rows(p, points.columns) == rows(points, points.columns)


def test_a_large_trace_is_many_lines(spark, tmp_path):
    n = 100_000
    one = spark.range(n).select(F.lit(T).alias("trace_id"), F.lpad(F.hex("id"), 16, "0").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("svc").alias("service"), F.lit("svc::1").alias("instance_id"), F.concat(F.lit("op"), F.col("id") % 7).alias("name"),
                                F.lit("SERVER").alias("kind"), F.col("id").cast("double").alias("start_ms"), F.col("id").cast("double").alias("end_ms"), F.lit("UNSET").alias("status_code"), F.create_map(F.lit("pad"), F.repeat(F.lit("x"), (F.col("id") % 400).cast("int"))).alias("attrs"))
    big = one.limit(1).withColumn("attrs", F.create_map(F.lit("pad"), F.repeat(F.lit("y"), 100_000)))
    encode.write_session(str(tmp_path / "s"), one.where("start_ms > 0").unionByName(big), max_line=50_000)
    lines = spark.read.text(str(tmp_path / "s")).select(F.octet_length("value").alias("n"))
    sizes = sorted(r["n"] for r in lines.collect())
    assert sizes[-1] > 100_000 and sizes[-2] <= 50_000 and len(sizes) > 500
    assert encode.read_session(spark, str(tmp_path / "s"))[0].select("span_id").distinct().count() == n


def test_sizes(spark, tmp_path):
    """Records and what is around them add up to the requests' text, when each resource and signal is one request."""
    spans, logs, points = tables(spark)
    made = encode.entries(spans, logs, points)
    sizes = made.groupBy("signal").agg(F.sum(F.octet_length("entry")).alias("n")).collect()
    around = {r["signal"]: 0 for r in sizes}
    for r in encode.request_overhead(made).collect():
        around[r["signal"]] += r["json_bytes"]
    for signal, (resources, scopes, _) in encode.PARTS.items():
        whole: dict = {}
        for line in encode.packed(made.where(F.col("signal") == signal)).collect():
            part = json.loads(line["value"])[resources][0]
            kept = whole.setdefault(json.dumps(part["resource"]), part | {scopes: []})
            same = [s for s in kept[scopes] if s["scope"] == part[scopes][0]["scope"]]
            if signal == "metrics" and same:
                same[0]["metrics"] += part[scopes][0]["metrics"]
            else:
                kept[scopes] += part[scopes]
        text = [json.dumps({resources: [p]}, separators=(",", ":"), ensure_ascii=False) for p in whole.values()]
        if signal != "metrics":  # numbers are written otherwise by Python
            assert sum(len(t.encode()) for t in text) == around[signal] + next(r["n"] for r in sizes if r["signal"] == signal)


def test_newer_version(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"format": encode.FORMAT, "version": encode.VERSION + 1}) + "\n")
    with pytest.raises(ValueError, match="version"):
        encode.read_session(spark, str(tmp_path / "s.jsonl"))
    (tmp_path / "plain.jsonl").write_text('{"resourceSpans":[]}\nno json\n')
    assert [r["reason"] for r in encode.read_session(spark, str(tmp_path / "plain.jsonl"))[3].collect()] == ["no JSON"]
    assert otlp.read_otlp_spans(spark, str(tmp_path / "plain.jsonl")).count() == 0


def test_points_of_a_long_line_are_read_one_by_one(spark, tmp_path):
    """No column beside an exploded point holds its metric's other points: with them a line costs the square of its points."""
    encode.write_session(str(tmp_path / "s"), points=tables(spark)[2])
    plan = encode.read_session(spark, str(tmp_path / "s"))[2]._jdf.queryExecution().executedPlan().toString()
    exploded = [x for x in plan.split("\n") if "Generate explode" in x and "dataPoints" in x]
    assert len(exploded) == 1 and "_extract_gauge" in exploded[0]
    assert not any(f"_extract_{k}" in exploded[0][exploded[0].rindex("), [") :] for k in otlp._KINDS)


def test_a_session_is_written_without_a_shuffle(spark, tmp_path):
    """Each task fills lines from its own rows, whatever its batches hold; compressed files are read by their names."""
    at = F.col("id")
    rows = spark.range(30_000, numPartitions=2).select(F.lit(1e12).alias("time_ms"), F.concat(F.lit("s"), at % 3).alias("service"), F.concat(F.lit("s"), at % 3, F.lit("::1")).alias("instance_id"), F.lit(9).alias("severity_number"),
                                                       F.concat(F.repeat(F.lit("é"), (at % 100).cast("int")), at.cast("string")).alias("body"), F.create_map().cast("map<string,string>").alias("attrs"), F.lit(T).alias("trace_id"), F.lit(S).alias("span_id"))
    lines = encode.packed(encode.entries(logs=rows), 20_000, gather=False)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    sizes = sorted(r[0] for r in lines.select(F.octet_length("value")).collect())
    assert sizes[-1] <= 20_000 and sum(x > 19_000 for x in sizes) >= len(sizes) - 6
    encode.write_session(str(tmp_path / "s"), logs=rows, max_line=20_000, compression="gzip")
    assert all(x.name.endswith(".gz") for x in (tmp_path / "s").glob("part-*"))
    _, logs, _, bad = encode.read_session(spark, str(tmp_path / "s"))
    assert bad.count() == 0 and logs.count() == 30_000 and logs.select("service", "body").exceptAll(rows.select("service", "body")).count() == 0
