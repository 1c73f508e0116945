"""Typed values from decode on: kinds, numbers, lists and maps within each other, the last of a key."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tracelake.functions import typed
from tracelake.operators import logs as log_ops
from tracelake.operators import templates
from tracelake.sources import otlp


def value(v):
    if isinstance(v, bool):
        return {"boolValue": v}
    if isinstance(v, int):
        return {"intValue": str(v)}
    if isinstance(v, float):
        return {"doubleValue": v}
    if isinstance(v, str):
        return {"stringValue": v}
    if isinstance(v, list):
        return {"arrayValue": {"values": [value(x) for x in v]}}
    return {"kvlistValue": {"values": [{"key": k, "value": value(x)} for k, x in v.items()]}}


BODIES = ["text 5", 7, 2.5, True, [1, "a", [False]], {"b": 1, "a": {"c": [1.5, "e"]}}, "10", {}, []]


def read(spark, folder):
    records = [{"timeUnixNano": str(k), "body": value(b), "attributes": [{"key": "v", "value": value("old")}, {"key": "v", "value": value(b)}, {"key": "none", "value": {}}]} for k, b in enumerate(BODIES)]
    records.append({"timeUnixNano": "99"})
    line = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": value("s")}]}, "scopeLogs": [{"logRecords": records}]}]}
    (folder / "x.jsonl").write_text(json.dumps(line) + "\n")
    return otlp.read_otlp_logs(spark, str(folder / "x.jsonl"))


def test_decoded_values(spark, tmp_path):
    rows = read(spark, tmp_path).orderBy("time_ms").select(F.to_json("body_value").alias("b"), F.to_json(F.element_at("attr_values", "v")).alias("v"), typed.kind(F.col("body_value")).alias("kind"), typed.attr_number(F.col("attr_values"), "v").alias("n"), typed.attr_text(F.col("attr_values"), "v").alias("t"), typed.body_text(F.col("body_value")).alias("shown")).collect()
    assert [json.loads(r["b"]) for r in rows[:-1]] == BODIES and [json.loads(r["v"]) for r in rows[:-1]] == BODIES
    assert [r["kind"] for r in rows] == ["text", "number", "number", "boolean", "array", "map", "text", "map", "array", "missing"]
    assert [r["n"] for r in rows] == [None, 7.0, 2.5, None, None, None, 10.0, None, None, None]
    assert [r["t"] for r in rows[:4]] == ["text 5", "7", "2.5", "true"] and [r["shown"] for r in rows[-2:]] == ["[]", ""]


def test_typed_values_in_use(spark, tmp_path):
    logs = read(spark, tmp_path).withColumn("seq", (F.col("time_ms") * 1_000_000).cast("int"))
    order = [r["seq"] for r in log_ops.sort_logs(logs, F.element_at("attr_values", "v")).collect()]
    assert order == [2, 1, 6, 0, 3, 4, 5, 7, 8, 99]
    found = {r["template"]: r["n_logs"] for r in templates.log_templates(logs.withColumn("body", F.col("body_value"))).collect()}
    assert found == {"text <NUM>": 1, "<NUM>": 3, "<BOOL>": 1, "[array]": 2, "{a,b}": 1, "{}": 1, "<empty>": 1}
