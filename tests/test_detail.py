"""One trace explained, whole and from one of its spans; AI calls by what their attributes say."""

from __future__ import annotations

from tracelake.operators import detail, genai

T = "0" * 31 + "1"
SPAN = "trace_id string, span_id string, parent_span_id string, service string, name string, kind string, start_ms double, end_ms double, duration_ms double, status_code string, status_message string, attrs map<string,string>, events array<struct<time_ms:double,name:string,attrs:map<string,string>>>"
LOG = "trace_id string, span_id string, time_ms double, seq int, service string, severity_number int, body string"


def span(i, parent, start, end, service="a", status="OK", message=None, events=()):
    return (T, i, parent, service, f"op {i}", "SERVER", float(start), float(end), float(end - start), status, message, {}, list(events))


def test_detail(spark):
    boom = [(1.0, "exception", {"exception.type": "E", "other": "x"}), (2.0, "retry", {})]
    rows = [span("r", None, 0, 100), span("x", "r", 10, 90, "b"), span("y", "x", 20, 60, "b", "ERROR", "password=hunter22 failed", boom), span("z", "r", 5, 15), span("o", "gone", 0, 10, "c")]
    logs = spark.createDataFrame([(T, "y", float(k), k, "b", 17, f"log {k}") for k in range(30)], LOG)
    df = spark.createDataFrame(rows, SPAN)
    by: dict = {}
    for r in detail.trace_detail(df, T, logs=logs).orderBy("section", "rank").collect():
        by.setdefault(r["section"], []).append(r)
    trace = by["trace"][0]
    assert (trace["span_id"], trace["duration_ms"]) == ("r", 100.0) and trace["detail"]["orphans"] == "1" and trace["detail"]["spans"] == "5" and trace["detail"]["path_truncated"] == "false"
    assert [(r["span_id"], r["share"]) for r in by["criticalPath"]] == [("r", 1.0), ("x", 0.8), ("y", 0.4)]
    assert [(r["span_id"], r["self_ms"]) for r in by["topSelfTime"]] == [("x", 40.0), ("y", 40.0), ("r", 15.0), ("o", 10.0), ("z", 10.0)]
    assert [(r["service"], r["self_ms"]) for r in by["byService"]] == [("b", 80.0), ("a", 25.0), ("c", 10.0)]
    assert by["bottleneck"][0]["span_id"] == "x"
    error = by["errors"][0]
    assert error["span_id"] == "y" and "hunter22" not in error["detail"]["message"] and error["detail"]["exceptions"] == '[{"exception.type":"E"}]' and error["detail"]["events"] == "exception,retry"
    assert [r["detail"]["body"] for r in by["logs"]] == [f"log {k}" for k in range(10, 30)]
    zoomed: dict = {}
    for r in detail.trace_detail(df, T, "x").orderBy("section", "rank").collect():
        zoomed.setdefault(r["section"], []).append(r["span_id"])
    assert zoomed["criticalPath"] == ["x", "y"] and zoomed["topSelfTime"] == ["x", "y"] and zoomed["errors"] == ["y"] and "logs" not in zoomed
    assert detail.trace_detail(df, "f" * 32).count() == 0


def test_ai_calls(spark):
    made = [
        ("1", {"gen_ai.operation.name": "invoke_agent", "gen_ai.agent.name": "helper"}, "OK"), ("2", {"gen_ai.tool.name": "search", "error.type": "timeout", "gen_ai.tool.call.arguments": "abc"}, "OK"),
        ("3", {"gen_ai.usage.prompt_tokens": "12", "gen_ai.response.model": "m2", "gen_ai.request.model": "m1"}, "OK"), ("4", {"gen_ai.usage.output_tokens": "x"}, "OK"), ("5", {"gen_ai.operation.name": "chat", "gen_ai.system": "p"}, "ERROR"), ("6", {"http.route": "/"}, "ERROR"),
    ]
    df = spark.createDataFrame([("t", i, "n", float(i), float(i) + 1, 1.0, status, attrs) for i, attrs, status in made], "trace_id string, span_id string, name string, start_ms double, end_ms double, duration_ms double, status_code string, attrs map<string,string>")
    rows = genai.described(df)
    assert {r["span_id"]: r["kind"] for r in rows.collect()} == {"1": "agent", "2": "tool", "3": "llm", "4": "other", "5": "llm", "6": "other"}
    calls = {r["span_id"]: r for r in genai.call_report(rows).collect()}
    assert (calls["3"]["model"], calls["3"]["request_model"], calls["3"]["input_tokens"], calls["3"]["is_failed"]) == ("m2", "m1", 12, False)
    assert (calls["5"]["model"], calls["5"]["provider"], calls["5"]["is_failed"]) == ("(unknown)", "p", True) and calls["2"]["content_chars"] == {"gen_ai.tool.call.arguments": 3}
    assert {tuple(r) for r in genai.failed_calls(rows).collect()} == {("t", "tool", "2", "search", "timeout"), ("t", "llm", "5", "(unknown)", None)}
    assert {tuple(r) for r in genai.run_tokens(rows).collect()} == {("t", "m2", 1, 12, 0), ("t", "(unknown)", 1, 0, 0)}
