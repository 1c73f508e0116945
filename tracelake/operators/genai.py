"""Runs of AI agents: kinds of spans, where the time goes, tokens and calls. Contents are never returned, only lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.redact import redact_text


def genai_kind(operation: Column) -> Column:
    """tool, agent, llm or other, from the operation's name."""
    return (
        F.when(operation == "execute_tool", "tool").when(operation.isin("invoke_agent", "create_agent"), "agent")
        .when(operation.isin("chat", "text_completion", "generate_content", "embeddings"), "llm").otherwise("other")
    )


def union_length(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the union of the intervals (s, e) of each key."""
    before = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.where("e > s").withColumn("far", F.max("e").over(before))
    return rows.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0.0), F.col("e") - F.greatest(F.col("s"), F.coalesce("far", "s")))).alias("ms"))


def genai_time_split(spans: DataFrame) -> DataFrame:
    """Per trace: total_ms of its agent span (else of its longest root), and of it llm_ms, tool_ms, busy_ms, other_ms."""
    rows = spans.withColumn("kind", genai_kind(F.col("operation")))
    order = F.struct(F.col("kind") == "agent", F.col("parent_span_id").isNull(), F.col("duration_ms"), F.col("span_id"))
    frame = rows.groupBy("trace_id").agg(F.max_by(F.struct("start_ms", "end_ms"), order).alias("f"))
    rows = rows.where(F.col("kind").isin("llm", "tool")).join(frame, "trace_id").select("trace_id", "kind", F.greatest("start_ms", "f.start_ms").alias("s"), F.least("end_ms", "f.end_ms").alias("e"))
    both = rows.unionByName(rows.withColumn("kind", F.lit("busy")))
    sums = union_length(both, ["trace_id", "kind"]).groupBy("trace_id").agg(*(F.sum(F.when(F.col("kind") == k, F.col("ms"))).alias(f"{k}_ms") for k in ("llm", "tool", "busy")))
    out = frame.select("trace_id", (F.col("f.end_ms") - F.col("f.start_ms")).alias("total_ms")).join(sums, "trace_id", "left")
    out = out.withColumns({f"{k}_ms": F.coalesce(f"{k}_ms", F.lit(0.0)) for k in ("llm", "tool", "busy")})
    return out.withColumn("other_ms", F.greatest(F.lit(0.0), F.col("total_ms") - F.col("busy_ms")))


def genai_tokens(spans: DataFrame) -> DataFrame:
    """Calls, input and output tokens per trace and model."""
    rows = spans.where(genai_kind(F.col("operation")) == "llm")
    return rows.groupBy("trace_id", "model").agg(F.count("*").alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def genai_calls(spans: DataFrame, n: int = 3) -> DataFrame:
    """The n slowest model and tool calls of each trace."""
    rows = spans.withColumn("kind", genai_kind(F.col("operation"))).where(F.col("kind").isin("llm", "tool"))
    order = Window.partitionBy("trace_id").orderBy(F.desc("duration_ms"), "span_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("trace_id", "span_id", "kind", "operation", "duration_ms", "rank")


# Attribute keys of AI calls; earlier names after the present ones. Contents are keys that hold what was said.
_INPUT, _OUTPUT = ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens"), ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens")
CONTENT = r"^gen_ai\.(input\.messages|output\.messages|system_instructions|prompt|completion|tool\.call\.arguments|tool\.call\.result|tool\.definitions)(\.|$)"


def described(spans: DataFrame) -> DataFrame:
    """Spans with attributes (attrs) and what they say of AI calls: kind, operation, model, request_model, provider, tokens, tool, error,
    and the length of each content.

    kind: a tool by its operation or a tool's name, an agent by its operation, a model call by its operation, a requested model or tokens
    of either way; else other.
    """
    text = lambda *keys: F.coalesce(*(F.when(F.try_element_at("attrs", F.lit(k)) != "", F.try_element_at("attrs", F.lit(k))) for k in keys))
    tokens = lambda keys: F.coalesce(*(F.try_element_at("attrs", F.lit(k)) for k in keys)).try_cast("double").cast("bigint")
    rows = spans.withColumns({
        "operation": text("gen_ai.operation.name"), "request_model": text("gen_ai.request.model"), "model": F.coalesce(text("gen_ai.response.model"), text("gen_ai.request.model"), F.lit("(unknown)")),
        "provider": text("gen_ai.provider.name", "gen_ai.system"), "input_tokens": tokens(_INPUT), "output_tokens": tokens(_OUTPUT), "tool_name": text("gen_ai.tool.name"), "call_id": text("gen_ai.tool.call.id"),
        "agent_name": text("gen_ai.agent.name"), "error_type": F.left(redact_text(text("error.type")), F.lit(200)),
        "content_chars": F.transform_values(F.map_filter("attrs", lambda k, v: k.rlike(CONTENT)), lambda k, v: F.char_length(v)),
    })
    known = genai_kind(F.col("operation"))
    kind = F.when((known == "tool") | F.col("tool_name").isNotNull(), "tool").when(known == "agent", "agent")
    kind = kind.when((known == "llm") | F.col("request_model").isNotNull() | F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), "llm").otherwise("other")
    return rows.withColumn("kind", kind)


def call_report(rows: DataFrame, n: int = 50) -> DataFrame:
    """Of described spans the calls of each trace: model calls by start, tool calls by duration (ties by id), the first n of each kind.

    is_failed: status ERROR or an error type. Contents are given by their lengths only.
    """
    calls = rows.where(F.col("kind").isin("llm", "tool")).withColumn("is_failed", (F.col("status_code") == "ERROR") | F.col("error_type").isNotNull())
    order = Window.partitionBy("trace_id", "kind").orderBy(F.when(F.col("kind") == "llm", F.col("start_ms")).otherwise(-F.col("duration_ms")), "span_id")
    calls = calls.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    model = F.when(F.col("kind") == "llm", F.col("model"))
    return calls.select("trace_id", "kind", "rank", "span_id", "name", model.alias("model"), "request_model", "provider", "tool_name", "call_id", "duration_ms", "input_tokens", "output_tokens", "status_code", "error_type", "is_failed", "content_chars")


def failed_calls(rows: DataFrame) -> DataFrame:
    """(trace_id, kind, span_id, name, error_type) of described spans that are failed calls; name is the tool's or the model's."""
    failed = rows.where(F.col("kind").isin("llm", "tool") & ((F.col("status_code") == "ERROR") | F.col("error_type").isNotNull()))
    name = F.when(F.col("kind") == "tool", F.coalesce("tool_name", "name")).otherwise(F.col("model"))
    return failed.select("trace_id", "kind", "span_id", name.alias("name"), "error_type")


def run_tokens(rows: DataFrame) -> DataFrame:
    """Calls and tokens per trace and model of described spans, missing tokens counted as 0."""
    calls = rows.where("kind = 'llm'").groupBy("trace_id", "model")
    return calls.agg(F.count("*").alias("n_calls"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))
