"""Queries over logs, metric points, AI runs, identities and scalar functions, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import redact, scalars
from tracelake.operators import genai, identity, logs as log_ops, metrics, ordered, traces
from tracelake.plans import fixtures
from tracelake.plans.fixtures import GENAI, HISTOGRAMS, LOGS, POINTS, TRACE_LOGS, duckdb
from tracelake.plans.span_queries import ONE, r6, sql, whole

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


L = f"logs as ({duckdb(LOGS)})"
T = f"tlogs as ({duckdb(TRACE_LOGS)})"
P = f"points as ({duckdb(POINTS)})"
H = f"hist as ({duckdb(HISTOGRAMS)})"
G = f"gen as ({duckdb(GENAI)})"
LEVEL = "case when severity_number >= 21 then 'FATAL' when severity_number >= 17 then 'ERROR' when severity_number >= 13 then 'WARN' when severity_number >= 9 then 'INFO' when severity_number >= 5 then 'DEBUG' when severity_number >= 1 then 'TRACE' else '' end"
DAYS_MS = 5 * 86_400_000


@query(sql(L, f"""select seq, body, severity_number from logs where severity_number >= 9 and contains(lower(concat_ws(' ', body, {LEVEL}, attr_k, attr_user)), 'purchase')
  and time_ms >= (select max(time_ms) from logs) - {DAYS_MS}"""))
def filter_logs(spark, sf_dir):
    return log_ops.filter_logs(fixtures.logs(spark, sf_dir), 9, "Purchase", range_ms=DAYS_MS).select("seq", "body", "severity_number")


@query(sql(L, f"select {LEVEL} as level, count(*) as n_logs from logs group by 1"))
def severity_counts(spark, sf_dir):
    return log_ops.severity_counts(fixtures.logs(spark, sf_dir))


@query(sql(L, "select seq, body, service from logs where severity_number >= 13 order by time_ms desc, seq desc limit 100"))
def query_logs(spark, sf_dir):
    return log_ops.newest_logs(log_ops.filter_logs(fixtures.logs(spark, sf_dir), 13), 100).select("seq", "body", "service")


@query(sql(L, """select seq, cast(row_number() over (order by case severity_number when 5 then 0 when 1 then 1 when 17 then 2 when 13 then 3 else 4 end,
  case when severity_number = 5 then cast(attr_k as double) end, case when severity_number = 1 then body end, case when severity_number = 17 then cast(attr_k as int) % 2 end, seq) as bigint) as place from logs"""))
def sort_logs(spark, sf_dir):
    """All logs in the order of a column that holds numbers, texts, booleans and maps."""
    k = F.element_at("attrs", "k")
    mixed = F.when(F.col("severity_number") == 5, k.cast("double").cast("variant")).when(F.col("severity_number") == 1, F.col("body").cast("variant")).when(F.col("severity_number") == 17, (k.cast("int") % 2 == 1).cast("variant"))
    mixed = mixed.when(F.col("severity_number") == 13, F.to_variant_object(F.create_map(F.lit("k"), k)))
    rows = log_ops.sort_logs(fixtures.logs(spark, sf_dir).withColumn("mixed", mixed), F.col("mixed"))
    return ordered.running(rows.select("seq", F.monotonically_increasing_id().alias("at")), [], ["at"], place=F.lit(1)).select("seq", "place")


@query("select unnest(['k', 'user.id']) as key")
def log_attr_keys(spark, sf_dir):
    return log_ops.log_attr_keys(fixtures.logs(spark, sf_dir))


@query(sql(T, "select trace_id, count(*) as n_logs from tlogs group by 1"))
def log_counts(spark, sf_dir):
    return log_ops.log_counts(fixtures.logs(spark, sf_dir, TRACE_LOGS), "trace_id")


@query(sql(T, f"select seq, body, count(*) over () > 5 as is_truncated from tlogs where trace_id = '{'0' * 30}0a' qualify row_number() over (order by time_ms desc, seq desc) <= 5"))
def logs_for_trace(spark, sf_dir):
    return log_ops.logs_for_trace(fixtures.logs(spark, sf_dir, TRACE_LOGS), "0" * 30 + "0a", n=5).select("seq", "body", "is_truncated")


_PLACED = f"""{ONE}, {T}, placed as (select t.*, o.start_ms as s, o.duration_ms, t.time_ms - o.start_ms as offset_ms,
  case when o.span_id is null then 'trace' when t.time_ms < o.start_ms then 'before' when t.time_ms > o.end_ms then 'after' else 'within' end as place
  from tlogs t left join one o on t.trace_id = o.trace_id and t.span_id = o.span_id)"""


def _placed(spark, sf_dir):
    one = traces.dedupe_spans(fixtures.spans(spark, sf_dir))
    return log_ops.attach_logs_to_spans(fixtures.logs(spark, sf_dir, TRACE_LOGS), one), one


@query(sql(_PLACED, "select seq, trace_id, span_id, place, round(offset_ms, 6) as offset_ms from placed"))
def attach_logs_to_spans(spark, sf_dir):
    return _placed(spark, sf_dir)[0].select("seq", "trace_id", "span_id", "place", F.round("offset_ms", 6).alias("offset_ms"))


@query(sql(f"""{_PLACED}, ext as (select trace_id, min(start_ms) as t0, max(end_ms) - min(start_ms) as total from one group by 1),
  held as (select p.*, least(greatest(duration_ms, 0.0), greatest(0.0, offset_ms)) as h, t0, total from placed p join ext using (trace_id) where place <> 'trace'),
  pcts as (select *, case when total > 0 then (s - t0 + h) * 100 / total else 0 end as pct from held)""",
  "select trace_id, span_id, 0.5 as width, cast(floor(pct / 0.5) as integer) as bucket, count(*) as n_logs, round(avg(pct), 6) as pct, max(severity_number) as severity, bool_or(h <> offset_ms) as is_clamped from pcts group by 1, 2, 4"))
def log_markers(spark, sf_dir):
    return log_ops.log_markers(*_placed(spark, sf_dir)).withColumns(r6("pct"))


@query(sql(P, "select instance_id, metric, any_value(type) as type, bool_or(monotonic) as monotonic, count(*) as n_points, count(distinct concat('shard=', shard, ',type=', event_type)) as n_series from points group by 1, 2"))
def list_metrics(spark, sf_dir):
    return metrics.list_metrics(fixtures.points(spark, sf_dir))


def _series(spark, sf_dir):
    return fixtures.view(spark, sf_dir, POINTS)


_KEYS = ["metric", "event_type", "shard"]


@query(sql(P, """select metric, event_type, shard, count(*) as n_points, round(arg_max(value, row(time_ms, seq)), 6) as last, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as avg,
  round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(arg_max(value, row(time_ms, seq)) - arg_min(value, row(time_ms, seq)), 6) as delta from points group by 1, 2, 3"""))
def summarize_series(spark, sf_dir):
    return metrics.summarize_series(_series(spark, sf_dir), *_KEYS).drop("from_ms", "to_ms", "per_second").withColumns(r6("last", "min", "max", "avg", "p50", "p95", "delta"))


@query(sql(P, """select metric, event_type, shard, seq, round(case when value >= lag(value) over w and time_ms > lag(time_ms) over w then (value - lag(value) over w) / ((time_ms - lag(time_ms) over w) / 1000) end, 6) as rate
  from points where metric = 'events.total' window w as (partition by metric, event_type, shard order by time_ms, seq)"""))
def counter_rate(spark, sf_dir):
    rows = metrics.counter_rate(_series(spark, sf_dir).where("metric = 'events.total'"), _KEYS)
    return rows.select(*_KEYS, "seq", "rate").withColumns(r6("rate"))


STEP_MS = 6 * 3_600_000


@query(sql(f"""{P}, b as (select metric, event_type, cast(floor(time_ms / {STEP_MS}) * {STEP_MS} as bigint) as bucket_ms, avg(value) as avg, max(value) as max, stddev_pop(value) as stddev, quantile_cont(value, 0.9) as p90, count(value) as n
  from points where metric = 'event.value' group by 1, 2, 3), s as (select metric, event_type, unnest(range(min(bucket_ms), max(bucket_ms) + 1, {STEP_MS})) as bucket_ms from b group by 1, 2)""",
  "select metric, event_type, bucket_ms, round(avg, 6) as avg, round(max, 6) as max, round(stddev, 6) as stddev, round(p90, 6) as p90, cast(n as double) as count from s left join b using (metric, event_type, bucket_ms)"))
def rollup_over_time(spark, sf_dir):
    rows = _series(spark, sf_dir).where("metric = 'event.value'")
    return metrics.rollup_over_time(rows, ["metric", "event_type"], STEP_MS, "avg", "max", "stddev", "p90", "count").withColumns(r6("avg", "max", "stddev", "p90"))


@query(sql(P, f"""select metric, cast(floor(time_ms / {STEP_MS}) * {STEP_MS} as bigint) as time_ms, round(sum(value), 4) as sum, round(avg(value), 6) as avg, round(min(value), 6) as min, round(max(value), 6) as max, round(quantile_cont(value, 0.95), 6) as p95 from points group by 1, 2"""))
def reduce_across_series(spark, sf_dir):
    return metrics.reduce_across_series(_series(spark, sf_dir), STEP_MS).withColumns(r6("avg", "min", "max", "p95") | {"sum": F.round("sum", 4)})


_ALIGNED = f"""{P}, f as (select metric, event_type, cast(floor(time_ms / {STEP_MS}) * {STEP_MS} as bigint) as bucket_ms, arg_max(value, row(time_ms, seq)) as value from points where metric = 'event.value' group by 1, 2, 3),
  a as (select * from (select distinct metric, event_type from f) join (select distinct metric, bucket_ms from f) using (metric) left join f using (metric, event_type, bucket_ms))"""


@query(sql(_ALIGNED, "select metric, event_type, bucket_ms, round(value, 6) as value from a"))
def align_series(spark, sf_dir):
    return metrics.align_series(_series(spark, sf_dir).where("metric = 'event.value'"), ["event_type"], STEP_MS).withColumns(r6("value"))


@query(sql(_ALIGNED, "select metric, event_type, bucket_ms, round(sum(coalesce(value, 0)) over (partition by metric, bucket_ms order by event_type rows unbounded preceding), 6) as stacked from a"))
def stack_series(spark, sf_dir):
    rows = metrics.align_series(_series(spark, sf_dir).where("metric = 'event.value'"), ["event_type"], STEP_MS)
    return metrics.stack_series(rows, ["event_type"]).drop("value").withColumns(r6("stacked"))


_WINDOWED = f"""select metric, event_type, shard, seq from (select *, max(time_ms) over w - {DAYS_MS} as f from points window w as (partition by metric, event_type, shard))
  qualify time_ms >= f or time_ms = max(case when time_ms < f then time_ms end) over (partition by metric, event_type, shard)"""


@query(sql(P, _WINDOWED))
def window_series(spark, sf_dir):
    return metrics.window_series(_series(spark, sf_dir), _KEYS, DAYS_MS).select(*_KEYS, "seq")


@query(sql(P, """select metric, event_type, shard, max(time_ms) as t, round(arg_max(value, row(time_ms, seq)), 6) as value from points group by 1, 2, 3""").replace("max(time_ms) as t", "cast(floor(max(time_ms)) as bigint) as time_ms"))
def latest_points(spark, sf_dir):
    return identity.latest_points(_series(spark, sf_dir), _KEYS).withColumns(whole("time_ms") | r6("value"))


@query(sql(P, """select metric, event_type, shard, seq from points qualify time_ms > coalesce(max(time_ms) over (partition by metric, event_type, shard order by seq rows between unbounded preceding and 1 preceding), -1)"""))
def drop_stale_points(spark, sf_dir):
    return identity.drop_stale_points(_series(spark, sf_dir), _KEYS).select(*_KEYS, "seq")


@query(sql(P, "select metric, event_type, shard, seq from points qualify row_number() over (partition by metric, event_type, shard order by time_ms desc, seq desc) <= 20"))
def retain_newest(spark, sf_dir):
    return identity.retain_newest(_series(spark, sf_dir), _KEYS, 20).select(*_KEYS, "seq")


@query(sql(L, "select seq, body from logs order by time_ms desc, seq desc limit 50"))
def newest_n(spark, sf_dir):
    return identity.newest_n(fixtures.logs(spark, sf_dir), 50).select("seq", "body")


@query(sql(f"{ONE}, {L}, {P}, u as (select service, instance_id, 1 as a, 0 as b, 0 as c, trace_id as t from one union all select service, instance_id, 0, 1, 0, null from logs union all select split_part(instance_id, '::', 1), instance_id, 0, 0, 1, null from points)",
           "select service, instance_id, cast(grouping(service, instance_id) as bigint) as level, count(distinct t) as n_traces, cast(sum(a) as bigint) as n_spans, cast(sum(b) as bigint) as n_logs, cast(sum(c) as bigint) as n_points from u group by rollup (service, instance_id)"))
def list_services(spark, sf_dir):
    one = traces.dedupe_spans(fixtures.spans(spark, sf_dir))
    points = fixtures.points(spark, sf_dir).withColumn("service", F.split_part(F.col("instance_id"), F.lit("::"), F.lit(1)))
    return identity.list_services(one, fixtures.logs(spark, sf_dir), points).drop("first_ms", "last_ms")


@query(sql(ONE, "select service, instance, count(*) as n_spans from (select service, service || '::' || left(sha1(service || chr(10) || 'kind=' || kind || ',user=' || coalesce(user_id, '')), 16) as instance from one) group by all"))
def instance_ids(spark, sf_dir):
    one = traces.dedupe_spans(fixtures.view(spark, sf_dir, fixtures.SPANS))
    made = identity.instance_id(F.col("service"), F.lit(None).cast("string"), F.create_map(F.lit("user"), "user_id", F.lit("kind"), "kind"))
    return one.groupBy("service", made.alias("instance")).agg(F.count("*").alias("n_spans"))


_BOUNDS = "[100000.0, 200000.0, 300000.0, 400000.0]"


def _histograms(spark, sf_dir):
    return fixtures.view(spark, sf_dir, HISTOGRAMS).select("priority", "month_no", "n", "total", F.array(*map(F.lit, (1e5, 2e5, 3e5, 4e5))).alias("bounds"), F.array(*(F.col(f"b{k}").cast("double") for k in range(5))).alias("counts"))


@query(sql(f"{H}, r as (select *, 0.9 * n as rk, b0 + b1 as c1, b0 + b1 + b2 as c2, b0 + b1 + b2 + b3 as c3 from hist)",
           """select priority, month_no, round(total / n, 6) as mean, round(case when b0 > 0 and b0 >= rk then 1e5 * rk / b0 when b1 > 0 and c1 >= rk then 1e5 + 1e5 * (rk - b0) / b1 when b2 > 0 and c2 >= rk then 2e5 + 1e5 * (rk - c1) / b2
  when b3 > 0 and c3 >= rk then 3e5 + 1e5 * (rk - c2) / b3 else 4e5 end, 6) as p90 from r"""))  # fmt: skip
def histogram_quantile(spark, sf_dir):
    rows = _histograms(spark, sf_dir)
    return rows.select("priority", "month_no", metrics.histogram_mean(F.col("total"), F.col("n")).alias("mean"), metrics.histogram_quantile(F.col("bounds"), F.col("counts"), 0.9).alias("p90")).withColumns(r6("mean", "p90"))


@query(sql(f"{H}, l as (select priority, arg_max([b0, b1, b2, b3, b4], month_no) as b from hist group by 1)",
           "select priority, cast(unnest(range(5)) as integer) as i, unnest(['≤ 100000', '100000 – 200000', '200000 – 300000', '300000 – 400000', '> 400000']) as label, cast(unnest(b) as bigint) as n from l"))
def histogram_buckets(spark, sf_dir):
    return metrics.histogram_buckets(_histograms(spark, sf_dir), ["priority"], "month_no")


def _genai(spark, sf_dir):
    return fixtures.view(spark, sf_dir, GENAI)


KIND = "case when operation = 'execute_tool' then 'tool' when operation = 'invoke_agent' then 'agent' when operation = 'chat' then 'llm' else 'other' end"


@query(sql(G, f"select {KIND} as kind, count(*) as n_spans from gen group by 1"))
def genai_kind(spark, sf_dir):
    return _genai(spark, sf_dir).groupBy(genai.genai_kind(F.col("operation")).alias("kind")).agg(F.count("*").alias("n_spans"))


@query(sql(f"""{G}, k as (select *, {KIND} as kind from gen), f as (select trace_id, arg_max(row(start_ms, end_ms), row(kind = 'agent', parent_span_id is null, duration_ms, span_id)) as f from k group by 1),
  c as (select trace_id, kind, greatest(start_ms, f[1]) as s, least(end_ms, f[2]) as e from k join f using (trace_id) where kind in ('llm', 'tool')), b as (select * from c union all select trace_id, 'busy', s, e from c),
  m as (select *, max(e) over (partition by trace_id, kind order by s, e rows between unbounded preceding and 1 preceding) as far from b where e > s),
  u as (select trace_id, kind, sum(greatest(0.0, e - greatest(s, coalesce(far, s)))) as ms from m group by 1, 2),
  w as (select trace_id, coalesce(sum(ms) filter (kind = 'llm'), 0) as l, coalesce(sum(ms) filter (kind = 'tool'), 0) as t, coalesce(sum(ms) filter (kind = 'busy'), 0) as y from u group by 1)""",
  "select trace_id, f[2] - f[1] as total_ms, coalesce(l, 0) as llm_ms, coalesce(t, 0) as tool_ms, coalesce(y, 0) as busy_ms, greatest(0.0, f[2] - f[1] - coalesce(y, 0)) as other_ms from f left join w using (trace_id)"))
def genai_time_split(spark, sf_dir):
    return genai.genai_time_split(_genai(spark, sf_dir))


@query(sql(G, "select trace_id, model, count(*) as n_calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from gen where operation = 'chat' group by 1, 2"))
def genai_tokens(spark, sf_dir):
    return genai.genai_tokens(_genai(spark, sf_dir))


@query(sql(G, f"select trace_id, span_id, {KIND} as kind, operation, duration_ms, cast(row_number() over (partition by trace_id order by duration_ms desc, span_id) as integer) as rank from gen where {KIND} in ('llm', 'tool') qualify rank <= 3"))
def genai_calls(spark, sf_dir):
    return genai.genai_calls(_genai(spark, sf_dir))


def _described(spark, sf_dir):
    """The runs as spans with attributes: turns of the user are tool calls by a tool's name, every seventh call fails."""
    rows = _genai(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    pairs = {"gen_ai.operation.name": F.when(F.col("role") != "user", F.col("operation")), "gen_ai.request.model": F.when(F.col("role") == "assistant", F.col("model")), "gen_ai.usage.prompt_tokens": text("input_tokens"),
             "gen_ai.usage.output_tokens": text("output_tokens"), "gen_ai.tool.name": F.when(F.col("role") == "user", F.concat(F.lit("tool-"), text("turn"))), "error.type": F.when(F.col("turn") % 7 == 3, F.lit("timeout")), "gen_ai.prompt": F.repeat(F.lit("x"), (F.col("turn") + 1).cast("int"))}
    attrs = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    rows = rows.withColumn("attrs", attrs).select("trace_id", "span_id", F.lit("op").alias("name"), "start_ms", "end_ms", "duration_ms", F.when(F.col("turn") % 5 == 4, "ERROR").otherwise("OK").alias("status_code"), "attrs")
    return genai.described(rows)


_CALLED = f"{G}, d as (select *, case when role = 'user' then 'tool' when role = 'assistant' then 'llm' else 'agent' end as kind, turn % 7 = 3 as timed, turn % 5 = 4 as failed from gen)"


@query(sql(_CALLED, """select trace_id, kind, cast(row_number() over (partition by trace_id, kind order by case when kind = 'llm' then start_ms else -duration_ms end, span_id) as integer) as rank, span_id, case when kind = 'llm' then model end as model,
  case when kind = 'tool' then 'tool-' || turn end as tool_name, coalesce(input_tokens, -1) as input_tokens, coalesce(output_tokens, -1) as output_tokens, case when timed then 'timeout' end as error_type, timed or failed as is_failed, cast(turn + 1 as integer) as content from d where kind in ('llm', 'tool') qualify rank <= 3"""))
def genai_call_report(spark, sf_dir):
    found = genai.call_report(_described(spark, sf_dir), 3).withColumn("content", F.element_at("content_chars", "gen_ai.prompt"))
    found = found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("input_tokens", "output_tokens")})
    return found.select("trace_id", "kind", "rank", "span_id", "model", "tool_name", "input_tokens", "output_tokens", "error_type", "is_failed", "content")


@query(sql(_CALLED, "select trace_id, kind, span_id, case when kind = 'tool' then 'tool-' || turn else model end as name, case when timed then 'timeout' end as error_type from d where kind in ('llm', 'tool') and (timed or failed)"))
def genai_failed_calls(spark, sf_dir):
    return genai.failed_calls(_described(spark, sf_dir))


@query(sql(_CALLED, "select trace_id, model, count(*) as n_calls, cast(sum(coalesce(input_tokens, 0)) as bigint) as input_tokens, cast(sum(coalesce(output_tokens, 0)) as bigint) as output_tokens from d where kind = 'llm' group by 1, 2"))
def genai_run_tokens(spark, sf_dir):
    return genai.run_tokens(_described(spark, sf_dir))


@query("""select page_id, case when regexp_matches(url, '\\?.*=') then 'urlQuery' when list_bool_or([regexp_full_match(p, '[0-9]+') or regexp_full_match(p, '(0[xX])?[0-9a-fA-F]{8,}') and regexp_matches(p, '[0-9]') for p in
  string_split(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/')]) then 'pathId' else 'other' end as class from pages""")
def classify_urls(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "select page_id, url from {pages}").select("page_id", scalars.classify_value(F.col("url")).alias("class"))


@query()
def classify_values(spark, sf_dir):
    texts = fixtures.view(spark, sf_dir, "select doc_id, text from {documents}").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return texts.groupBy(scalars.classify_value(F.col("word")).alias("class")).agg(F.count("*").alias("n_values"))


@query()
def redact_texts(spark, sf_dir):
    """How often each document's text changes when secrets are masked, and its length afterwards."""
    texts = fixtures.view(spark, sf_dir, "select doc_id, text from {documents}").withColumn("safe", redact.redact_text(F.col("text")))
    return texts.select("doc_id", (F.col("safe") != F.col("text")).alias("is_changed"), F.char_length("safe").cast("bigint").alias("n_chars"))


@query(sql(ONE, "select trace_id, span_id, '[REDACTED]' as session, url_full as url from one where url_full is not null"))
def redact_attrs(spark, sf_dir):
    one = traces.dedupe_spans(fixtures.spans(spark, sf_dir)).where("attrs['url.full'] is not null")
    safe = redact.redact_attrs(F.map_concat(F.create_map(F.lit("session.id"), F.col("span_id")), F.col("attrs")))
    return one.select("trace_id", "span_id", F.element_at(safe, "session.id").alias("session"), F.element_at(safe, "url.full").alias("url"))


@query("select event_id, trace_id, span_id from (select event_id, lpad(lower(to_hex(event_id + 1)), 32, '0') as trace_id, lpad(lower(to_hex(event_id * 16 + 1)), 16, '0') as span_id from events)")
def normalize_ids(spark, sf_dir):
    rows = fixtures.view(spark, sf_dir, "select event_id, concat(' 0x', upper(lpad(hex(event_id + 1), 32, '0')), ' ') as t, concat('00-', lpad(lower(hex(event_id + 1)), 32, '0'), '-', lpad(lower(hex(event_id * 16 + 1)), 16, '0'), '-01') as p from {events}")
    return rows.select("event_id", scalars.normalize_trace_id(F.col("t")).alias("trace_id"), scalars.parse_trace_target(F.col("p"))["span_id"].alias("span_id"))


@query("select event_id, epoch_us(ts) / 1000 as ms, epoch_us(ts) / 1000 as iso_ms, epoch_us(ts) as micros from events")
def convert_times(spark, sf_dir):
    rows = fixtures.view(spark, sf_dir, "select event_id, cast(unix_micros(cast(ts as timestamp)) * 1000 as string) as n, cast(ts as string) as iso, MS(ts) as m from {events}")
    return rows.select("event_id", scalars.nano_to_ms(F.col("n")).alias("ms"), scalars.epoch_to_ms(F.col("iso")).alias("iso_ms"), F.round(scalars.ms_to_nano(F.col("m")) / 1000).cast("bigint").alias("micros"))


@query("select event_id, event_type = 'error' as is_error, case event_type when 'error' then 17 else 0 end as severity, case event_type when 'error' then 'ERROR' else '' end as level from events")
def severities(spark, sf_dir):
    rows = fixtures.view(spark, sf_dir, "select event_id, event_type from {events}")
    number = scalars.severity_number(F.col("event_type"))
    return rows.select("event_id", (F.col("event_type") == "error").alias("is_error"), number.alias("severity"), scalars.severity_label(number).alias("level"))


@query("select event_id, case event_id % 5 when 0 then event_id * 1.0 when 1 then event_id * 1000.0 when 2 then event_id * 60000.0 when 3 then event_id / 1000 end as ms from events")
def parse_durations(spark, sf_dir):
    rows = fixtures.view(spark, sf_dir, "select event_id, concat(cast(event_id as string), case event_id % 5 when 0 then 'ms' when 1 then 's' when 2 then 'm' when 3 then 'us' else 'parsecs' end) as d from {events}")
    return rows.select("event_id", scalars.parse_duration_ms(F.col("d")).alias("ms"))


@query("select doc_id, case when length(flat) > 300 then left(flat, 300) || '…' else flat end as message from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat from documents)")
def truncate_messages(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "select doc_id, text from {documents}").select("doc_id", scalars.truncate_message(F.col("text")).alias("message"))


@query(sql(ONE, """select trace_id, span_id, case when length(t) > 60 then left(t, 59) || '…' else t end as summary from (select trace_id, span_id, concat_ws('  ', 'db.collection.name=' || db_collection, 'db.namespace=' || db_namespace, 'db.operation.name=' || db_operation,
  'db.system=' || db_system, 'http.request.method=' || http_method, 'http.route=' || http_route, 'messaging.destination.name=' || msg_destination, 'messaging.system=' || msg_system, 'server.address=' || server_address, 'url.full=' || url_full, 'user.id=' || user_id) as t from one)"""))
def summarize_attrs(spark, sf_dir):
    return traces.dedupe_spans(fixtures.spans(spark, sf_dir)).select("trace_id", "span_id", scalars.summarize_attrs(F.col("attrs"), 60).alias("summary"))


_NICE = " ".join(f"when w <= {s} then {s}" for s in metrics.NICE_STEPS_MS)


@query(sql(f"""{P}, g as (select metric, event_type, shard, time_ms, time_ms - lag(time_ms) over (partition by metric, event_type, shard order by time_ms, seq) as gap from points),
  r as (select *, row_number() over (partition by metric, event_type, shard order by gap nulls last) as at_, count(gap) over (partition by metric, event_type, shard) as n from g),
  w as (select metric, event_type, shard, greatest((max(time_ms) - min(time_ms)) / 120, coalesce(max(case when at_ = floor(n / 2) + 1 then gap end), 0)) as w from r group by 1, 2, 3)""",
  f"select metric, event_type, shard, cast(case {_NICE} else {metrics.NICE_STEPS_MS[-1]} end as bigint) as step_ms from w"))
def auto_step(spark, sf_dir):
    return metrics.auto_step(_series(spark, sf_dir), _KEYS).select(*_KEYS, "step_ms")


@query("""with daily as (select event_type, date_trunc('day', ts) as day, max(epoch_us(ts) / 1000) as time_ms, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.9) as q90 from events group by 1, 2),
  each as (select event_type, time_ms, 'q0.5' as field, q50 as value from daily union all select event_type, time_ms, 'q0.9', q90 from daily)
  select event_type, field, round(arg_max(value, time_ms), 6) as value from each group by 1, 2""")
def summary_quantiles(spark, sf_dir):
    """Latest quantiles of every event type, from a summary of each day; its count is no quantile."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("time_ms", F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    daily = events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.max("time_ms").alias("time_ms"), F.percentile("value", 0.5).alias("q0.5"), F.percentile("value", 0.9).alias("q0.9"), F.count("*").cast("double").alias("count"))
    series = daily.unpivot(["event_type", "time_ms"], ["`q0.5`", "`q0.9`", "count"], "field", "value")
    return metrics.summary_quantiles(series, ["event_type"]).withColumns(r6("value"))
