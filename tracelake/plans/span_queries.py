"""Queries over spans, traces and the service map, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import scalars
from tracelake.operators import logs as log_ops, servicemap, traces, tree
from tracelake.plans.fixtures import SPANS, TRACE_LOGS, duckdb, logs, spans

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def r6(*columns: str) -> dict:
    return {c: F.round(F.col(c).cast("double"), 6) for c in columns}


def whole(*columns: str) -> dict:
    """Whole milliseconds: an epoch time has too many digits to be rounded behind the point."""
    return {c: F.floor(c).cast("bigint") for c in columns}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


RAW = f"raw as ({duckdb(SPANS)})"
ONE = f"""{RAW}, one as (select * exclude (rn) from (select *, row_number() over (partition by trace_id, span_id
  order by end_ms desc, start_ms desc, service desc, name desc, kind desc, status_code desc) as rn from raw) where rn = 1)"""
SELF = f"""{ONE}, kids as (
  select k.trace_id, k.parent_span_id, k.span_id, greatest(k.start_ms, p.start_ms) as s, least(k.end_ms, p.end_ms) as e
  from one k join one p on k.trace_id = p.trace_id and k.parent_span_id = p.span_id where k.parent_span_id <> k.span_id),
far as (select *, max(e) over (partition by trace_id, parent_span_id order by s, e, span_id rows between unbounded preceding and 1 preceding) as far from kids where e > s),
covered as (select trace_id, parent_span_id as span_id, sum(greatest(0.0, e - greatest(s, coalesce(far, s)))) as covered from far group by all),
selfs as (select one.*, greatest(0.0, duration_ms - coalesce(covered, 0.0)) as self_ms from one left join covered using (trace_id, span_id))"""
SUMMARY = f"""{ONE}, ranked as (
  select one.*, case when coalesce(one.parent_span_id, '') = '' then 0 when p.span_id is null then 1 else 2 end as rk
  from one left join (select trace_id, span_id from one) p on one.trace_id = p.trace_id and one.parent_span_id = p.span_id),
roots as (select * from (select *, row_number() over (partition by trace_id order by rk, start_ms, span_id) as rn from ranked) where rn = 1),
extent as (select trace_id, min(start_ms) as start_ms, max(end_ms) as end_ms from raw group by trace_id),
counts as (select trace_id, count(*) as n_spans, count(*) filter (status_code = 'ERROR') as n_errors, array_to_string(list_sort(list_distinct(list(service))), ',') as services from one group by trace_id),
summary as (
  select e.trace_id, r.span_id as root_span_id, r.name as root_name, r.service as root_service, r.http_route, e.start_ms, e.end_ms, e.end_ms - e.start_ms as duration_ms, n_spans, n_errors, services
  from extent e join roots r using (trace_id) join counts using (trace_id))"""


def sql(ctes: str, body: str) -> str:
    return f"with {ctes}\n{body}"


@query(sql(ONE, "select trace_id, span_id, parent_span_id, service, name, kind, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms, status_code from one"))
def dedupe_spans(spark, sf_dir):
    one = traces.dedupe_spans(spans(spark, sf_dir))
    return one.select("trace_id", "span_id", "parent_span_id", "service", "name", "kind", "start_ms", "end_ms", "status_code").withColumns(whole("start_ms", "end_ms"))


def _summaries(spark, sf_dir):
    return traces.trace_summaries(spans(spark, sf_dir))


_SUMMARY_COLUMNS = "trace_id, root_span_id, root_name, root_service, cast(start_ms as bigint) as start_ms, round(duration_ms, 6) as duration_ms, n_spans, n_errors, services"


def _shown(df):
    keep = ["trace_id", "root_span_id", "root_name", "root_service", "start_ms", "duration_ms", "n_spans", "n_errors"]
    return df.select(*keep, F.array_join("services", ",").alias("services")).withColumns(r6("duration_ms") | whole("start_ms"))


@query(sql(SUMMARY, f"select {_SUMMARY_COLUMNS} from summary"))
def trace_summaries(spark, sf_dir):
    return _shown(_summaries(spark, sf_dir))


@query(sql(SUMMARY, f"select {_SUMMARY_COLUMNS} from summary order by summary.duration_ms desc, trace_id limit 20"))
def search_traces(spark, sf_dir):
    return _shown(traces.search_traces(_summaries(spark, sf_dir), "duration", 20))


@query(sql(SUMMARY, f"select {_SUMMARY_COLUMNS} from summary order by summary.start_ms desc, trace_id limit 10"))
def newest_traces(spark, sf_dir):
    return _shown(traces.newest_traces(_summaries(spark, sf_dir), 10))


_STATS = """count(*) as n_traces, count(*) filter (n_errors > 0) as n_failing, round(count(*) filter (n_errors > 0) / count(*), 6) as error_rate,
  round(quantile_cont(duration_ms, 0.5), 6) as p50_ms, round(quantile_cont(duration_ms, 0.95), 6) as p95_ms, round(max(duration_ms), 6) as max_ms"""


@query(sql(SUMMARY, f"select {_STATS} from summary"))
def trace_stats(spark, sf_dir):
    return traces.trace_stats(_summaries(spark, sf_dir)).withColumns(r6("error_rate", "p50_ms", "p95_ms", "max_ms"))


def _group_sql(key: str) -> str:
    return sql(SUMMARY, f"select {key} as key, {_STATS}, arg_max(trace_id, row(n_errors > 0, duration_ms, trace_id)) as example from summary group by 1")


@query(_group_sql("root_service"))
def group_traces_by_service(spark, sf_dir):
    return traces.group_traces(_summaries(spark, sf_dir), F.coalesce("root_service", F.lit("(unknown)"))).withColumns(r6("error_rate", "p50_ms", "p95_ms", "max_ms"))


@query(_group_sql("root_name"))
def group_traces_by_name(spark, sf_dir):
    return traces.group_traces(_summaries(spark, sf_dir), F.col("root_name")).withColumns(r6("error_rate", "p50_ms", "p95_ms", "max_ms"))


@query(_group_sql("coalesce(http_route, '(missing)')"))
def group_traces_by_attribute(spark, sf_dir):
    return traces.group_traces(_summaries(spark, sf_dir), F.coalesce(F.element_at("root_attrs", "http.route"), F.lit("(missing)"))).withColumns(r6("error_rate", "p50_ms", "p95_ms", "max_ms"))


@query(sql(f"{SUMMARY}, b as (select min(start_ms) as lo, max(start_ms) as hi from summary), spine as (select unnest(range(12)) as bucket), "
           "c as (select least(11, floor((start_ms - lo) / ((hi - lo) / 12))) as bucket, count(*) as n, count(*) filter (n_errors > 0) as f from summary, b group by 1)",
           "select cast(bucket as integer) as bucket, cast(floor(lo + bucket * ((hi - lo) / 12)) as bigint) as from_ms, coalesce(n, 0) as n_traces, coalesce(f, 0) as n_failing from spine left join c using (bucket), b"))
def traces_over_time(spark, sf_dir):
    return traces.traces_over_time(_summaries(spark, sf_dir)).withColumns(whole("from_ms"))


@query(sql(ONE, "select k.trace_id, k.parent_span_id, k.span_id from one k join one p on k.trace_id = p.trace_id and k.parent_span_id = p.span_id where k.span_id <> p.span_id"))
def children(spark, sf_dir):
    return traces.children(spans(spark, sf_dir))


@query(sql(SELF, "select trace_id, span_id, round(duration_ms, 6) as duration_ms, round(self_ms, 6) as self_ms from selfs"))
def self_times(spark, sf_dir):
    return traces.self_times(spans(spark, sf_dir)).select("trace_id", "span_id", "duration_ms", "self_ms").withColumns(r6("duration_ms", "self_ms"))


@query(sql(SELF, """select service, name, count(*) as n_spans, count(*) filter (status_code = 'ERROR') as n_errors, round(sum(self_ms), 6) as self_ms,
  round(quantile_cont(duration_ms, 0.5), 6) as p50_ms, round(quantile_cont(duration_ms, 0.95), 6) as p95_ms,
  arg_max(trace_id, row(status_code = 'ERROR', duration_ms, trace_id)) as example, round(sum(self_ms) / sum(sum(self_ms)) over (), 6) as self_share from selfs group by service, name"""))
def group_spans(spark, sf_dir):
    return traces.group_spans(traces.self_times(spans(spark, sf_dir)), "service", "name").withColumns(r6("self_ms", "p50_ms", "p95_ms", "self_share"))


@query(sql(SELF, """select trace_id, span_id, service, name, round(duration_ms, 6) as duration_ms, round(self_ms, 6) as self_ms from selfs
  where kind = 'CLIENT' and status_code = 'ERROR' and duration_ms >= 100 order by selfs.self_ms desc, trace_id, span_id limit 50"""))
def find_spans(spark, sf_dir):
    found = traces.find_spans(traces.self_times(spans(spark, sf_dir)), (F.col("kind") == "CLIENT") & (F.col("status_code") == "ERROR"), 100, "self_ms", 50)
    return found.select("trace_id", "span_id", "service", "name", "duration_ms", "self_ms").withColumns(r6("duration_ms", "self_ms"))


@query("with recursive " + ONE + """, tree as (
  select o.trace_id, o.span_id, 0 as depth, coalesce(o.parent_span_id, '') <> '' as is_orphan, o.span_id as root_span_id
  from one o left join one p on o.trace_id = p.trace_id and o.parent_span_id = p.span_id where p.span_id is null
  union all
  select k.trace_id, k.span_id, t.depth + 1, false, t.root_span_id from one k join tree t on k.trace_id = t.trace_id and k.parent_span_id = t.span_id)
select trace_id, span_id, cast(depth as integer) as depth, is_orphan, root_span_id from tree""")
def span_depths(spark, sf_dir):
    return tree.depths(spans(spark, sf_dir))


@query(sql(SELF, "select trace_id, service, round(sum(self_ms), 6) as self_ms, count(*) as n_spans, round(case when sum(sum(self_ms)) over (partition by trace_id) > 0 then sum(self_ms) / sum(sum(self_ms)) over (partition by trace_id) else 0 end, 9) as share from selfs group by trace_id, service"))
def time_per_service(spark, sf_dir):
    return traces.time_per_service(traces.self_times(spans(spark, sf_dir))).withColumns(r6("self_ms") | {"share": F.round("share", 9)})


@query(sql(SELF, "select * from (select trace_id, span_id, round(self_ms, 6) as self_ms, cast(row_number() over (partition by trace_id order by selfs.self_ms desc, span_id) as integer) as rank from selfs) where rank <= 10"))
def top_self_time(spark, sf_dir):
    return traces.top_self_time(traces.self_times(spans(spark, sf_dir)), 10).select("trace_id", "span_id", "self_ms", "rank").withColumns(r6("self_ms"))


@query(sql(ONE, "select unnest(['http.request.method', 'http.route', 'url.full', 'user.id']) as key"))
def root_attr_keys(spark, sf_dir):
    return traces.root_attr_keys(_summaries(spark, sf_dir))


@query(sql(RAW, "select distinct trace_id from raw where starts_with(trace_id, '0000000000000000000000000000001') order by 1 limit 6"))
def resolve_trace_prefix(spark, sf_dir):
    return traces.resolve_trace_prefix(spans(spark, sf_dir), "0000000000000000000000000000001")


_CALLS = f"""{ONE}, peers as (select distinct service from one),
targeted as (
  select one.*, case when db_system is not null then concat('db:', db_system, ':', coalesce(db_namespace, db_system)) when msg_system is not null then concat('queue:', msg_system, ':', coalesce(msg_destination, msg_system))
    when kind = 'CLIENT' and server_address is not null and p.service is null then concat('ext:', server_address) end as target_id,
    case when db_system is not null then 'database' when msg_system is not null then 'queue' when kind = 'CLIENT' and server_address is not null and p.service is null then 'external' end as target_type
  from one left join peers p on p.service = server_address),
joined as (
  select t.*, p.service as p_service, p.kind as p_kind, p.duration_ms as p_ms,
    left(coalesce(case when http_route is not null then concat_ws(' ', http_method, http_route) when db_operation is not null then concat_ws(' ', db_operation, db_collection) end, t.name), 200) as operation
  from targeted t left join (select trace_id, span_id, service, kind, duration_ms from one) p on t.trace_id = p.trace_id and t.parent_span_id = p.span_id),
calls as (
  select trace_id, span_id, end_ms, instance_id, code_file, code_line, status_code = 'ERROR' as is_error, operation, cast(null as varchar) as source, 'svc:' || service as target, 'service' as type, duration_ms as ms
  from joined where parent_span_id is null or (p_service is not null and p_service <> service)
  union all select trace_id, span_id, end_ms, instance_id, code_file, code_line, status_code = 'ERROR', operation, 'svc:' || p_service, 'svc:' || service, 'service', case when p_kind in ('CLIENT', 'PRODUCER') then p_ms else duration_ms end
  from joined where p_service is not null and p_service <> service
  union all select trace_id, span_id, end_ms, instance_id, code_file, code_line, status_code = 'ERROR', operation, null, target_id, target_type, duration_ms from joined where target_id is not null
  union all select trace_id, span_id, end_ms, instance_id, code_file, code_line, status_code = 'ERROR', operation, 'svc:' || service, target_id, target_type, duration_ms from joined where target_id is not null)"""


@query(sql(_CALLS, "select trace_id, span_id, is_error, operation, source, target, type, round(ms, 6) as ms from calls"))
def calls(spark, sf_dir):
    return servicemap.calls(spans(spark, sf_dir)).select("trace_id", "span_id", "is_error", "operation", "source", "target", "type", "ms").withColumns(r6("ms"))


@query(sql(_CALLS, "select source, target, count(*) as n_calls, count(*) filter (is_error) as n_errors from calls where source is not null group by all"))
def service_graph(spark, sf_dir):
    return servicemap.service_graph(spans(spark, sf_dir))


RANGE_MS = 200 * 86_400_000.0
_BOUNDS = f"""{_CALLS}, ends as (select max(end_ms) as anchor_ms, min(end_ms) as oldest_ms from raw),
bounds as (select anchor_ms, oldest_ms, greatest(anchor_ms - {RANGE_MS}, oldest_ms) as from_ms, anchor_ms - {RANGE_MS} < oldest_ms as is_partial,
  case when anchor_ms - greatest(anchor_ms - {RANGE_MS}, oldest_ms) >= 10000 then (anchor_ms - greatest(anchor_ms - {RANGE_MS}, oldest_ms)) / 60000 end as minutes from ends)"""


@query(sql(_BOUNDS, "select cast(anchor_ms as bigint) as anchor_ms, cast(oldest_ms as bigint) as oldest_ms, cast(from_ms as bigint) as from_ms, is_partial, round(minutes, 6) as minutes from bounds"))
def window_bounds(spark, sf_dir):
    return servicemap.window_bounds(spans(spark, sf_dir), RANGE_MS).withColumns(r6("minutes") | whole("anchor_ms", "oldest_ms", "from_ms"))


_MAP = f"""{_BOUNDS}, map as (
  select source, target, type, count(*) filter (end_ms >= from_ms) as n_calls, count(*) filter (end_ms >= from_ms and is_error) as n_errors,
    quantile_cont(ms, 0.5) filter (end_ms >= from_ms) as p50_ms, quantile_cont(ms, 0.95) filter (end_ms >= from_ms) as p95_ms, max(end_ms) as last_ms, any_value(minutes) as minutes
  from calls, bounds group by all),
rated as (select *, case when n_calls > 0 then n_errors / n_calls end as error_rate, n_calls / minutes as per_minute from map)"""


@query(sql(_MAP, "select source, target, type, n_calls, n_errors, round(p50_ms, 6) as p50_ms, round(p95_ms, 6) as p95_ms, cast(last_ms as bigint) as last_ms, round(error_rate, 6) as error_rate, round(per_minute, 6) as per_minute from rated"))
def service_map(spark, sf_dir):
    return servicemap.service_map(spans(spark, sf_dir), RANGE_MS).withColumns(r6("p50_ms", "p95_ms", "error_rate", "per_minute") | whole("last_ms"))


_LEVEL = "greatest(case when error_rate >= 0.05 then 2 when error_rate >= 0.01 then 1 else 0 end, case when p95_ms >= 2000 then 2 when p95_ms >= 500 then 1 else 0 end)"


@query(sql(_MAP, f"""select source, target, case when n_calls = 0 then 'idle' when lvl = 2 and n_calls >= 5 then 'bad' when lvl >= 1 then 'warn' else 'ok' end as health
  from (select *, {_LEVEL} as lvl from rated)"""))
def service_health(spark, sf_dir):
    found = servicemap.service_map(spans(spark, sf_dir), RANGE_MS)
    return found.select("source", "target", servicemap.health(F.col("n_calls"), F.col("error_rate"), F.col("p95_ms")).alias("health"))


@query(sql(f"""{_BOUNDS}, inside as (select target, is_error, cast(least(29, floor((end_ms - from_ms) / ((anchor_ms - from_ms) / 30))) as integer) as bucket from calls, bounds where source is null and end_ms >= from_ms),
  spine as (select target, cast(unnest(range(30)) as integer) as bucket from (select distinct target from inside)),
  c as (select target, bucket, count(*) as n, count(*) filter (is_error) as e from inside group by all)""",
  "select target, bucket, coalesce(n, 0) as n_calls, coalesce(e, 0) as n_errors from spine left join c using (target, bucket)"))
def sparklines(spark, sf_dir):
    return servicemap.sparklines(spans(spark, sf_dir), RANGE_MS)


@query(sql(_MAP, "select target, type, n_calls, row_number() over (order by type <> 'service', n_calls desc, last_ms desc, target) > 12 and type <> 'service' as is_hidden from rated where source is null"))
def cap_nodes(spark, sf_dir):
    nodes = servicemap.service_map(spans(spark, sf_dir), RANGE_MS).where("source is null")
    return servicemap.cap_nodes(nodes, 12).select("target", "type", "n_calls", "is_hidden")


@query(sql(f"{_CALLS}, ops as (select target, operation, count(*) as n_calls, count(*) filter (is_error) as n_errors, round(quantile_cont(ms, 0.95), 6) as p95_ms from calls where source is null group by all)",
           "select * from (select *, cast(row_number() over (partition by target order by n_calls desc, operation) as integer) as rank from ops) where rank <= 10"))
def node_operations(spark, sf_dir):
    return servicemap.node_operations(spans(spark, sf_dir)).withColumns(r6("p95_ms"))


@query(sql(f"{_CALLS}, t as (select target, trace_id, max(ms) as ms, max(end_ms) filter (is_error) as failed_ms from calls where source is null group by all)",
           """select target, 'failing' as list, cast(rank as integer) as rank, trace_id, round(ms, 6) as ms from (select *, row_number() over (partition by target order by failed_ms desc, trace_id) as rank from t where failed_ms is not null) where rank <= 5
  union all select target, 'slowest', cast(rank as integer), trace_id, round(ms, 6) from (select *, row_number() over (partition by target order by ms desc, trace_id) as rank from t) where rank <= 5"""))  # fmt: skip
def node_traces(spark, sf_dir):
    return servicemap.node_traces(spans(spark, sf_dir)).withColumns(r6("ms"))


@query(sql(f"{_CALLS}, e as (select source, target, count(*) as n_calls, count(*) filter (is_error) as n_errors, round(quantile_cont(ms, 0.95), 6) as p95_ms from calls where source is not null group by all)",
           "select target, 'inbound' as way, source as peer, n_calls, n_errors, p95_ms from e union all select source, 'outbound', target, n_calls, n_errors, p95_ms from e"))
def node_edges(spark, sf_dir):
    return servicemap.node_edges(spans(spark, sf_dir)).withColumns(r6("p95_ms"))


@query(sql(_CALLS, "select target, instance_id, count(*) as n_calls, count(*) filter (is_error) as n_errors, cast(floor(max(end_ms)) as bigint) as last_ms from calls where source is null and type = 'service' group by 1, 2"))
def node_instances(spark, sf_dir):
    return servicemap.node_instances(spans(spark, sf_dir)).withColumns(whole("last_ms"))


@query(sql(ONE, "select service, round(quantile_cont(duration_ms, 0.5), 6) as p50_ms, round(quantile_cont(duration_ms, 0.95), 6) as p95_ms, round(quantile_cont(duration_ms, 0.99), 6) as p99_ms from one group by 1"))
def duration_quantiles(spark, sf_dir):
    return traces.duration_quantiles(traces.dedupe_spans(spans(spark, sf_dir)), "service").withColumns(r6("p50_ms", "p95_ms", "p99_ms"))


@query(sql(f"{_CALLS}, s as (select target, code_file, code_line, count(*) as n_calls from calls where source is null and code_file is not null group by all)",
           "select * from (select *, cast(row_number() over (partition by target order by n_calls desc, code_file, code_line) as integer) as rank from s) where rank <= 10"))
def node_sources(spark, sf_dir):
    return servicemap.node_sources(spans(spark, sf_dir))


@query(sql(ONE, """select operation, count(*) as n_spans from (select left(coalesce(case when http_route is not null then concat_ws(' ', http_method, http_route)
  when db_operation is not null then concat_ws(' ', db_operation, db_collection) end, name), 200) as operation from one) group by all"""))
def operation_keys(spark, sf_dir):
    one = traces.dedupe_spans(spans(spark, sf_dir))
    return one.groupBy(scalars.operation_key(F.col("name"), F.col("attrs")).alias("operation")).agg(F.count("*").alias("n_spans"))


@query(sql(f"{SUMMARY}, f as (select trace_id from one group by 1 having bool_or(kind = 'CLIENT' and duration_ms >= 500) and bool_or(contains(name, 'line-3')))", f"select {_SUMMARY_COLUMNS} from summary where trace_id in (select trace_id from f) and n_errors > 0"))
def filter_traces(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return _shown(traces.filter_traces(rows, traces.trace_summaries(rows), (F.col("kind") == "CLIENT") & (F.col("duration_ms") >= 500), F.col("n_errors") > 0, ("LINE-3",)))


_TARGET = "0" * 30 + "0a"


_PEERS = f"""{SUMMARY.removeprefix(ONE + ", ")}, t as (select * from summary where trace_id = '{_TARGET}'),
  same_root as (select s.* from summary s join t on s.root_service = t.root_service and s.root_name = t.root_name and s.trace_id <> t.trace_id),
  peers as (select trace_id, duration_ms from same_root where n_errors = 0 or not exists (select 1 from same_root where n_errors = 0) order by start_ms desc, trace_id limit 50)"""


@query(sql(SELF + f""", {_PEERS}, g as (select trace_id, service, name, sum(self_ms) as v, count(*) filter (status_code = 'ERROR') as e, arg_min(span_id, row(-self_ms, span_id)) as top from selfs group by 1, 2, 3),
  k as (select distinct service, name from g where trace_id = '{_TARGET}' or trace_id in (select trace_id from peers)),
  m as (select service, name, quantile_cont(coalesce(v, 0), 0.5) as m, count(v) as c, sum(e) as pe from k cross join peers p left join g using (trace_id, service, name) group by 1, 2)""",
  f"""select service, name, round(coalesce(v, 0), 6) as self_ms, round(coalesce(m, 0), 6) as median_ms, case when v is null then 'missing' when coalesce(c, 0) = 0 then 'new' else 'both' end as state,
  coalesce(e, 0) as n_errors, coalesce(e, 0) > 0 and coalesce(pe, 0) = 0 as is_newly_failing, top as top_span_id, round(case when m > 0 then coalesce(v, 0) / m end, 6) as ratio
  from k left join m using (service, name) left join (select * from g where trace_id = '{_TARGET}') x using (service, name)"""))  # fmt: skip
def compare_trace(spark, sf_dir):
    rows = spans(spark, sf_dir)
    found = traces.compare_trace(traces.self_times(rows), traces.trace_summaries(rows), _TARGET)
    return found.drop("excess_ms").withColumns(r6("self_ms", "median_ms", "ratio"))


@query(sql(f"{ONE}, {_PEERS}, m as (select quantile_cont(duration_ms, 0.5) as m, count(*) as n from peers)",
           "select trace_id, round(duration_ms, 6) as duration_ms, round(m, 6) as baseline_ms, n as n_peers from peers cross join m order by abs(duration_ms - m), trace_id limit 1"))
def representative_peer(spark, sf_dir):
    peers = traces.comparison_peers(_summaries(spark, sf_dir), _TARGET)
    return traces.representative_peer(peers).withColumns(r6("duration_ms", "baseline_ms"))


@query("with recursive " + ONE + f""", t as (select trace_id, span_id, 0 as depth from one where trace_id = '{_TARGET}' and parent_span_id is null
  union all select o.trace_id, o.span_id, t.depth + 1 from one o join t on o.trace_id = t.trace_id and o.parent_span_id = t.span_id) select span_id, cast(depth as integer) as depth from t""")
def subtree(spark, sf_dir):
    return tree.subtree(spans(spark, sf_dir), _TARGET, "00000000000000a0").select("span_id", "depth")


_TLOGS = f"tlogs as ({duckdb(TRACE_LOGS)})"
_RANGE_MS = 365 * 86_400_000


@query(sql(f"{SUMMARY}, {_TLOGS}, n as (select trace_id, count(*) as n_logs from tlogs group by 1)",
           f"""select {_SUMMARY_COLUMNS}, coalesce(n_logs, 0) as n_logs, http_route as route, u.user_id as "user" from summary left join n using (trace_id)
  join (select trace_id, span_id as root_span_id, user_id from one) u using (trace_id, root_span_id)
  where start_ms >= (select max(start_ms) from summary) - {_RANGE_MS}"""))  # fmt: skip
def trace_list(spark, sf_dir):
    counts = log_ops.log_counts(logs(spark, sf_dir, TRACE_LOGS), "trace_id")
    rows = traces.trace_list(_summaries(spark, sf_dir), counts, _RANGE_MS, ("http.route", "user.id"))
    return rows.select(*_shown(rows).columns, "n_logs", F.col("`http.route`").alias("route"), F.col("`user.id`").alias("user")).withColumns(r6("duration_ms") | whole("start_ms") | {"services": F.array_join("services", ",")})


# Pairs (key, column) of the attributes that are useful, in key order.
_USEFUL = {
    "db.collection.name": "db_collection", "db.namespace": "db_namespace", "db.operation.name": "db_operation", "db.system": "db_system",
    "http.request.method": "http_method", "http.route": "http_route", "messaging.destination.name": "msg_destination",
    "messaging.system": "msg_system", "server.address": "server_address", "url.full": "url_full",
}


@query(sql(ONE, f"select trace_id, span_id, concat_ws(';', {', '.join(f"'{k}=' || {c}" for k, c in _USEFUL.items())}) as attrs from one"))
def useful_attrs(spark, sf_dir):
    kept = F.map_entries(traces.useful_attrs(F.col("attrs")))
    return traces.dedupe_spans(spans(spark, sf_dir)).select("trace_id", "span_id", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attrs"))


@query(sql(f"{ONE}, k as (select *, cast(duration_ms as bigint) % 15 + 1 as n from one where status_code = 'ERROR')", """
  select trace_id, span_id, least(3, (n + 1) // 2) as n_exceptions, array_to_string(list_slice(list_sort(list_concat(['exception'],
    list_transform(range(1, n // 2 + 1), lambda i: 'retry ' || lpad(cast(i as varchar), 2, '0')))), 1, 10), ',') as event_names from k"""))
def trace_errors(spark, sf_dir):
    """Failing spans; their events alternate between exceptions and retries, as many as the duration says."""
    name = lambda i: F.when(i % 2 == 1, "exception").otherwise(F.concat(F.lit("retry "), F.lpad((i / 2).cast("int").cast("string"), 2, "0")))
    events = F.transform(F.sequence(F.lit(1), (F.col("duration_ms").cast("bigint") % 15 + 1).cast("int")), lambda i: F.struct(name(i).alias("name")))
    found = traces.trace_errors(spans(spark, sf_dir).withColumn("events", events))
    return found.select("trace_id", "span_id", F.size("exceptions").cast("bigint").alias("n_exceptions"), F.array_join("event_names", ",").alias("event_names"))


@query(sql(f"{ONE}, l as (select trace_id, span_id, lpad(lower(to_hex(cast('0x' || right(trace_id, 12) as bigint) * 2)), 32, '0') as linked_trace_id from one)",
           "select trace_id, span_id, linked_trace_id from l where linked_trace_id in (select trace_id from one)"))
def linked_traces(spark, sf_dir):
    """Links from every span to the trace of twice its trace's number, where there is one."""
    target = F.lpad(F.lower(F.hex(F.conv(F.right("trace_id", F.lit(12)), 16, 10).cast("bigint") * 2)), 32, "0")
    linked = traces.linked_traces(spans(spark, sf_dir).withColumn("links", F.array(F.struct(target.alias("trace_id")))))
    return linked.select("trace_id", "span_id", "linked_trace_id")
