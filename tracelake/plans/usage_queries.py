"""Queries over volume, cardinality and cost, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracelake.operators import summaries, templates, traces, usage
from tracelake.operators.store import shared_dir, stored
from tracelake.plans import fixtures
from tracelake.plans.fixtures import LOGS, POINTS, duckdb
from tracelake.plans.span_queries import ONE, r6, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def _vi(n: str) -> str:
    return f"(case when ({n}) < 128 then 1 when ({n}) < 16384 then 2 when ({n}) < 2097152 then 3 else 4 end)"


def _fr(n: str) -> str:
    return f"(1 + {_vi(n)} + ({n}))"


_ATTR = _fr(f"{_fr('strlen(k)')} + {_fr(_fr('strlen(v)'))}")
_SPAN_ATTRS = "[('http.route', http_route), ('http.request.method', http_method), ('user.id', user_id), ('url.full', url_full), ('db.system', db_system), ('db.namespace', db_namespace), ('db.operation.name', db_operation), ('db.collection.name', db_collection), ('messaging.system', msg_system), ('messaging.destination.name', msg_destination), ('server.address', server_address)]"


def _each(source: str, id_: str, attrs: str, scope: str, metric: str = "cast(null as varchar)") -> str:
    return f"select service, signal, scope, metric, time_ms, id, a[1] as k, a[2] as v from (select {id_}, '{scope}' as scope, {metric} as metric, unnest({attrs}) as a from {source}) where a[2] is not null"


_RECORDS = f"""{ONE}, logs as ({duckdb(LOGS)}), points as ({duckdb(POINTS)}),
sa as ({_each("one", "service, 'traces' as signal, end_ms as time_ms, span_id || trace_id as id", _SPAN_ATTRS, "span")}),
la as ({_each("logs", "service, 'logs' as signal, time_ms, cast(seq as varchar) as id", "[('k', attr_k), ('user.id', attr_user)]", "log")}),
pa as ({_each("points", "split_part(instance_id, '::', 1) as service, 'metrics' as signal, time_ms, metric || seq as id", "[('type', event_type), ('shard', shard)]", "metric", "metric")}),
attrs as (select *, {_ATTR} as b from (select * from sa union all select * from la union all select * from pa)),
sums as (select signal, id, sum(b) as b from attrs group by 1, 2),
flat as (
  select service, 'traces' as signal, end_ms as time_ms, span_id || trace_id as id, {_fr('strlen(name)')} + 28 + case when parent_span_id is null then 0 else 10 end + 2 + 18 + case when status_code = 'UNSET' then 0 else 4 end as own from one
  union all select service, 'logs', time_ms, cast(seq as varchar), 9 + 2 + {_fr(_fr('strlen(body)'))} + 28 from logs
  union all select split_part(instance_id, '::', 1), 'metrics', time_ms, metric || seq, 18 from points),
recs as (select service, signal, id, time_ms, cast({_fr('own + coalesce(b, 0)')} as bigint) as bytes from flat left join sums using (signal, id))"""


def _records(spark, sf_dir, one=None):
    one = traces.dedupe_spans(fixtures.spans(spark, sf_dir)) if one is None else one
    points = fixtures.points(spark, sf_dir).withColumn("service", F.split_part(F.col("instance_id"), F.lit("::"), F.lit(1)))
    return usage.records(one, fixtures.logs(spark, sf_dir), points)


@query(sql(_RECORDS, "select service, signal, cast(grouping(service, signal) as bigint) as level, count(*) as n_records, cast(sum(bytes) as bigint) as bytes from recs group by rollup (service, signal)"))
def volume(spark, sf_dir):
    return usage.volume(_records(spark, sf_dir))


@query(sql(f"""{_RECORDS}, w as (select cast(greatest(1, ceil((floor(max(time_ms) / 60000) - floor(min(time_ms) / 60000) + 1) / 60)) * 60000 as bigint) as width, max(time_ms) as hi from recs),
  b as (select signal, cast(floor(time_ms / width) as bigint) as slot, count(*) as n, sum(bytes) as b from recs, w group by 1, 2),
  s as (select unnest(['traces', 'logs', 'metrics']) as signal, slot, width from (select unnest(range(cast(floor(hi / width) as bigint) - 59, cast(floor(hi / width) as bigint) + 1)) as slot, width from w))""",
  "select signal, slot * width as from_ms, coalesce(n, 0) as n_records, cast(coalesce(b, 0) as bigint) as bytes from s left join b using (signal, slot)"))
def volume_over_time(spark, sf_dir):
    return usage.volume_over_time(_records(spark, sf_dir))


@query(sql(f"""{_RECORDS}, ends as (select min(time_ms) as lo, max(time_ms) as hi from recs),
  span as (select *, greatest(lo, (floor(hi / 60000) - 14) * 60000) as from_ms from ends),
  w as (select from_ms, greatest(1.0, (hi - from_ms) / 60000) as minutes from span),
  c as (select signal, count(*) as n, sum(bytes) as b from recs, w where time_ms >= from_ms group by 1),
  s as (select unnest(['traces', 'logs', 'metrics']) as signal)""",
  "select signal, round(minutes, 6) as minutes, round(coalesce(n, 0) / minutes, 6) as records_per_minute, round(coalesce(b, 0) / minutes, 6) as bytes_per_minute from s left join c using (signal), w"))
def rates_per_minute(spark, sf_dir):
    return usage.rates_per_minute(_records(spark, sf_dir)).withColumns(r6("minutes", "records_per_minute", "bytes_per_minute"))


_VALUES = f"{_RECORDS}, vals as (select service, signal, scope, metric, k as key, v as value, count(*) as n, sum(b) as bytes, min(time_ms) as first_ms from attrs group by 1, 2, 3, 4, 5, 6)"
_STATS = f"""{_VALUES}, stats as (select s.*, n_distinct / occurrences as ratio, s.bytes / r.bytes as share from
  (select service, signal, scope, metric, key, count(*) as n_distinct, cast(sum(n) as bigint) as occurrences, cast(sum(bytes) as bigint) as bytes from vals group by 1, 2, 3, 4, 5) s
  join (select service, signal, sum(bytes) as bytes from recs group by 1, 2) r using (service, signal))"""


@query(sql(_STATS, "select service, signal, scope, metric, key, n_distinct, occurrences, bytes, round(ratio, 6) as ratio, round(share, 6) as share from stats"))
def attribute_stats(spark, sf_dir):
    return usage.attribute_stats(_records(spark, sf_dir)).drop("class").withColumns(r6("ratio", "share"))


#: Classes of the values that the views hold: numbers of six digits or more are ids, addresses with a query say so.
_CLASSES = """kinds as (select *, case when regexp_matches(value, '^[0-9]{6,}$') then 'numericId' when value like 'https://%?%=%' then 'urlQuery' else 'other' end as class from vals),
  class_counts as (select service, signal, scope, metric, key, class, count(*) as k from kinds group by all),
  classes as (select service, signal, scope, metric, key, case when max(k) >= 0.8 * sum(k) then arg_max(class, (k, class)) end as class from class_counts group by 1, 2, 3, 4, 5)"""


@query(sql(f"{_VALUES}, {_CLASSES}", "select * from classes"))
def dominant_class(spark, sf_dir):
    return usage.attribute_stats(_records(spark, sf_dir)).select(*usage.KEYS, "class")


WIDTH_MS = 60 * 86_400_000
_GROWTH = f"""{_VALUES}, n as (select service, signal, scope, metric, key, floor(first_ms / {WIDTH_MS}) as slot, count(*) as new from vals group by all),
  e as (select *, min(slot) over w as lo, max(slot) over w - min(slot) over w as steps from n window w as (partition by service, signal, scope, metric, key)),
  t as (select *, slot - lo - 1 as step, greatest(1, floor(steps / 3)) as third from e),
  g as (select service, signal, scope, metric, key, case when steps < 3 then 'insufficient' when sum(case when step >= 0 and step >= steps - third then new else 0 end) > 0
    and sum(case when step >= 0 and step >= steps - third then new else 0 end) >= 0.5 * sum(case when step >= 0 and step < third then new else 0 end) then 'growing' else 'saturated' end as growth from t group by service, signal, scope, metric, key, steps)"""


@query(sql(_GROWTH, "select * from g"))
def distinct_growth(spark, sf_dir):
    return usage.distinct_growth(usage.values(_records(spark, sf_dir)), WIDTH_MS)


@query(sql(ONE, "select service, count(*) as n_names, count(*) filter (regexp_matches(name, '(^|[/ ])[0-9]+($|[/ ])')) as n_with_ids from (select distinct service, name from one) group by 1"))
def span_name_stats(spark, sf_dir):
    return usage.span_name_stats(traces.dedupe_spans(fixtures.spans(spark, sf_dir)))


@query(sql(ONE, """select service, name, cast(sum(n) as bigint) as n_spans, cast(sum(e) as bigint) as n_errors from (select service, case when row_number() over (partition by service order by n desc, name) <= 5 then name else '(other)' end as name, n, e
  from (select service, name, count(*) as n, count(*) filter (status_code = 'ERROR') as e from one group by 1, 2)) group by 1, 2"""))
def operation_stats(spark, sf_dir):
    return usage.operation_stats(traces.dedupe_spans(fixtures.spans(spark, sf_dir)), 5).drop("bytes")


_SERIES = f"series as (select split_part(instance_id, '::', 1) as service, metric, instance_id, event_type, shard, count(*) as n_points, min(time_ms) as first_ms, max(time_ms) as last_ms from ({duckdb(POINTS)}) p group by all)"
_ALIVE = """moves as (select metric, first_ms as t, 0 as is_end, 1 as d from series union all select metric, last_ms + 300000, 1, -1 from series),
  alive as (select metric, sum(d) over (partition by metric order by t, is_end, d rows unbounded preceding) as n from moves), peaks as (select metric, max(n) as peak_series from alive group by 1)"""


@query(sql(f"{_SERIES}, {_ALIVE}", """select metric, count(*) as n_series, cast(any_value(peak_series) as bigint) as peak_series, case when count(distinct shard) >= count(distinct event_type) then 'shard' else 'type' end as driver,
  greatest(count(distinct shard), count(distinct event_type)) as driver_distinct from series join peaks using (metric) group by 1"""))
def metric_series_stats(spark, sf_dir):
    return usage.metric_series_stats(fixtures.points(spark, sf_dir))


#: One series for each customer: the sum of his orders.
_SPENT = "select concat('c', cast(o_custkey % 4 as string)) as service, concat('c', cast(o_custkey % 4 as string), '::i0') as instance_id, 'orders.spent' as metric, cast(o_custkey as string) as customer, MS(o_orderdate) as time_ms, o_orderkey as seq from {orders}"


@query(sql(f"spent as ({duckdb(_SPENT)}), series as (select 'c' as metric, customer, service, min(time_ms) as first_ms, max(time_ms) as last_ms from spent group by all)",
           """select service, count(*) as n_series, (select cast(max(n) as bigint) from (select sum(d) over (order by t, is_end, d rows unbounded preceding) as n from (
  select first_ms as t, 0 as is_end, 1 as d from series i where i.service = o.service union all select last_ms + 300000, 1, -1 from series i where i.service = o.service))) as peak_series from series o group by 1"""))  # fmt: skip
def active_series(spark, sf_dir):
    """Customers between their first order and five minutes after their last."""
    points = fixtures.view(spark, sf_dir, _SPENT).withColumn("attrs", F.create_map(F.lit("customer"), "customer"))
    return usage.active_series(usage.series_of(points), ["service"])


def _points(spark, sf_dir):
    return fixtures.points(spark, sf_dir).withColumn("service", F.split_part(F.col("instance_id"), F.lit("::"), F.lit(1)))


def _findings(spark, sf_dir):
    """Limits that the views reach: 3 series a metric, half of a service's logs of one template."""
    one = stored(traces.dedupe_spans(fixtures.spans(spark, sf_dir)))
    logs = fixtures.logs(spark, sf_dir)
    found = templates.log_templates(logs.where("severity_number in (1, 5)").withColumn("body", F.regexp_replace("body", "^click", "view")))
    return usage.findings(_records(spark, sf_dir, one), one, _points(spark, sf_dir), found, WIDTH_MS, max_series=3)


_RULES = f"""{_GROWTH}, {_STATS.split(_VALUES + ", ")[1]}, {_CLASSES}, {_SERIES},
  whole as (select service, signal, sum(bytes) as whole from recs group by 1, 2),
  flags as (select s.*, c.class, g.growth, s.scope <> 'metric' and n_distinct >= 100 and ratio >= 0.1 as high,
    (coalesce(c.class in ('uuid', 'hexId', 'numericId', 'token', 'email', 'ip', 'timestamp', 'urlQuery', 'pathId'), false) or s.key in ('url.full', 'user.id', 'messaging.destination.name')) and n_distinct >= 20 as id_like
    from stats s join classes c on (s.service, s.signal, s.scope, s.key) = (c.service, c.signal, c.scope, c.key) and s.metric is not distinct from c.metric
    join g on (s.service, s.signal, s.scope, s.key) = (g.service, g.signal, g.scope, g.key) and s.metric is not distinct from g.metric),
  attr_rules as (select case when high then 'R1' else 'R2' end as rule, case when scope = 'metric' or (high and n_distinct >= 1000 and share >= 0.2) then 2 else 1 end as lev,
    service, signal, scope, metric, key, n_distinct, occurrences, bytes, share, class, growth, null as driver, case key when 'url.full' then 'url' when 'user.id' then 'user' when 'messaging.destination.name' then 'destination' else class end as hint from flags where high or id_like),
  series_slots as (select service, metric, floor(first_ms / {WIDTH_MS}) as slot, count(*) as new from series group by all),
  series_steps as (select *, max(slot) over w - min(slot) over w as steps, slot - min(slot) over w - 1 as step from series_slots window w as (partition by service, metric)),
  series_growth as (select service, metric, case when steps < 3 then 'insufficient' when sum(case when step >= 0 and step >= steps - greatest(1, floor(steps / 3)) then new else 0 end) > 0
    and sum(case when step >= 0 and step >= steps - greatest(1, floor(steps / 3)) then new else 0 end) >= 0.5 * sum(case when step >= 0 and step < greatest(1, floor(steps / 3)) then new else 0 end) then 'growing' else 'saturated' end as growth from series_steps group by service, metric, steps),
  metric_bytes as (select split_part(instance_id, '::', 1) as service, metric, sum({_fr("18 + " + _ATTR.replace("strlen(k)", "4").replace("strlen(v)", "strlen(event_type)") + " + " + _ATTR.replace("strlen(k)", "5").replace("strlen(v)", "strlen(shard)"))}) as bytes from points group by 1, 2),
  series_rules as (select 'R3' as rule, case when count(*) >= 30 then 2 else 1 end as lev, service, 'metrics' as signal, null as scope, null as metric, metric as key, count(*) as n_distinct, cast(sum(n_points) as bigint) as occurrences,
    cast(any_value(bytes) as bigint) as bytes, any_value(bytes) / any_value(whole) as share, null as class, any_value(growth) as growth, case when count(distinct shard) >= count(distinct event_type) then 'shard' else 'type' end as driver, null as hint
    from series join metric_bytes using (service, metric) join series_growth using (service, metric) join whole w using (service) where w.signal = 'metrics' group by service, metric having count(*) >= 3),
  names as (select service, count(*) as n, count(*) filter (regexp_matches(name, '(^|[/ ])[0-9]+($|[/ ])')) as ids from (select distinct service, name from one) group by 1),
  name_rules as (select 'R4' as rule, case when n >= 1000 then 2 else 1 end as lev, service, 'traces' as signal, null as scope, null as metric, 'span names' as key, n as n_distinct, ids as occurrences, 0::bigint as bytes, 0.0 as share,
    case when n >= 5 and ids / n >= 0.2 then 'pathId' end as class, 'insufficient' as growth, null as driver, 'route' as hint from names where n >= 100 or (n >= 5 and ids / n >= 0.2)),
  noisy as (select service, count(*) as n, sum(strlen(body) - case when body like 'click%' then 1 else 0 end) as bytes from logs where severity_number in (1, 5) group by 1),
  template_rules as (select 'R6' as rule, 0 as lev, service, 'logs' as signal, null as scope, null as metric, 'view user=<NUM> value=<NUM>' as key, 1::bigint as n_distinct, n as occurrences, cast(bytes as bigint) as bytes, bytes / whole as share,
    null as class, 'insufficient' as growth, null as driver, 'noisy' as hint from noisy join whole using (service) where signal = 'logs' and n >= 100),
  rules as (select *, least(2, lev + case when growth = 'growing' then 1 else 0 end) as lev2 from (select * from attr_rules union all select * from series_rules union all select * from name_rules union all select * from template_rules)),
  found as (select rule, case lev2 when 2 then 'critical' when 1 then 'warning' else 'info' end as severity, service, signal, scope, metric, key, n_distinct, occurrences, bytes, round(share, 6) as share, class, growth, driver, hint from rules)"""


@query(sql(_RULES, "select * from found"))
def findings(spark, sf_dir):
    return _findings(spark, sf_dir).withColumns(r6("share"))


@query(sql(_RULES, "select service, signal, severity, cast(grouping(service, signal, severity) as bigint) as level, count(*) as n_findings from found group by cube (service, signal, severity)"))
def finding_counts(spark, sf_dir):
    return usage.finding_counts(_findings(spark, sf_dir))


@query(sql(_RULES, "select service, count(*) filter (severity = 'critical') as n_critical, count(*) filter (severity = 'warning') as n_warning, count(*) as n_findings from found group by 1"))
def noisy_services(spark, sf_dir):
    return usage.noisy_services(_findings(spark, sf_dir))


@query(sql(_RECORDS, "select service, cast(sum(bytes) as bigint) as bytes, count(*) as n_records from recs group by 1 order by 2 desc, 1 limit 10"))
def top_services(spark, sf_dir):
    return usage.top_services(_records(spark, sf_dir), 10)


@query(sql(f"{_RECORDS}, d as (select sum(bytes) as b, count(*) filter (signal = 'traces') as s, count(*) filter (signal = 'logs') as l from recs), i as (select b / 1e9 * 30 as g, s * 30 / 1e6 as ms, l * 30 / 1e6 as ml from d)",
           "select 'ingest' as item, round(g, 6) as quantity, round(g * 0.5, 6) as monthly from i union all select 'spans', round(ms, 6), round(ms * 2, 6) from i union all select 'logs', round(ml, 6), round(ml * 1.5, 6) from i union all select 'total', null, round(g * 0.5 + ms * 2 + ml * 1.5, 6) from i"))
def estimate_cost(spark, sf_dir):
    daily = _records(spark, sf_dir).agg(F.sum("bytes").alias("bytes"), F.count_if(F.col("signal") == "traces").alias("n_spans"), F.count_if(F.col("signal") == "logs").alias("n_logs"))
    return usage.estimate_cost(daily, 0.5, 2.0, 1.5).withColumns(r6("quantity", "monthly"))


_PER_DAY = f"""{_RECORDS}, ends as (select min(time_ms) as lo, max(time_ms) as hi from recs),
  span as (select *, greatest(lo, (floor(hi / 60000) - 14) * 60000) as from_ms from ends),
  w as (select from_ms, greatest(1.0, (hi - from_ms) / 60000) as minutes from span),
  ser as (select count(*) as n_series from (select distinct metric, instance_id, event_type, shard from points)),
  d as (select coalesce(sum(bytes), 0) / any_value(minutes) * 1440 as bytes, count(*) filter (signal = 'traces') / any_value(minutes) * 1440 as n_spans,
    count(*) filter (signal = 'logs') / any_value(minutes) * 1440 as n_logs, any_value(n_series) as n_series from recs, w, ser where time_ms >= from_ms)"""


def _daily(spark, sf_dir):
    return usage.daily_usage(usage.rates_per_minute(_records(spark, sf_dir)), fixtures.points(spark, sf_dir))


@query(sql(_PER_DAY, "select round(bytes, 4) as bytes, round(n_spans, 4) as n_spans, round(n_logs, 4) as n_logs, n_series from d"))
def daily_usage(spark, sf_dir):
    return _daily(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("bytes", "n_spans", "n_logs")})


@query(sql(f"{_PER_DAY}, i as (select 'ingest' as item, bytes * 2 / 1e9 * 30 as q, 0.5 as price from d union all select 'spans', n_spans * 2 * 30 / 1e6, 2 from d union all select 'series', n_series, 0.05 from d union all select 'retention', bytes * 2 / 1e9 * 90, 0.1 from d)",
           "select item, round(q, 6) as quantity, round(q * price, 6) as monthly from i union all select 'total', null, round(sum(q * price), 6) from i"))
def estimate_cost_retained(spark, sf_dir):
    """Twice the traffic, series and 90 days of retention priced, logs not."""
    return usage.estimate_cost(_daily(spark, sf_dir), 0.5, 2.0, multiplier=2.0, per_series=0.05, per_gb_retained=0.1, retention_days=90).withColumns(r6("quantity", "monthly"))


@query(sql(_RECORDS, """select r.service, name, cast(sum(bytes) as bigint) as bytes, count(*) as n_spans from recs r join one on id = span_id || one.trace_id
  where signal = 'traces' group by 1, 2 order by 3 desc, 1, 2 limit 10"""))
def top_operations(spark, sf_dir):
    return usage.top_operations(traces.dedupe_spans(fixtures.spans(spark, sf_dir)), 10)


@query(sql(f"points as ({duckdb(POINTS)})", f"""select metric, count(distinct (instance_id, event_type, shard)) as n_series,
  cast(sum({_fr("18 + " + _ATTR.replace("strlen(k)", "4").replace("strlen(v)", "strlen(event_type)") + " + " + _ATTR.replace("strlen(k)", "5").replace("strlen(v)", "strlen(shard)"))}) as bigint) as bytes from points group by 1 order by 2 desc, 3 desc, 1 limit 10"""))
def top_metrics(spark, sf_dir):
    return usage.top_metrics(fixtures.points(spark, sf_dir), 10)


@query(f"""with logs as ({duckdb(LOGS)}), p as (select service, split_part(body, ' ', 1) || ' user=<NUM> value=<NUM>' as pattern, strlen(body) as b from logs)
select service, pattern, count(*) as n_logs, cast(sum(b) as bigint) as bytes, round(count(*) * 100 / sum(count(*)) over (partition by service), 6) as share_pct from p group by 1, 2 order by 3 desc, 1, 2 limit 5""")
def top_patterns(spark, sf_dir):
    return usage.top_patterns(templates.log_templates(fixtures.logs(spark, sf_dir))).withColumns(r6("share_pct"))


_CMP = f"""{_RECORDS}, h as (select *, time_ms < 883612800000 as early from attrs where signal = 'traces'),
  c as (select service, signal, k as key, nullif(count(distinct v) filter (early), 0) as n_before, nullif(count(distinct v) filter (not early), 0) as n_after from h group by 1, 2, 3),
  d as (select *, case when n_before is null then 'new' when n_after is null then 'resolved' when n_after >= 2 * n_before and n_after >= 20 then 'grown' end as change from c)"""


@query(sql(_CMP, "select * from d where change is not null"))
def compare_usage(spark, sf_dir):
    rows = _records(spark, sf_dir).where("signal = 'traces'")
    early = F.col("time_ms") < 883612800000
    before, after = (usage.values(rows.where(c)).groupBy("service", "signal", "key").agg(F.count("*").alias("n_distinct")) for c in (early, ~early))
    return usage.compare_usage(before, after)


@query(sql(_VALUES, "select service, signal, scope, metric, key, cast(row_number() over (partition by service, signal, scope, metric, key order by first_ms, value) as integer) as rank, left(value, 120) as sample from vals qualify rank <= 3"))
def sample_values(spark, sf_dir):
    return usage.sample_values(usage.values(_records(spark, sf_dir)))


@query(sql(f"{_VALUES}, {_CLASSES}", "select service, signal, scope, metric, key, case key when 'url.full' then 'url' when 'user.id' then 'user' when 'messaging.destination.name' then 'destination' else nullif(class, 'other') end as hint from classes"))
def remediation_hints(spark, sf_dir):
    stats = usage.attribute_stats(_records(spark, sf_dir))
    return stats.select(*usage.KEYS, usage.remediation_hint(F.col("key"), F.col("class")).alias("hint"))


_SIDES = f"""{_RECORDS}, {_CLASSES.replace(" from vals)", " from side_vals)").replace("kinds as", "side_vals as (select side, service, signal, scope, metric, k as key, v as value, count(*) as n from (select *, time_ms >= 883612800000 as side from attrs where signal = 'traces') group by all),kinds as").replace("select service, signal, scope, metric, key, class, count(*) as k", "select side, service, signal, scope, metric, key, class, count(*) as k").replace("select service, signal, scope, metric, key, case when max(k)", "select side, service, signal, scope, metric, key, case when max(k)").replace("group by 1, 2, 3, 4, 5)", "group by 1, 2, 3, 4, 5, 6)")},
  side_sums as (select side, service, signal, scope, key, count(*) as d, sum(n) as n from side_vals group by all),
  flagged as (select side, service, signal, scope, key, d, class, (d >= 100 and d / n >= 0.1) or ((coalesce(class in ('numericId', 'urlQuery'), false) or key in ('url.full', 'user.id', 'messaging.destination.name')) and d >= 20) as flag
    from side_sums join (select side, service, signal, scope, key, class from classes) using (side, service, signal, scope, key)),
  pairs as (select service, signal, scope, key, b.flag as was, a.flag as now, b.d as base, a.d as current from (select * from flagged where not side) b full join (select * from flagged where side) a using (service, signal, scope, key)),
  marked as (select service, signal, scope, key, case when coalesce(now, false) and not coalesce(was, false) then 'new' when now and was and current >= 2 * base and current - base >= 100 then 'grown' when coalesce(was, false) and not coalesce(now, false) then 'resolved' end as verdict from pairs),
  own as (select *, time_ms >= 883612800000 as side from recs where signal = 'traces'),
  spans_of as (select side, greatest(1.0, (max(time_ms) - min(time_ms)) / 60000) as minutes from own group by 1),
  rates as (select side, service, signal, count(*) / any_value(minutes) as r from own join spans_of using (side) group by 1, 2, 3),
  moved as (select service, signal, coalesce(b.r, 0) as base, coalesce(a.r, 0) as current from (select * from rates where not side) b full join (select * from rates where side) a using (service, signal)
    where service in (select service from own where side) and service in (select service from own where not side)),
  names as (select service, bool_or(side) as later, bool_or(not side) as earlier from own group by 1)"""


@query(sql(_SIDES, """select 'attribute' as kind, verdict, service, signal, scope, key, null::double as base, null::double as current from marked where verdict is not null and service in (select service from own where side)
  union all select 'volume', 'volume', service, signal, null, null, round(base, 6), round(current, 6) from moved where base = 0 or abs(current / base - 1) >= 0.25
  union all select 'service', case when later then 'added' else 'missing' end, service, null, null, null, null, null from names where not (later and earlier)"""))
def usage_changes(spark, sf_dir):
    """Days before 1998 against those after, from a stored table of days."""
    one = traces.dedupe_spans(fixtures.spans(spark, sf_dir))
    rows = usage.records(one, fixtures.logs(spark, sf_dir).where("false"), _points(spark, sf_dir).where("false"))
    path = f"{shared_dir(spark)}/usage/{uuid.uuid4().hex}"
    summaries.save_usage(summaries.usage_days(rows, _points(spark, sf_dir).where("false")), path)
    split = 883_612_800_000 // summaries.DAY_MS
    found = summaries.usage_changes(summaries.load_usage(spark, path, 0, split - 1), summaries.load_usage(spark, path, split, 1 << 40)).drop("metric", "class")
    exact = F.col("kind") == "volume"  # numbers of values are estimates
    return found.withColumns({c: F.when(exact, F.round(c, 6)) for c in ("base", "current")})
