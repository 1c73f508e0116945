"""Spans, logs and metric points derived from the given tables, as SQL that Spark and DuckDB both run.

Each view is one text with three placeholders that differ by engine: hexadecimal ids, milliseconds of a timestamp,
and the tables' names. The Spark side adds the attribute map that the operators expect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = """
select trace_id, span_id, parent_span_id, service, instance_id, name, kind, start_ms, start_ms + duration_ms as end_ms,
  duration_ms, status_code, http_route, http_method, user_id, url_full, db_system, db_namespace, db_operation, db_collection,
  msg_system, msg_destination, server_address, code_file, code_line
from (
  select HEX(o_orderkey + 1, 32) as trace_id, HEX((o_orderkey + 1) * 16, 16) as span_id, cast(null as string) as parent_span_id,
    concat('web-', substr(o_orderpriority, 1, 1)) as service,
    concat('web-', substr(o_orderpriority, 1, 1), '::i', cast(o_custkey % 3 as string)) as instance_id,
    case when o_orderkey % 20 = 0 then concat('POST /orders/', cast(o_orderkey as string)) else 'POST /orders' end as name,
    'SERVER' as kind, MS(o_orderdate) + (o_orderkey % 86400) * 1000 as start_ms, cast(floor(o_totalprice / 100) as double) as duration_ms,
    case when o_orderstatus = 'F' and o_orderkey % 10 = 0 then 'ERROR' when o_orderstatus = 'O' then 'OK' else 'UNSET' end as status_code,
    '/orders' as http_route, 'POST' as http_method, concat('u', cast(o_custkey as string)) as user_id,
    concat('https://shop.example/orders/', cast(o_orderkey as string), '?c=', cast(o_custkey as string)) as url_full,
    cast(null as string) as db_system, cast(null as string) as db_namespace, cast(null as string) as db_operation, cast(null as string) as db_collection,
    cast(null as string) as msg_system, cast(null as string) as msg_destination, cast(null as string) as server_address,
    cast(null as string) as code_file, cast(null as bigint) as code_line
  from {orders}
  union all
  select HEX(l_orderkey + 1, 32), HEX((l_orderkey + 1) * 16 + l_linenumber, 16),
    HEX((l_orderkey + 1) * 16 + case when l_linenumber <= 3 then 0 else l_linenumber - 3 end, 16), service,
    concat(service, '::i', cast(l_suppkey % 2 as string)), concat('line-', cast(l_partkey % 10 as string)),
    case l_returnflag when 'A' then 'CLIENT' when 'R' then 'PRODUCER' else case when l_linestatus = 'O' then 'CLIENT' else 'SERVER' end end,
    root_ms + 20 * l_linenumber + cast(floor(l_quantity) as double), cast(floor(l_extendedprice / 100) as double),
    case when l_discount >= 0.09 then 'ERROR' else 'UNSET' end, null, null, null, null,
    case when l_returnflag = 'A' then 'postgresql' end, case when l_returnflag = 'A' then concat('db', cast(l_suppkey % 5 as string)) end,
    case when l_returnflag = 'A' then 'SELECT' end, case when l_returnflag = 'A' then concat('part', cast(l_partkey % 10 as string)) end,
    case when l_returnflag = 'R' then 'kafka' end, case when l_returnflag = 'R' then concat('topic', cast(l_suppkey % 4 as string)) end,
    case when l_returnflag = 'N' and l_linestatus = 'O' then concat('ext', cast(l_suppkey % 6 as string), '.example.com') end,
    concat('/srv/', service, '.py'), cast(l_partkey % 50 as bigint)
  from (
    select l.*, MS(o_orderdate) + (o_orderkey % 86400) * 1000 as root_ms,
      case l_returnflag when 'A' then concat('web-', substr(o_orderpriority, 1, 1)) when 'R' then 'inventory' else concat('pricing-', cast(l_suppkey % 3 as string)) end as service
    from {lineitem} l join {orders} o on l_orderkey = o_orderkey) x) s
"""

#: Long traces: the orders of 30 customers each, hung from one another; those of every fifth trace close a cycle.
DEEP = """
select HEX(trace + 1, 32) as trace_id, HEX(trace * 16777216 + place, 16) as span_id,
  case when place > 0 then HEX(trace * 16777216 + case when place % 3 = 0 then place - 2 else place - 1 end, 16) when trace % 5 = 0 then HEX(trace * 16777216 + n - 1, 16) end as parent_span_id,
  concat('svc-', cast(place % 4 as string)) as service, concat('svc-', cast(place % 4 as string), '::i0') as instance_id, concat('op-', cast(place % 7 as string)) as name, 'SERVER' as kind,
  cast(place * 10 as double) as start_ms, cast(place * 10 + 5000 - (place * 7) % 100 as double) as end_ms, cast(5000 - (place * 7) % 100 as double) as duration_ms,
  case when place % 11 = 0 then 'ERROR' else 'UNSET' end as status_code
from (
  select trace, cast(row_number() over (partition by trace order by o_orderkey) as bigint) - 1 as place, cast(count(*) over (partition by trace) as bigint) as n
  from (select cast(floor(o_custkey / 30) as bigint) as trace, o_orderkey from {orders}) o) t
"""

_LOG_COLUMNS = """
  case event_type when 'error' then 17 when 'purchase' then 13 when 'signup' then 9 when 'view' then 5 else 1 end as severity_number,
  concat(event_type, ' user=', cast(user_id as string), ' value=', cast(cast(floor(value) as bigint) as string)) as body,
  concat('app-', cast(user_id % 5 as string)) as service, concat('app-', cast(user_id % 5 as string), '::i', cast(user_id % 3 as string)) as instance_id,
  regexp_extract(props, '[0-9]+', 0) as attr_k, cast(user_id as string) as attr_user, event_id as seq,
  HEX(event_id % 1000 + 1, 32) as trace_id, HEX((event_id % 1000 + 1) * 16 + event_id % 8, 16) as span_id
"""

LOGS = f"select MS(ts) as time_ms, {_LOG_COLUMNS} from {{events}}"

TRACE_LOGS = f"""
select MS(o_orderdate) + (o_orderkey % 86400) * 1000 + event_id % 97 * 10 as time_ms, {_LOG_COLUMNS}
from {{events}} join {{orders}} on event_id % 1000 = o_orderkey
"""

POINTS = """
select 'event.value' as metric, 'gauge' as type, false as monotonic, concat('app-', shard) as instance_id, event_type, shard, time_ms, value, seq
from (select event_type, cast(user_id % 5 as string) as shard, MS(ts) as time_ms, value, event_id as seq from {events}) g
union all
select 'events.total', 'sum', true, concat('app-', shard), event_type, shard, time_ms,
  cast(row_number() over (partition by event_type, shard order by time_ms, seq) as double), seq
from (select event_type, cast(user_id % 5 as string) as shard, MS(ts) as time_ms, event_id as seq from {events}) c
"""

HISTOGRAMS = """
select o_orderpriority as priority, cast(month_no as bigint) as month_no, count(*) as n, sum(o_totalprice) as total,
  sum(case when o_totalprice <= 100000 then 1 else 0 end) as b0,
  sum(case when o_totalprice > 100000 and o_totalprice <= 200000 then 1 else 0 end) as b1,
  sum(case when o_totalprice > 200000 and o_totalprice <= 300000 then 1 else 0 end) as b2,
  sum(case when o_totalprice > 300000 and o_totalprice <= 400000 then 1 else 0 end) as b3,
  sum(case when o_totalprice > 400000 then 1 else 0 end) as b4
from (select *, year(o_orderdate) * 12 + month(o_orderdate) as month_no from {orders}) h
group by o_orderpriority, month_no
"""

GENAI = """
select HEX(conv_id + 1, 32) as trace_id, HEX((conv_id + 1) * 65536 + turn + 1, 16) as span_id,
  case when turn = 0 then cast(null as string) else HEX((conv_id + 1) * 65536 + 1, 16) end as parent_span_id,
  case when role = 'assistant' then 'chat' when role = 'system' then 'invoke_agent' when turn % 5 = 0 then 'execute_tool' end as operation,
  concat('model-', cast(conv_id % 3 as string)) as model, cast(conv_id * 100000.0 + turn * 1000.0 as double) as start_ms,
  cast(length(text) as double) as duration_ms, cast(conv_id * 100000.0 + turn * 1000.0 + length(text) as double) as end_ms,
  case when role = 'assistant' then cast(floor(length(text) / 4) as bigint) end as output_tokens,
  case when role = 'assistant' then cast(turn * 10 as bigint) end as input_tokens, turn, role
from {conversations}
"""

_ATTRS = {
    "http.route": "http_route", "http.request.method": "http_method", "user.id": "user_id", "url.full": "url_full",
    "db.system": "db_system", "db.namespace": "db_namespace", "db.operation.name": "db_operation", "db.collection.name": "db_collection",
    "messaging.system": "msg_system", "messaging.destination.name": "msg_destination", "server.address": "server_address",
}


def _render(template: str, hexed: str, millis: str) -> str:
    out = re.sub(r"HEX\(((?:[^()]|\([^()]*\))*), (\d+)\)", lambda m: hexed.format(x=m[1], n=m[2]), template)
    return re.sub(r"MS\((\w+)\)", lambda m: millis.format(x=m[1]), out)


def duckdb(template: str) -> str:
    """The view's text for DuckDB, over the registered tables."""
    sql = _render(template, "lpad(lower(to_hex({x})), {n}, '0')", "(epoch_us({x}) / 1000)")
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def view(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    sql = _render(template, "lpad(lower(hex({x})), {n}, '0')", "(unix_micros(cast({x} as timestamp)) / 1000)")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with re-exported copies, in the operators' form."""
    df = view(spark, sf_dir, SPANS)
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in _ATTRS.items()))
    attrs = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return df.withColumn("attrs", attrs).drop(*_ATTRS.values())


def logs(spark: SparkSession, sf_dir: str, template: str = LOGS) -> DataFrame:
    df = view(spark, sf_dir, template)
    return df.withColumn("attrs", F.create_map(F.lit("k"), "attr_k", F.lit("user.id"), "attr_user")).drop("attr_k", "attr_user")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, POINTS)
    return df.withColumn("attrs", F.create_map(F.lit("type"), "event_type", F.lit("shard"), "shard")).drop("event_type", "shard")
