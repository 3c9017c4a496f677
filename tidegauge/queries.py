"""Every operator as a query over the driver's tables, with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Limits
from .plans.literals import QueryError

DAY, HOUR, MINUTE = 86_400_000_000_000, 3_600_000_000_000, 60_000_000_000
DB = "metrics"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with ``events``, ``lineitem`` and ``orders`` as measurements."""
    out = Engine(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    out.register(DB, "events", events, "ts", ["event_type", "user_id"], ["value", "event_id", "props", "k"], unique=True)
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out.register(DB, "lineitem", lineitem, "l_shipdate", ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], order=["l_orderkey", "l_linenumber"])
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out.register(DB, "orders", orders, "o_orderdate", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], unique=True)
    return out


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: engines add floats in different orders."""
    return df.select(*(F.round(F.col(f"`{n}`"), 6).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(engine(spark, sf_dir).query(text, DB))


E = r"(select epoch_ns(ts) as t, event_type, cast(user_id as varchar) as user_id, value, event_id, props, cast(regexp_extract(props, '(\d+)', 1) as bigint) as k from events)"
LW = """(select epoch_ns(l_shipdate) as t, l_returnflag, l_linestatus, arg_max(l_quantity, l_orderkey * 100 + l_linenumber) as l_quantity,
 arg_max(l_extendedprice, l_orderkey * 100 + l_linenumber) as l_extendedprice from lineitem group by all)"""
WEEK = "time >= '2024-01-03T00:00:00Z' AND time < '2024-01-10T00:00:00Z'"
WEEK_SQL = "t >= 1704240000000000000 and t < 1704844800000000000"
DAY_ONE = "time >= '2024-01-02T00:00:00Z' AND time < '2024-01-03T00:00:00Z'"
DAY_ONE_SQL = "t >= 1704153600000000000 and t < 1704240000000000000"


def _b(ns: int, t: str = "t") -> str:
    return f"({t} // {ns} * {ns})"


def _line(where: str, extra: str = "") -> str:
    """A CTE of the ungrouped line of points with what lies before each."""
    return f"with e as (select t, concat('event_type=', event_type, ',user_id=', user_id) as key, value as v from {E} where {where}), l as (select *, lag(v) over w as pv, lag(t) over w as pt, row_number() over w as i, count(*) over () as n{extra} from e window w as (order by t, key))"


# What SHOW tells, from the tables themselves.
_MEASUREMENTS = "(" + " union all ".join(f"select '{x}' as name where exists (select 1 from {x})" for x in ("events", "lineitem", "orders")) + ")"
_TAGS = "(select column_name from (describe events) where column_name in ('event_type', 'user_id'))"
_FIELDS = r"""(select column_name, column_type from (describe events) where column_name not in ('ts', 'event_type', 'user_id') union all select distinct regexp_extract(props, '"(\w+)"', 1), 'BIGINT' from events)"""
_KIND = "case when column_type in ('BIGINT', 'INTEGER') then 'integer' when column_type = 'DOUBLE' then 'float' when column_type = 'VARCHAR' then 'string' end"

TEXTS: dict[str, tuple[str, str]] = {
    "raw_star_limit": ("SELECT * FROM events LIMIT 50", f"select t as time, event_type, user_id, event_id, k, props, round(value, 6) as value from {E} order by t limit 50"),
    "raw_fields": (f"SELECT value, k FROM events WHERE {WEEK}", f"select t as time, event_type, user_id, round(value, 6) as value, k from {E} where {WEEK_SQL}"),
    "raw_desc_limit_offset": ("SELECT value FROM events ORDER BY time DESC LIMIT 100 OFFSET 20", f"select t as time, event_type, user_id, round(value, 6) as value from {E} order by t desc limit 100 offset 20"),
    "raw_group_desc_top": ("SELECT value FROM events GROUP BY event_type ORDER BY time DESC LIMIT 3", f"select t as time, event_type, user_id, round(value, 6) as value from {E} qualify row_number() over (partition by event_type order by t desc) <= 3"),
    "where_time_range": (f"SELECT count(value) FROM events WHERE {WEEK} GROUP BY time(1d)", f"select {_b(DAY)} as time, count(value) as count_value from {E} where {WEEK_SQL} group by 1"),
    "where_tag_eq": ("SELECT value FROM events WHERE event_type = 'click'", f"select t as time, event_type, user_id, round(value, 6) as value from {E} where event_type = 'click'"),
    "where_tag_neq": ("SELECT count(value) FROM events WHERE event_type != 'click' GROUP BY event_type", f"select max(t) as time, event_type, count(value) as count_value from {E} where event_type <> 'click' group by event_type"),
    "where_regex": ("SELECT count(value) FROM events WHERE event_type =~ /^(click|view)$/ GROUP BY event_type", f"select max(t) as time, event_type, count(value) as count_value from {E} where regexp_matches(event_type, '^(click|view)$') group by event_type"),
    "where_not_regex": ("SELECT count(value) FROM events WHERE event_type !~ /i/ GROUP BY event_type", f"select max(t) as time, event_type, count(value) as count_value from {E} where not regexp_matches(event_type, 'i') group by event_type"),
    "where_field_ops": ("SELECT value FROM events WHERE value >= 50 AND value < 60 AND k != 7", f"select t as time, event_type, user_id, round(value, 6) as value from {E} where value >= 50 and value < 60 and k <> 7"),
    "where_or_groups": ("SELECT count(value) FROM events WHERE value > 10 AND (event_type = 'click' OR event_type = 'error')", f"select max(t) as time, count(value) as count_value from {E} where value > 10 and event_type in ('click', 'error')"),
    "where_string_field": ("SELECT value FROM events WHERE props =~ /: 4[0-9]}/", f"select t as time, event_type, user_id, round(value, 6) as value from {E} where regexp_matches(props, ': 4[0-9]}}')"),
    "distinct_field": ("SELECT DISTINCT(k) FROM events", f"select t as time, event_type, user_id, k from {E} qualify row_number() over (partition by k order by t) = 1"),
    "count_distinct": ("SELECT count(distinct k) FROM events GROUP BY event_type", f"select max(t) as time, event_type, count(distinct k) as count_distinct_k from {E} group by event_type"),
    "count_star": ("SELECT count(*) FROM events", f"select max(t) as time, count(event_id) as count_event_id, count(k) as count_k, count(props) as count_props, count(value) as count_value from {E}"),
    "agg_basic_global": ("SELECT count(value), sum(value), mean(value), min(value), max(value) FROM events", f"select max(t) as time, count(value) as count_value, round(sum(value), 6) as sum_value, round(avg(value), 6) as mean_value, min(value) as min_value, max(value) as max_value from {E}"),
    "agg_by_time": ("SELECT count(value), sum(value), mean(value), min(value), max(value) FROM events GROUP BY time(6h)", f"select {_b(6 * HOUR)} as time, count(value) as count_value, round(sum(value), 6) as sum_value, round(avg(value), 6) as mean_value, min(value) as min_value, max(value) as max_value from {E} group by 1"),
    "agg_by_tag": ("SELECT sum(value), mean(k) FROM events GROUP BY user_id", f"select max(t) as time, user_id, round(sum(value), 6) as sum_value, round(avg(k), 6) as mean_k from {E} group by user_id"),
    "agg_by_time_tag": (f"SELECT mean(value), max(value), count(value) FROM events WHERE {WEEK} GROUP BY time(1d), event_type", f"select {_b(DAY)} as time, event_type, round(avg(value), 6) as mean_value, max(value) as max_value, count(value) as count_value from {E} where {WEEK_SQL} group by 1, 2"),
    "agg_group_all": ("SELECT sum(value) FROM events GROUP BY time(7d), *", f"select {_b(7 * DAY)} as time, event_type, user_id, round(sum(value), 6) as sum_value from {E} group by all"),
    "first_last": ("SELECT first(value), last(value), last(props) FROM events GROUP BY time(1d), event_type", f"select {_b(DAY)} as time, event_type, arg_min(value, t) as first_value, arg_max(value, t) as last_value, arg_max(props, t) as last_props from {E} group by 1, 2"),
    "spread": ("SELECT spread(value) FROM events GROUP BY time(1d)", f"select {_b(DAY)} as time, round(max(value) - min(value), 6) as spread_value from {E} group by 1"),
    "stddev": ("SELECT stddev(value) FROM events GROUP BY event_type", f"select max(t) as time, event_type, round(stddev_samp(value), 6) as stddev_value from {E} group by event_type"),
    "median": ("SELECT median(value) FROM events GROUP BY time(1d), event_type", f"select {_b(DAY)} as time, event_type, round(quantile_cont(value, 0.5), 6) as median_value from {E} group by 1, 2"),
    "percentile": ("SELECT percentile(value, 90), percentile(value, 99.5) FROM events GROUP BY event_type", f"select max(t) as time, event_type, round(quantile_cont(value, 0.9), 6) as percentile_value_90, round(quantile_cont(value, 0.995), 6) as \"percentile_value_99.5\" from {E} group by event_type"),
    "mode": ("SELECT mode(k) FROM events GROUP BY event_type", f"with c as (select event_type, k, count(*) as n, min(t) as f from {E} group by 1, 2) select (select max(t) from {E} e where e.event_type = c.event_type) as time, event_type, k as mode_k from c qualify row_number() over (partition by event_type order by n desc, f) = 1"),
    "grouped_difference": ("SELECT difference(value), non_negative_difference(value) FROM events GROUP BY time(1d)", f"select {_b(DAY)} as time, case when count(value) > 1 then round(arg_max(value, t) - arg_min(value, t), 6) end as difference_value, case when count(value) > 1 and arg_max(value, t) - arg_min(value, t) >= 0 then round(arg_max(value, t) - arg_min(value, t), 6) end as non_negative_difference_value from {E} group by 1"),
    "grouped_derivative": ("SELECT derivative(value, 1h), non_negative_derivative(value, 1h) FROM events GROUP BY event_type", f"select max(t) as time, event_type, round((arg_max(value, t) - arg_min(value, t)) * {HOUR}.0::double / (max(t) - min(t)), 6) as derivative_value_1h, case when arg_max(value, t) >= arg_min(value, t) then round((arg_max(value, t) - arg_min(value, t)) * {HOUR}.0::double / (max(t) - min(t)), 6) end as non_negative_derivative_value_1h from {E} group by event_type"),
    "grouped_integral": ("SELECT integral(value, 1h) FROM events GROUP BY time(1d), event_type", f"with l as (select t, event_type, value as v, {_b(DAY)} as b, lag(value) over w as pv, lag(t) over w as pt from {E} window w as (partition by event_type, {_b(DAY)} order by t)) select b as time, event_type, round(coalesce(sum((v + pv) / 2 * (t - pt) / {HOUR}.0::double), 0), 6) as integral_value_1h from l group by 1, 2"),
    "grouped_scalar_last": ("SELECT abs(value), floor(value), ceil(value), sqrt(value), round(value), cumulative_sum(value), moving_average(value, 3) FROM events GROUP BY time(1d)", f"select {_b(DAY)} as time, abs(arg_max(value, t)) as abs_value, floor(arg_max(value, t)) as floor_value, ceil(arg_max(value, t)) as ceil_value, round(sqrt(arg_max(value, t)), 6) as sqrt_value, cast(round_even(arg_max(value, t), 0) as double) as round_value, round(sum(value), 6) as cumulative_sum_value, round(avg(value), 6) as moving_average_value_3 from {E} group by 1"),
    "difference": (f"SELECT difference(value) FROM events WHERE {WEEK}", f"{_line(WEEK_SQL)} select t as time, round(v - pv, 6) as difference_value from l where pv is not null"),
    "nn_difference": (f"SELECT non_negative_difference(value) FROM events WHERE {WEEK}", f"{_line(WEEK_SQL)} select t as time, round(v - pv, 6) as non_negative_difference_value from l where v - pv >= 0"),
    "derivative": (f"SELECT derivative(value, 1m) FROM events WHERE {WEEK}", f"{_line(WEEK_SQL)} select t as time, round((v - pv) * {MINUTE}.0::double / (t - pt), 6) as derivative_value_1m from l where t > pt"),
    "nn_derivative": (f"SELECT non_negative_derivative(value) FROM events WHERE {WEEK}", f"{_line(WEEK_SQL)} select t as time, round((v - pv) * 1000000000.0::double / (t - pt), 6) as non_negative_derivative_value from l where t > pt and v - pv >= 0"),
    "moving_average": ("SELECT moving_average(value, 5) FROM events", f"{_line('true', ', avg(v) over (order by t, key rows 4 preceding) as m')} select t as time, round(m, 6) as moving_average_value_5 from l where i >= 5"),
    "cumulative_sum": ("SELECT cumulative_sum(value) FROM events", f"{_line('true', ', sum(v) over w as s')} select t as time, round(s, 6) as cumulative_sum_value from l"),
    "integral_running": (f"SELECT integral(value, 1h) FROM events WHERE {WEEK}", f"{_line(WEEK_SQL)} select t as time, round(sum((v + pv) / 2 * (t - pt) / {HOUR}.0::double) over (order by t), 6) as integral_value_1h from l where pt is not null"),
    "elapsed": (f"SELECT elapsed(value) FROM events WHERE {WEEK}", f"{_line(WEEK_SQL)} select t as time, round((t - pt) / 1e9, 6) as elapsed_value from l where pt is not null"),
    "math_scalars": (f"SELECT abs(value), ceil(value), floor(value), sqrt(value) FROM events WHERE {DAY_ONE}", f"select t as time, abs(value) as abs_value, ceil(value) as ceil_value, floor(value) as floor_value, round(sqrt(value), 6) as sqrt_value from {E} where {DAY_ONE_SQL}"),
    "round_half_even": (f"SELECT round(value), round(value, 1) FROM events WHERE {DAY_ONE}", f"select t as time, cast(round_even(value, 0) as double) as round_value, cast(round_even(cast(value as decimal(18, 4)), 1) as double) as round_value_1 from {E} where {DAY_ONE_SQL}"),
    "multi_transform": (f"SELECT difference(value), cumulative_sum(k) FROM events WHERE {DAY_ONE}", f"with l as (select t, value - lag(value) over (order by t) as d, sum(k) over (order by t) as s from {E} where {DAY_ONE_SQL}) select t as time, round(d, 6) as difference_value, s::double as cumulative_sum_k from l"),
    "top_n": ("SELECT top(value, 10) FROM events", f"select t as time, value as top_value_10 from {E} order by value desc, t limit 10"),
    "bottom_n": ("SELECT bottom(value, 10) FROM events", f"select t as time, value as bottom_value_10 from {E} order by value, t limit 10"),
    "top_by_tag": ("SELECT top(value, 3) FROM events GROUP BY event_type", f"select t as time, event_type, value as top_value_3 from {E} qualify row_number() over (partition by event_type order by value desc, t) <= 3"),
    "top_with_aggregate": ("SELECT top(value, 2), mean(value) FROM events GROUP BY time(7d)", f"with e as (select *, {_b(7 * DAY)} as b from {E}) select t as time, value as top_value_2, null::double as mean_value from e qualify row_number() over (partition by b order by value desc, t) <= 2 union all select b, null, round(avg(value), 6) from e group by b"),
    "sample_n": ("SELECT sample(value, 20) FROM events", f"{_line('true')} select t as time, v as sample_value_20 from l where i - 1 in (select cast(round(j * (n - 1) / 19.0) as bigint) from (select count(*) as n from e), range(20) r(j))"),
    "sample_by_time": ("SELECT sample(value, 4) FROM events GROUP BY time(1d)", f"with l as (select t, value as v, row_number() over w as i, count(*) over (partition by {_b(DAY)}) as n from {E} window w as (partition by {_b(DAY)} order by t)) select t as time, v as sample_value_4 from l where n <= 4 or i - 1 in (0, cast(round((n - 1) / 3.0) as bigint), cast(round(2 * (n - 1) / 3.0) as bigint), n - 1)"),
    "group_limit_offset": ("SELECT mean(value) FROM events GROUP BY time(1d), event_type LIMIT 2 OFFSET 1", f"select {_b(DAY)} as time, event_type, round(avg(value), 6) as mean_value from {E} group by 1, 2 qualify row_number() over (partition by event_type order by {_b(DAY)}) in (2, 3)"),
    "slimit_soffset": ("SELECT mean(value) FROM events GROUP BY time(7d), event_type ORDER BY time DESC SLIMIT 2 SOFFSET 1", f"select {_b(7 * DAY)} as time, event_type, round(avg(value), 6) as mean_value from {E} group by 1, 2 qualify dense_rank() over (order by event_type) in (2, 3)"),
    "subquery_agg": ("SELECT mean(max_value) FROM (SELECT max(value) FROM events GROUP BY time(1h)) GROUP BY time(1d)", f"with i as (select {_b(HOUR)} as t, max(value) as m from {E} group by 1) select {_b(DAY)} as time, round(avg(m), 6) as mean_max_value from i group by 1"),
    "subquery_tags": ("SELECT max(mean_value) FROM (SELECT mean(value) FROM events GROUP BY time(1d), event_type) GROUP BY event_type", f"with i as (select {_b(DAY)} as t, event_type, avg(value) as m from {E} group by 1, 2) select max(t) as time, event_type, round(max(m), 6) as max_mean_value from i group by 2"),
    "subquery_time_bounds": (f"SELECT sum(count_value) FROM (SELECT count(value) FROM events GROUP BY time(1h)) WHERE {WEEK} GROUP BY time(1d)", f"with i as (select {_b(HOUR)} as t, count(value) as m from {E} where {WEEK_SQL} group by 1) select {_b(DAY)} as time, sum(m)::double as sum_count_value from i group by 1"),
    "lww_merge": ("SELECT count(l_quantity), sum(l_quantity), sum(l_extendedprice) FROM lineitem GROUP BY l_returnflag", f"select max(t) as time, l_returnflag, count(l_quantity) as count_l_quantity, round(sum(l_quantity), 6) as sum_l_quantity, round(sum(l_extendedprice), 2) as sum_l_extendedprice from {LW} group by l_returnflag"),
    "lww_by_month": ("SELECT max(l_quantity), min(l_quantity) FROM lineitem WHERE time >= '1998-01-01T00:00:00Z' AND time < '1999-01-01T00:00:00Z' GROUP BY time(30d), l_linestatus", f"select {_b(30 * DAY)} as time, l_linestatus, max(l_quantity) as max_l_quantity, min(l_quantity) as min_l_quantity from {LW} where t >= 883612800000000000 and t < 915148800000000000 group by 1, 2"),
    "orders_by_status": ("SELECT count(o_totalprice), max(o_totalprice) FROM orders GROUP BY time(365d), o_orderstatus", f"with o as (select epoch_ns(o_orderdate) as t, * from orders) select {_b(365 * DAY)} as time, o_orderstatus, count(o_totalprice) as count_o_totalprice, max(o_totalprice) as max_o_totalprice from o group by 1, 2"),
    "show_measurements": ("SHOW MEASUREMENTS", f"select name from {_MEASUREMENTS}"),
    "show_tag_keys": ("SHOW TAG KEYS FROM events", f"select column_name as tagKey from {_TAGS}"),
    "show_tag_values": ("SHOW TAG VALUES FROM events WITH KEY = user_id WHERE event_type = 'click'", f"select distinct 'user_id' as key, user_id as value from {E} where event_type = 'click'"),
    "show_field_keys": ("SHOW FIELD KEYS FROM events", f"select column_name as fieldKey, {_KIND} as fieldType from {_FIELDS}"),
    "show_series": ("SHOW SERIES FROM events", f"select distinct concat('events,event_type=', event_type, ',user_id=', user_id) as key from {E}"),
    "series_cardinality": ("SHOW SERIES CARDINALITY FROM events", f"select count(distinct (event_type, user_id)) as count from {E}"),
    "tag_values_cardinality": ("SHOW TAG VALUES CARDINALITY FROM events WITH KEY = event_type", f"select count(distinct event_type) as count from {E}"),
    "measurement_cardinality": ("SHOW MEASUREMENT CARDINALITY", f"select count(*) as count from {_MEASUREMENTS}"),
    "tag_key_cardinality": ("SHOW TAG KEY CARDINALITY FROM events", f"select count(*) as count from {_TAGS}"),
    "field_key_cardinality": ("SHOW FIELD KEY CARDINALITY FROM events", f"select count(*) as count from {_FIELDS}"),
}

_FILL = "SELECT mean(value) FROM events WHERE event_type = 'click' AND user_id = '7' AND time >= '2024-01-05T00:00:00Z' AND time <= '2024-01-12T00:00:00Z' GROUP BY time(6h), user_id fill({})"
_GRID = f"""with h as (select {_b(6 * HOUR)} as b, avg(value) as v from {E} where event_type = 'click' and user_id = '7' and t >= 1704412800000000000 and t <= 1705017600000000000 group by 1),
g as (select unnest(range(1704412800000000000, 1705017600000000001, {6 * HOUR})) as b), j as (select g.b, h.v, h.b is not null as there from g left join h using (b) where exists (select 1 from h))"""
TEXTS |= {
    "fill_null": (_FILL.format("null"), f"{_GRID} select b as time, '7' as user_id, round(v, 6) as mean_value from j"),
    "fill_zero": (_FILL.format("0"), f"{_GRID} select b as time, '7' as user_id, round(coalesce(v, 0), 6) as mean_value from j"),
    "fill_previous": (_FILL.format("previous"), f"{_GRID} select b as time, '7' as user_id, round(last_value(v ignore nulls) over (order by b rows unbounded preceding), 6) as mean_value from j"),
    "fill_linear": (_FILL.format("linear"), f"""{_GRID}, n as (select *, last_value(v ignore nulls) over p as a, last_value(case when there then b end ignore nulls) over p as ta, first_value(v ignore nulls) over f as z, first_value(case when there then b end ignore nulls) over f as tz
from j window p as (order by b rows unbounded preceding), f as (order by b rows between current row and unbounded following)) select b as time, '7' as user_id, round(case when there then v else a + (z - a) * (b - ta) / (tz - ta) end, 6) as mean_value from n"""),
}

# The same operators over the whole table: all rows, all series, the whole line.
_ALL = "time >= '2024-01-01T00:00:00Z' AND time <= '2024-01-31T00:00:00Z'"
_FILL_ALL = f"SELECT mean(value) FROM events WHERE {_ALL} GROUP BY time(6h), event_type, user_id fill({{}})"
_GRID_ALL = f"""with h as (select {_b(6 * HOUR)} as b, event_type, user_id, avg(value) as v from {E} group by all), s as (select distinct event_type, user_id from h),
g as (select unnest(range(1704067200000000000, 1706659200000000001, {6 * HOUR})) as b), j as (select b, event_type, user_id, h.v, h.v is not null as there from s cross join g left join h using (b, event_type, user_id))"""
_BACK, _AHEAD = "partition by event_type, user_id order by b rows unbounded preceding", "partition by event_type, user_id order by b rows between current row and unbounded following"
TEXTS |= {
    "raw_fields_whole": ("SELECT value, k FROM events", f"select t as time, event_type, user_id, round(value, 6) as value, k from {E}"),
    "agg_by_time_tag_whole": ("SELECT mean(value), max(value), count(value) FROM events GROUP BY time(1d), event_type", f"select {_b(DAY)} as time, event_type, round(avg(value), 6) as mean_value, max(value) as max_value, count(value) as count_value from {E} group by 1, 2"),
    "difference_whole": ("SELECT difference(value) FROM events", f"{_line('true')} select t as time, round(v - pv, 6) as difference_value from l where pv is not null"),
    "nn_difference_whole": ("SELECT non_negative_difference(value) FROM events", f"{_line('true')} select t as time, round(v - pv, 6) as non_negative_difference_value from l where v - pv >= 0"),
    "derivative_whole": ("SELECT derivative(value, 1m) FROM events", f"{_line('true')} select t as time, round((v - pv) * {MINUTE}.0::double / (t - pt), 6) as derivative_value_1m from l where t > pt"),
    "nn_derivative_whole": ("SELECT non_negative_derivative(value) FROM events", f"{_line('true')} select t as time, round((v - pv) * 1000000000.0::double / (t - pt), 6) as non_negative_derivative_value from l where t > pt and v - pv >= 0"),
    "integral_running_whole": ("SELECT integral(value, 1h) FROM events", f"{_line('true')} select t as time, round(sum((v + pv) / 2 * (t - pt) / {HOUR}.0::double) over (order by t, key rows unbounded preceding), 6) as integral_value_1h from l where pt is not null"),
    "elapsed_whole": ("SELECT elapsed(value) FROM events", f"{_line('true')} select t as time, round((t - pt) / 1e9, 6) as elapsed_value from l where pt is not null"),
    "math_scalars_whole": ("SELECT abs(value), ceil(value), floor(value), sqrt(value) FROM events", f"select t as time, abs(value) as abs_value, ceil(value) as ceil_value, floor(value) as floor_value, round(sqrt(value), 6) as sqrt_value from {E}"),
    "round_half_even_whole": ("SELECT round(value), round(value, 1) FROM events", f"select t as time, cast(round_even(value, 0) as double) as round_value, cast(round_even(cast(value as decimal(18, 4)), 1) as double) as round_value_1 from {E}"),
    "multi_transform_whole": ("SELECT difference(value), cumulative_sum(k) FROM events", f"with l as (select t, value - lag(value) over w as d, sum(k) over w as s from (select *, concat('event_type=', event_type, ',user_id=', user_id) as key from {E}) window w as (order by t, key rows unbounded preceding)) select t as time, round(d, 6) as difference_value, s::double as cumulative_sum_k from l"),
    "fill_null_whole": (_FILL_ALL.format("null"), f"{_GRID_ALL} select b as time, event_type, user_id, round(v, 6) as mean_value from j"),
    "fill_zero_whole": (_FILL_ALL.format("0"), f"{_GRID_ALL} select b as time, event_type, user_id, round(coalesce(v, 0), 6) as mean_value from j"),
    "fill_previous_whole": (_FILL_ALL.format("previous"), f"{_GRID_ALL} select b as time, event_type, user_id, round(last_value(v ignore nulls) over ({_BACK}), 6) as mean_value from j"),
    "fill_linear_whole": (_FILL_ALL.format("linear"), f"""{_GRID_ALL}, n as (select *, last_value(v ignore nulls) over p as a, last_value(case when there then b end ignore nulls) over p as ta, first_value(v ignore nulls) over f as z, first_value(case when there then b end ignore nulls) over f as tz
from j window p as ({_BACK}), f as ({_AHEAD})) select b as time, event_type, user_id, round(case when there then v else a + (z - a) * (b - ta) / (tz - ta) end, 6) as mean_value from n"""),
}


# --- queries that write ----------------------------------------------------


def _stored(spark: SparkSession, now: int = 1_706_659_200_000_000_000) -> Engine:
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidegauge-")
    return Engine(spark, f"{root.rstrip('/')}/engine-{uuid.uuid4().hex}", now=lambda: now)


def _loaded(spark: SparkSession, sf_dir: str) -> Engine:
    """A storing engine with the points of ``events`` written as line protocol."""
    source, out = engine(spark, sf_dir), _stored(spark)
    out.write_lines(source.export_lines(DB, "events"), DB)
    return out


def line_protocol_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_loaded(spark, sf_dir).query("SELECT * FROM events", DB))


def select_into_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _loaded(spark, sf_dir)
    out.query("SELECT mean(value) INTO rollup FROM events GROUP BY time(1d), event_type", DB)
    return rounded(out.query("SELECT mean_value FROM rollup", DB))


def delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _loaded(spark, sf_dir)
    out.query(f"DELETE FROM events WHERE event_type = 'click' AND {WEEK}", DB)
    return out.query("SELECT count(value) FROM events GROUP BY event_type", DB)


def drop_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _loaded(spark, sf_dir)
    out.query("DROP SERIES FROM events WHERE value > 250", DB)
    return out.query("SHOW SERIES FROM events", DB)


def cq_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A continuous query over the last ten days that are closed."""
    from .streaming.continuous import ContinuousQueries

    out = _loaded(spark, sf_dir)
    out.query(f"CREATE CONTINUOUS QUERY c ON {DB} RESAMPLE EVERY 1d FOR 3d BEGIN SELECT mean(value), count(value) INTO rollup FROM events GROUP BY time(1d), event_type END", DB)
    ContinuousQueries(out).run_due()
    return rounded(out.query("SELECT mean_value, count_value FROM rollup", DB))


def retention_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a day that ended before the two weeks of their policy are dropped."""
    source, out = engine(spark, sf_dir), _stored(spark)
    out.query(f"CREATE DATABASE {DB} WITH DURATION 14d SHARD DURATION 1d NAME short", DB)
    out.write_lines(source.export_lines(DB, "events"), DB)
    out.expire()
    return out.query("SELECT count(value) FROM events", DB)


def delete_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition that stands on a line of its own."""
    out = _loaded(spark, sf_dir)
    out.query("DELETE FROM events\nWHERE\tevent_type = 'click'", DB)
    return out.query("SELECT count(value) FROM events GROUP BY event_type", DB)


def stored_count_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted shards, read without a merge, beside shards written to since."""
    out = _loaded(spark, sf_dir)
    out.compact(DB, "events")
    late = out.export_lines(DB, "events").where("value like '%event_type=click%'")
    out.write_lines(late, DB)  # the same points once more
    return rounded(out.query("SELECT count(value), sum(value) FROM events GROUP BY event_type", DB))


def series_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series are counted with those that are stored: a write beyond the limit changes nothing."""
    out = _loaded(spark, sf_dir)
    out.limits = Limits(series=out.query("SHOW SERIES CARDINALITY FROM events", DB).first()[0])
    try:
        out.write_lines("events,event_type=new,user_id=0 value=1 1704067200000000000", DB)
    except QueryError:
        return out.query("SHOW SERIES CARDINALITY FROM events", DB)
    raise AssertionError("the limit was not kept")


def cq_new_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A continuous query that writes into a database that isn't there yet."""
    from .streaming.continuous import ContinuousQueries

    out = _loaded(spark, sf_dir)
    out.query(f"CREATE CONTINUOUS QUERY c ON {DB} RESAMPLE EVERY 1d FOR 3d BEGIN SELECT mean(value), count(value) INTO fresh.autogen.rollup FROM events GROUP BY time(1d), event_type END", DB)
    ContinuousQueries(out).run_due()
    return rounded(out.query("SELECT mean_value, count_value FROM fresh.autogen.rollup", DB))


WRITING = {f.__name__: f for f in (line_protocol_roundtrip, select_into_roundtrip, delete_range, delete_multiline, drop_series, stored_count_compacted, series_limit, cq_rollup, cq_new_database, retention_expiry)}
WRITING_SQL = {
    "line_protocol_roundtrip": f"select t as time, event_type, user_id, event_id, k, props, round(value, 6) as value from {E}",
    "select_into_roundtrip": f"select {_b(DAY)} as time, event_type, round(avg(value), 6) as mean_value from {E} group by 1, 2",
    "delete_range": f"select max(t) as time, event_type, count(value) as count_value from {E} where not (event_type = 'click' and {WEEK_SQL}) group by event_type",
    "drop_series": f"select distinct concat('events,event_type=', event_type, ',user_id=', user_id) as key from {E} e where not exists (select 1 from {E} d where d.event_type = e.event_type and d.user_id = e.user_id and d.value > 250)",
    "cq_rollup": f"select {_b(DAY)} as time, event_type, round(avg(value), 6) as mean_value, count(value) as count_value from {E} where t >= 1706572800000000000 - {4 * DAY} and t < 1706572800000000000 + {DAY} group by 1, 2",
    "delete_multiline": f"select max(t) as time, event_type, count(value) as count_value from {E} where event_type <> 'click' group by event_type",
    "stored_count_compacted": f"select max(t) as time, event_type, count(value) as count_value, round(sum(value), 6) as sum_value from {E} group by event_type",
    "series_limit": f"select count(distinct (event_type, user_id)) as count from {E}",
    "retention_expiry": f"select max(t) as time, count(value) as count_value from {E} where {_b(DAY)} + {DAY} >= 1706659200000000000 - {14 * DAY}",
}

WRITING_SQL["cq_new_database"] = WRITING_SQL["cq_rollup"]

QUERIES = {name: _statement(text) for name, (text, _) in TEXTS.items()} | WRITING
ORACLE_SQL = {name: sql for name, (_, sql) in TEXTS.items()} | WRITING_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_by_time_tag"](spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "engine", "flagship"]
