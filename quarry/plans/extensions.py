"""Operators beyond the project's own kind: as-of and outer joins, rollups, rankings, time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus
from .dialect import add, pair, table

add("ext_rollup_lineitem", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem group by rollup (l_returnflag, l_linestatus)")


def ranked_orders(spark, sf_dir: str):
    """rank, dense_rank and ntile(4) by price within a priority; a priority has a fifth of all rows, so places come from ranges."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    dear = F.col("o_totalprice").desc()
    rows = corpus.numbered(orders, ["o_orderpriority"], [dear, F.col("o_orderkey")])
    prices = rows.groupBy("o_orderpriority", "o_totalprice").agg(F.min("__r").alias("r"))
    prices = corpus.numbered(prices, ["o_orderpriority"], [dear]).withColumnRenamed("__r", "dr").drop("__n")
    quarter = "case when __r - 1 < (__n % 4) * (__n div 4 + 1) then (__r - 1) div (__n div 4 + 1) else __n % 4 + (__r - 1 - (__n % 4) * (__n div 4 + 1)) div greatest(__n div 4, 1) end + 1"
    return rows.join(prices, ["o_orderpriority", "o_totalprice"]).select("o_orderkey", "r", "dr", F.expr(quarter).alias("q"))


pair("ext_rank_orders", ranked_orders, "select o_orderkey, rank() over (partition by o_orderpriority order by o_totalprice desc) as r, dense_rank() over (partition by o_orderpriority order by o_totalprice desc) as dr, ntile(4) over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as q from orders")
add("ext_except_all", "select l_returnflag as f from lineitem where l_linenumber <= 2 except all select l_returnflag from lineitem where l_linenumber = 2")
add("ext_date_trunc", "select date_trunc('month', o_orderdate) as month, count(*) as n from orders group by 1")
add("ext_tumbling", "select @epoch_us(ts) div 3600000000 as hour, event_type, count(*) as n from events group by 1, 2")
add("ext_sliding", "select (@epoch_us(ts) div 1800000000) - k as half_hour, count(*) as n from (select ts, explode(sequence(0, 1)) as k from events) e group by 1")


def timed_sessions(spark, sf_dir: str):
    """Sessions of a user's events end with a gap of more than half an hour."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    gaps = corpus.before(events, "user_id", ["us", "event_id"], ["us"])
    found = corpus.sessions(gaps, "user_id", ["us", "event_id"], F.expr("before_us is null or us - before_us > 1800000000"))
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.expr("max(us) - min(us)").alias("length_us"))


pair("ext_session", timed_sessions, "select user_id, session, count(*) as n, max(us) - min(us) as length_us from (select user_id, us, sum(case when us - before <= 1800000000 then 0 else 1 end) over (partition by user_id order by us, event_id) as session from (select user_id, event_id, @epoch_us(ts) as us, lag(@epoch_us(ts)) over (partition by user_id order by ts, event_id) as before from events) l) s group by user_id, session")
add("ext_revenue", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on n_nationkey = c_nationkey where l_returnflag = 'R' group by n_name")
add("ext_full_outer", "select coalesce(c_nationkey, s_nationkey) as nation, c.n as customers, s.n as suppliers from (select c_nationkey, count(*) as n from customer group by 1) c full outer join (select s_nationkey, count(*) as n from supplier group by 1) s on c_nationkey = s_nationkey")


def asof(spark, sf_dir: str):
    """Each purchase with the user's last view before it: one ordering of both kinds, no range join."""
    events = table(spark, sf_dir, "events")
    views = {"view_id": F.when(F.col("event_type") == "view", F.col("event_id"))}
    told = corpus.last_known(events.select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], views)
    return told.where("event_type = 'purchase'").select("event_id", "view_id")


pair("ext_asof_events", asof, "select event_id, view_id from (select event_id, event_type, last_value(case when event_type = 'view' then event_id end IGNORE NULLS) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as view_id from events) e where event_type = 'purchase'")
pair("ext_approx_distinct", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users")))
