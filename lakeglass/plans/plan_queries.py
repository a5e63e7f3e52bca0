"""Registered queries: metrics, scheduler plans, placement, rules and access patterns, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeglass.operators import access, collective, fleet, folds, metrics, planning, rules
from lakeglass.plans.queries import _EDGES, NOW, _edges, _r, _t, query
from lakeglass.plans.select import select
from lakeglass.sources import sinks

# Select -----------------------------------------------------------------------------


@query("""select event_id from events where event_type <> 'view' and (value <> 10 or user_id is null)""")
def select_compat_unequal(spark, sf):
    return select(_t(spark, sf, "events"), "SELECT event_id, nothing FROM s3object WHERE event_type <> 'view' AND value <> 10", mode="compat").select("event_id")


@query("""select o_orderkey, case when o_totalprice > 200000 then 'large' when o_totalprice > 50000 then 'middle' else 'small' end as size, cast(o_totalprice as bigint) as whole, upper(substr(o_orderpriority, 3)) as name,
coalesce(nullif(o_orderstatus, 'P'), '-') as status from orders where o_orderpriority ilike '%high' or length(o_orderstatus || trim(o_orderpriority)) = 6""")
def select_functions(spark, sf):
    return select(
        _t(spark, sf, "orders"),
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size, CAST(o_totalprice AS INT) AS whole, UPPER(SUBSTRING(o_orderpriority, 3)) AS name, "
        "COALESCE(NULLIF(o_orderstatus, 'P'), '-') AS status FROM s3object WHERE o_orderpriority ILIKE '%high' OR CHAR_LENGTH(o_orderstatus || TRIM(o_orderpriority)) = 6",
    )


# Metrics ----------------------------------------------------------------------------


@query("select event_type, count(*) as \"count\", cast(sum(cast(floor(value) as bigint)) as bigint) as total from events group by 1")
def counters(spark, sf):
    return metrics.counter(_t(spark, sf, "events").withColumn("v", F.floor("value").cast("long")), ["event_type"], "v")


@query("""with s as (select l_suppkey, count(*) n, count(*) filter (where l_returnflag <> 'R') h, count(*) filter (where l_returnflag = 'R') l, count(*) filter (where l_linestatus = 'O') d, count(*) filter (where l_tax > 0.07) e from lineitem group by 1)
select l_suppkey, round(h / n, 6) as shard_health, round(l / n, 6) as shard_loss, round(d / n, 6) as decode_success, e / n < 0.01 and h / n >= 0.9 and l = 0 as healthy from s""")
def shard_ratios(spark, sf):
    flag = F.col("l_returnflag") == "R"
    s = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(~flag).alias("h"), F.count_if(flag).alias("l"), F.count_if(F.col("l_linestatus") == "O").alias("d"), F.count_if(F.col("l_tax") > 0.07).alias("e")
    )
    r = metrics.shard_health(*(F.col(c) for c in ("h", "n", "l", "d", "n")))
    bad = metrics.ratio(F.col("e"), F.col("n"), 0.0)
    return s.select("l_suppkey", *[_r(c).alias(n) for n, c in r.items()], metrics.is_healthy(bad, bad, r["shard_health"], F.col("l")).alias("healthy"))


@query("""with s as (select event_type, sum(octet_length(encode(props))) b, floor(sum(value) / count(*)) a from events group by 1) select round(max(b) / 60.0, 4) as bytes_per_second, cast(sum(a) as bigint) as end_to_end_latency from s""")
def pipeline_totals(spark, sf):
    s = metrics.stage_stats(_t(spark, sf, "events").withColumn("bytes", F.octet_length("props")), "event_type", "value", "bytes")
    return metrics.pipeline_summary(s, 60.0).withColumn("bytes_per_second", _r("bytes_per_second", 4))


@query("""select count(*) as edges, count(*) filter (where s_suppkey % 4 > 0) as online, cast(sum(s_suppkey * 1000) as bigint) as capacity, cast(sum(s_suppkey * 10 + s_nationkey) as bigint) as used, round(sum(s_suppkey * 10 + s_nationkey) / sum(s_suppkey * 1000), 6) as utilisation from supplier""")
def fleet_totals(spark, sf):
    s = _t(spark, sf, "supplier").select((F.col("s_suppkey") * 1000).alias("capacity"), (F.col("s_suppkey") * 10 + F.col("s_nationkey")).alias("used"), "s_suppkey")
    return fleet.fleet_snapshot(s, "capacity", "used", F.col("s_suppkey") % 4 > 0).withColumn("utilisation", _r("utilisation"))


@query("""select s_nationkey, cast(sum(s_suppkey * 1000) as bigint) as total, cast(sum(case when s_suppkey % 4 > 0 then s_suppkey * 990 - s_nationkey else 0 end) as bigint) as available from supplier group by 1""")
def domain_capacity(spark, sf):
    s = _t(spark, sf, "supplier").select("s_nationkey", (F.col("s_suppkey") * 1000).alias("capacity"), (F.col("s_suppkey") * 10 + F.col("s_nationkey")).alias("used"), "s_suppkey")
    return fleet.domain_capacity(s, "s_nationkey", "capacity", "used", F.col("s_suppkey") % 4 > 0)


@query("select user_id, round((sum(value) + 50.0) / count(*), 6) as value, round((sum(event_id % 7) + 0.9) / count(*), 6) as quality from events group by 1")
def biased_means(spark, sf):
    e = _t(spark, sf, "events").withColumn("quality", F.col("event_id") % 7)
    return metrics.average_metrics(e, ["user_id"], {"value": 50.0, "quality": 0.9}, biased=True).withColumn("value", _r("value")).withColumn("quality", _r("quality"))


@query("select user_id, round(avg(value), 6) as value from events group by 1")
def plain_means(spark, sf):
    return metrics.average_metrics(_t(spark, sf, "events"), ["user_id"], {"value": 50.0}).withColumn("value", _r("value"))


@query("""select n_regionkey, round(sum(n_nationkey / 4.0), 6) as "sum", max(n_nationkey / 4.0) as "max", min(n_nationkey / 4.0) as "min", round(product(n_nationkey / 4.0), 6) as product,
cast(bit_and(cast(trunc(n_nationkey / 4.0) as bigint)) as double) as bit_and, cast(bit_or(cast(trunc(n_nationkey / 4.0) as bigint)) as double) as bit_or, cast(bit_xor(cast(trunc(n_nationkey / 4.0) as bigint)) as double) as bit_xor from nation group by 1""")
def reduce_floats(spark, sf):
    n = _t(spark, sf, "nation").withColumn("x", F.col("n_nationkey") / 4.0)
    return metrics.reduce_floats(n, ["n_regionkey"], "x").withColumn("sum", _r("sum")).withColumn("product", _r("product"))


_SNAPSHOT = """select 'events_' || event_type as name, 'counter' as kind, cast(count(*) as double) as value, cast(null as bigint) as "count" from events group by 1
union all select 'last_event_' || event_type, 'gauge', cast(max(event_id) as double), null from events group by 1
union all select 'latency_' || event_type, 'histogram', round(sum(value) / count(*), 4), count(*) from events group by 1"""


def _snapshot(spark, sf):
    e = _t(spark, sf, "events")
    count = metrics.counter(e, ["event_type"]).select(F.concat(F.lit("events_"), "event_type").alias("name"), F.col("count").alias("value"))
    last = metrics.gauge(e, ["event_type"], "event_id", ["event_id"]).select(F.concat(F.lit("last_event_"), "event_type").alias("name"), "value")
    hist = metrics.histogram_summary(e, ["event_type"], "value", (10.0,)).withColumn("name", F.concat(F.lit("latency_"), "event_type"))
    return metrics.registry_snapshot(count, last, hist).withColumn("value", _r("value", 4))


@query(_SNAPSHOT)
def registry_snapshot(spark, sf):
    return _snapshot(spark, sf)


@query(f"""select '{{"name":"' || name || '","kind":"' || kind || '","value":' || cast(cast(value as bigint) as varchar) || case when "count" is null then '' else ',"count":' || "count" end || '}}' as value from (select name, kind, round(value) as value, "count" from ({_SNAPSHOT}))""")
def metrics_json(spark, sf):
    return sinks.metrics_json(_snapshot(spark, sf).withColumn("value", F.round("value").cast("bigint")))


@query("""select cast(sum(d) as bigint) as queue_bytes, count(*) filter (where d > 800000) as pressured, count(*) filter (where d < 100000) as idle, round(sum(d) / 800000.0 * 100.0, 4) as usage_percent from (select cast(floor(s_acctbal * 100) as bigint) d from supplier)""")
def backpressure_summary(spark, sf):
    q = _t(spark, sf, "supplier").select(F.floor(F.col("s_acctbal") * 100).cast("bigint").alias("depth"))
    return planning.backpressure_summary(q, "depth", 800_000, 100_000).withColumn("usage_percent", _r("usage_percent", 4))


@query("""with j as (select user_id % 10 as node, case when event_type in ('view', 'click') then 'scan' else 'repair' end as kind, event_type <> 'error' and event_id % 9 > 0 as ok, cast(floor(value) as bigint) as ms from events)
select node, count(*) filter (where kind = 'scan') as scans, count(*) filter (where kind = 'scan' and not ok) as scans_failed, round(coalesce(avg(ms) filter (where kind = 'scan' and ok), 0.0), 6) as avg_scan_ms, count(*) filter (where kind = 'repair' and ok) as repairs,
count(*) filter (where kind = 'repair' and not ok) as repairs_failed, round(coalesce(avg(ms) filter (where kind = 'repair' and ok), 0.0), 6) as avg_repair_ms, cast(coalesce(sum(ms * 7) filter (where kind = 'repair' and ok), 0) as bigint) as bytes from j group by 1""")
def healer_stats(spark, sf):
    e = _t(spark, sf, "events").select((F.col("user_id") % 10).alias("node"), F.when(F.col("event_type").isin("view", "click"), "scan").otherwise("repair").alias("kind"), ((F.col("event_type") != "error") & (F.col("event_id") % 9 > 0)).alias("ok"), F.floor("value").cast("bigint").alias("ms"))
    h = metrics.healer_stats(e, ["node"], "kind", F.col("ok"), "ms", F.col("ms") * 7)
    return h.withColumn("avg_scan_ms", _r("avg_scan_ms")).withColumn("avg_repair_ms", _r("avg_repair_ms"))


@query("select user_id, round(1e6 * count(*) filter (where event_type = 'error') / count(*), 4) as ppm from events group by 1")
def scrub_ppm(spark, sf):
    e = _t(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count("*").alias("n"))
    return e.select("user_id", _r(metrics.error_ppm(F.col("e"), F.col("n")), 4).alias("ppm"))


@query("select l_returnflag, count(*) as items, round(sum(l_extendedprice) / sum(l_quantity), 6) as ratio, round(1.0 - sum(l_quantity) / sum(l_extendedprice), 8) as savings from lineitem group by 1")
def compression_stats(spark, sf):
    return metrics.compression(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").withColumn("ratio", _r("ratio")).withColumn("savings", _r("savings", 8))


@query("select user_id as domain, min(value) as min_ms, max(value) as max_ms, cast(floor(avg(value)) as bigint) as mean_ms, count(*) as samples from events group by 1")
def latency_by_domain(spark, sf):
    return metrics.latency_by_domain(_t(spark, sf, "events").withColumnRenamed("user_id", "domain"), "domain", "value")


# Access -----------------------------------------------------------------------------


@query("""with p as (select user_id, count(*) n, sum(value) ms from events group by 1) select cast(sum(n) as bigint) as accesses, count(*) as items, round(sum(ms) / sum(n), 6) as mean_latency, count(*) filter (where n >= 10) as hot, round(count(*) filter (where n >= 10) / count(*), 6) as hot_share from p""")
def access_totals(spark, sf):
    return access.access_totals(_t(spark, sf, "events"), "user_id", "value", 10).withColumn("mean_latency", _r("mean_latency")).withColumn("hot_share", _r("hot_share"))


_KEYS = "(select user_id % 60 as session, event_id, case user_id % 6 when 0 then 'run/checkpoint_' || event_id when 1 then 'data/batch_' || (event_id % 1000) when 2 then 'augment/' || event_type when 3 then 'valid/' || event_type when 4 then 'model_' || (event_id % 5) || '.bin' else 'x/' || event_type end as key from events)"


def _keys(spark, sf):
    k, e = F.col("user_id") % 6, F.col("event_id")
    key = (
        F.when(k == 0, F.concat(F.lit("run/checkpoint_"), e)).when(k == 1, F.concat(F.lit("data/batch_"), e % 1000)).when(k == 2, F.concat(F.lit("augment/"), "event_type"))
        .when(k == 3, F.concat(F.lit("valid/"), "event_type")).when(k == 4, F.concat(F.lit("model_"), e % 5, F.lit(".bin"))).otherwise(F.concat(F.lit("x/"), "event_type"))
    )
    return _t(spark, sf, "events").select((F.col("user_id") % 60).alias("session"), "event_id", key.alias("key"))


@query(f"""with k as (select session, event_id, key, try_cast(regexp_replace(key, '[^0-9]', '', 'g') as bigint) x from {_KEYS}), d as (select *, x - lag(x) over (partition by session order by event_id) d from k),
s as (select session, bool_or(contains(key, 'checkpoint') or contains(key, '.ckpt') or contains(key, '.pt') or contains(key, '.safetensors')) c, coalesce(avg(case when d is not null then case when d > 0 and d <= 10 then 1 else 0 end end), 0) > 0.5 t, bool_or(contains(key, 'preprocess') or contains(key, 'transform') or contains(key, 'augment')) p,
bool_or(contains(key, 'eval') or contains(key, 'valid') or contains(key, 'test')) v, bool_or(contains(key, 'model') or contains(key, 'weight') or ends_with(key, '.bin')) m from d group by 1)
select session, case when c then 'checkpointing' when t then 'training' when p then 'preprocessing' when v then 'evaluation' when m then 'inference' else 'unknown' end as workload from s""")
def workloads(spark, sf):
    return access.workload(_keys(spark, sf), "session", ["event_id"], "key")


@query(f"""with k as (select session, event_id, try_cast(regexp_replace(key, '[^0-9]', '', 'g') as bigint) x from {_KEYS}), d as (select *, x - lag(x) over (partition by session order by event_id) d from k),
s as (select session, count(*) n, coalesce(avg(case when d is not null then case when d > 0 and d <= 10 then 1 else 0 end end), 0.0) share from d group by 1) select session, n as records, round(share, 6) as share, share > 0.5 and n >= 5 as sequential from s""")
def ascending_batches(spark, sf):
    return access.sequential_keys(_keys(spark, sf), ["session"], ["event_id"], "key", 10, ascending=True).withColumn("share", _r("share"))


@query(f"""with m as (select session, regexp_replace(regexp_replace(regexp_replace(key, '(\\.bin)+$', ''), '(\\.pt)+$', ''), '(\\.safetensors)+$', '') b, row_number() over (partition by session order by event_id) - 1 n from {_KEYS} where contains(key, 'model'))
select session, n * 2 + i as "at", b || case i when 0 then '.bin' else '.safetensors' end as file from m, (values (0), (1)) v(i) where n * 2 + i < 20""")
def related_files(spark, sf):
    return access.related_files(_keys(spark, sf), "session", "key", ["event_id"])


@query("select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) rn from events) where rn <= 3")
def first_suggestions(spark, sf):
    return access.first_suggestions(_t(spark, sf, "events", "event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 3).select("event_id", "user_id")


@query("select c_custkey as item, score from (select c_custkey, c_acctbal / 10000.0 as score from customer) where score >= 0.7 order by score desc, c_custkey limit 20")
def prefetch_candidates(spark, sf):
    s = _t(spark, sf, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_acctbal") / 10000.0).alias("score"))
    return access.prefetch(s, "item", "score", 0.7, 20)


@query("""select distinct user_id as session, user_id % 7 as node, event_id as item from events where not exists (select 1 from lineitem where l_suppkey % 7 = user_id % 7 and l_orderkey = event_id)""")
def prestage(spark, sf):
    p = _t(spark, sf, "events").select(F.col("user_id").alias("session"), (F.col("user_id") % 7).alias("node"), F.col("event_id").alias("item")).distinct()
    h = _t(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("node"), F.col("l_orderkey").alias("item"))
    return planning.prestage(p, h, "session", "item", "node")


@query("""with recursive o as (select user_id, case when event_id % 4 = 0 then 0.0 else value end x, row_number() over (partition by user_id order by ts, event_id) i from events), f(user_id, i, a) as (select user_id, i, x from o where i = 1
union all select o.user_id, o.i, case when f.a = 0 then o.x else 0.3 * o.x + (1 - 0.3) * f.a end from o join f on o.user_id = f.user_id and o.i = f.i + 1) select user_id, round(max_by(a, i), 6) as value from f group by 1""")
def speed_average(spark, sf):
    e = _t(spark, sf, "events").withColumn("x", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")))
    return folds.ema(e, ["user_id"], ["ts", "event_id"], "x", 0.3, reseed_at_zero=True).withColumn("value", _r("value"))


@query("""with recursive o as (select user_id, case when value <= 30 then 1.0 when value <= 60 then 1.0 - 0.5 * (value - 30) / 30 else greatest(0.1, 0.5 * (1.0 - (value - 60) / 60)) end x, row_number() over (partition by user_id order by ts, event_id) i from events),
f(user_id, i, a) as (select user_id, i, cast(x as double) from o where i = 1 union all select o.user_id, o.i, 0.3 * o.x + (1 - 0.3) * f.a from o join f on o.user_id = f.user_id and o.i = f.i + 1) select user_id, round(max_by(a, i), 6) as value from f group by 1""")
def throttle_ratio(spark, sf):
    return folds.throttle(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 30.0, 60.0).withColumn("value", _r("value"))


@query("""with recursive s as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, (cast(floor(l_extendedprice) as bigint) * 8000) // cast(l_quantity as bigint) x, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, (cast(floor(l_extendedprice) as bigint) * 8000) // cast(l_quantity as bigint)) i from lineitem where cast(l_quantity as bigint) > 0),
f(k, i, a) as (select l_suppkey, i, cast(x as double) from s where i = 1 union all select s.l_suppkey, s.i, 0.3 * s.x + (1 - 0.3) * f.a from s join f on s.l_suppkey = f.k and s.i = f.i + 1) select k as l_suppkey, round(max_by(a, i), 2) as value from f group by 1""")
def drift_average(spark, sf):
    s = _t(spark, sf, "lineitem").withColumn("size", F.floor("l_extendedprice").cast("bigint")).withColumn("ms", F.col("l_quantity").cast("bigint"))
    return planning.drift_average(s, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "size", "ms").withColumn("value", _r("value", 2))


# Plans ------------------------------------------------------------------------------


@query("select o_orderkey, case when o_custkey % 5 > 0 and floor(o_totalprice) % 10 > 0 then cast(floor((floor(o_totalprice) % 10) * 1e6 / (o_custkey % 5 * 1000.0) * 1000.0) as bigint) end as eta from orders")
def eta(spark, sf):
    remaining, speed = (F.floor("o_totalprice") % 10) * 1e6, (F.col("o_custkey") % 5) * 1000.0
    return _t(spark, sf, "orders").select("o_orderkey", planning.eta_millis(remaining, speed).alias("eta"))


@query("""select o_orderkey, priority, o_orderdate from (select o_orderkey, cast(left(o_orderpriority, 1) as int) as priority, o_orderdate from orders) order by priority, o_orderdate, o_orderkey limit 40""")
def repair_queue(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), "o_orderdate")
    return planning.repair_queue(o, "priority", "o_orderdate", "o_orderkey", 40)


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 25")
def chunk_heap(spark, sf):
    return access.prefetch(_t(spark, sf, "part", "p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 0.0, 25)


@query(f"""with recursive e as (select edge, case when most > 0 then active / most else 0.0 end as load from {_EDGES}), n as (select count(*) n from e), o as (select list(edge order by edge) filter (where load > 0.8) os, list(edge) filter (where load < 0.2) us, list({{'e': edge, 'load': cast(load as double)}} order by edge) l from e),
c as (select list(k order by k) cs from (select distinct p_partkey k from part order by 1 limit 12)), a as (select list_slice(flatten(list_transform(os, lambda x: list_transform(cs, lambda y: {{'e': x, 'c': y}}))), 1, 48) t from o, c),
f(i, l, ops) as (select 0, l, cast([] as struct(chunk bigint, source bigint, target bigint, benefit double)[]) from o
union all select i + 1, case when b > 0 and len(ops) < 12 then list_transform(l, lambda x: {{'e': x.e, 'load': case when x.e = src then x.load - 1.0 / n when x.e = g.e then x.load + 1.0 / n else x.load end}}) else l end,
case when b > 0 and len(ops) < 12 then list_append(ops, {{'chunk': ch, 'source': src, 'target': g.e, 'benefit': b}}) else ops end
from (select *, fl - g.load as b from (select f.i, f.l, f.ops, n.n, a.t[i + 1].e src, a.t[i + 1].c ch, list_filter(f.l, lambda x: x.e = a.t[i + 1].e)[1].load fl, list_sort(list_transform(list_filter(f.l, lambda x: list_contains(o.us, x.e)), lambda x: {{'k': cast(greatest(floor(x.load * 1000), 0) as bigint), 'e': x.e, 'load': x.load}}))[1] g from f, a, o, n where i < len(a.t)))),
z as (select unnest(ops) p from f where i = (select max(i) from f)) select p.chunk as chunk, p.source as source, p.target as target, round(p.benefit, 8) as benefit from z""")
def rebalance(spark, sf):
    plan = planning.rebalance_plan(_edges(spark, sf), _t(spark, sf, "part", "p_partkey"), "edge", "p_partkey", "active", "most", 0.2, 0.8, 12)
    return plan.withColumn("benefit", _r("benefit", 8))


@query("""with e as (select s_suppkey as edge, s_suppkey % 11 / 10.0 as health, s_suppkey % 7 / 7.0 as load from supplier), h as (select distinct l_partkey as chunk, l_suppkey as edge from lineitem), p as (select p_partkey as chunk, p_size / 50.0 as confidence from part where p_size / 50.0 >= 0.5),
s as (select chunk, arg_max(h.edge, (health, -h.edge)) as source from h join e on h.edge = e.edge where health >= 0.5 and load < 0.9 group by 1), t as (select p.chunk, arg_min(e.edge, (load, e.edge)) as target from p join e on load < 0.8 and not exists (select 1 from h where h.chunk = p.chunk and h.edge = e.edge) group by 1)
select * from (select p.chunk, confidence, source, target, case when confidence >= 0.9 then 'high' when confidence >= 0.7 then 'medium' else 'low' end as priority from p join s on p.chunk = s.chunk join t on p.chunk = t.chunk order by p.chunk limit 60)""")
def preposition(spark, sf):
    k = F.col("s_suppkey")
    edges = _t(spark, sf, "supplier").select(k.alias("edge"), ((k % 11) / 10.0).alias("health"), ((k % 7) / 7.0).alias("load"))
    predicted = _t(spark, sf, "part").select(F.col("p_partkey").alias("chunk"), (F.col("p_size") / 50.0).alias("confidence"))
    held = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("edge"))
    return planning.preposition_plan(predicted, held, edges, "chunk", "edge", "confidence", 0.5, 60)


@query("select domain, millis, rank() over (order by millis) as rank from (select user_id as domain, cast(floor(avg(value)) as bigint) as millis from events group by 1 having max(event_id) >= 20)")
def ranked_domains(spark, sf):
    d = _t(spark, sf, "events").groupBy(F.col("user_id").alias("domain")).agg(metrics.steady_mean("value").alias("ms"), F.max("event_id").alias("last"))
    return planning.ranked_domains(d, "domain", "ms", F.when(F.col("last") >= 20, 0).otherwise(100), 50).withColumn("rank", F.col("rank").cast("bigint"))


@query("select s_suppkey, s_suppkey % 11 / 10.0 as health from supplier where s_suppkey % 11 / 10.0 >= 0.6")
def healthy_edges(spark, sf):
    s = _t(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 11) / 10.0).alias("health"))
    return fleet.healthy_only(s, "health", 0.6)


@query("""select s_suppkey, round(greatest(0.0, least(case when x > 0.8 then least((x - 0.8) * 2.0, 1.0) else 0.0 end + case when n < 3 then 0.0 when t > 0 then 0.2 when t < 0 then -0.1 else 0.0 end, 1.0)), 6) as penalty from (select s_suppkey, s_acctbal / 10000.0 as x, s_suppkey % 3 - 1 as t, s_suppkey % 5 as n from supplier)""")
def saturation_penalties(spark, sf):
    k = F.col("s_suppkey")
    return _t(spark, sf, "supplier").select("s_suppkey", _r(planning.saturation_penalty(F.col("s_acctbal") / 10000.0, k % 3 - 1, k % 5)).alias("penalty"))


@query("select event_id from events where (hour(ts + interval 3 hours) >= 20 or hour(ts + interval 3 hours) <= 4) and isodow(ts + interval 3 hours) - 1 in (0, 4, 6)")
def day_windows(spark, sf):
    return _t(spark, sf, "events").where(planning.window_active(F.col("ts"), 20, 4, (0, 4, 6), 3)).select("event_id")


@query("""select s_suppkey, round(case when s_suppkey % 2 = 0 then 1.5 else 1.0 end * coalesce(case when s_suppkey % 3 > 0 then 1 + s_acctbal / 1e4 end, 1.0) * case when s_suppkey % 5 = 0 then 2.0 else 1.0 end, 4) as multiplier from supplier""")
def combined_multipliers(spark, sf):
    k = F.col("s_suppkey")
    m = planning.combined_multiplier(F.when(k % 2 == 0, 1.5), F.when(k % 3 > 0, 1 + F.col("s_acctbal") / 1e4), F.when(k % 5 == 0, 2.0))
    return _t(spark, sf, "supplier").select("s_suppkey", _r(m, 4).alias("multiplier"))


@query("""select s_suppkey, not s_suppkey % 6 = 0 and s_acctbal / 10000.0 <= 0.7 and (s_suppkey % 4 = 0 or s_suppkey * 86400 >= 604800) as due, false as later from supplier""")
def deep_scrub(spark, sf):
    k = F.col("s_suppkey")
    last = F.when(k % 4 != 0, F.lit(NOW).cast("timestamp") - F.make_dt_interval(days=k.cast("int")))
    # The moment is a Thursday (4) at midnight: inside 22 to 4, outside 0 to 0.
    due = planning.deep_scrub_due(k % 6 == 0, F.col("s_acctbal") / 10000.0, 0.7, last, NOW, 604_800, 22, 4, (4,))
    later = planning.deep_scrub_due(k % 6 == 0, F.col("s_acctbal") / 10000.0, 0.7, last, NOW, 604_800, 22, 24, (0, 1, 2, 3, 5, 6))
    return _t(spark, sf, "supplier").select("s_suppkey", due.alias("due"), later.alias("later"))


@query("select o_orderkey, cast(o_custkey % 4 as int) as attempts from orders where o_orderstatus <> 'F' and o_custkey % 4 < 3")
def pending_repairs(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 4).cast("int").alias("attempts"))
    return rules.pending_repairs(o, F.col("o_orderstatus") == "F", F.col("attempts"), 3).select("o_orderkey", "attempts")


@query(f"""with l as (select case when coalesce(active / nullif(most, 0), 0.0) > 0.8 then 1 when coalesce(active / nullif(most, 0), 0.0) < 0.3 then -1 else 0 end c from {_EDGES}) select count(*) filter (where c = 1) as over, count(*) filter (where c = -1) as under, count(*) filter (where c = 1) >= 50 or (count(*) filter (where c = 1) >= 1 and count(*) filter (where c = -1) >= 50) as imbalanced from l""")
def load_imbalance(spark, sf):
    return fleet.load_imbalance(fleet.load_classes(_edges(spark, sf), "active", "most", 0.3, 0.8), 50)


@query("select n_nationkey, case when n_name = (select min(n_name) from nation) then 0 when n_regionkey = 1 then 1 else 2 end as distance from nation")
def by_proximity(spark, sf):
    n = _t(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    return fleet.by_proximity(n, "n_name", "n_regionkey", n.agg(F.min("n_name")).first()[0], 1).select("n_nationkey", "distance")


@query("""select o_orderkey, cast(d as double) as lru, round(d / log2(o_custkey % 9 + 2.0), 6) as lfu, round(d * sqrt(floor(o_totalprice)), 4) as size from (select *, datediff('day', o_orderdate, timestamp '2024-02-01') d from orders)""")
def spill_scores(spark, sf):
    idle, uses, size = F.datediff(F.lit(NOW).cast("timestamp_ntz"), F.col("o_orderdate")), F.col("o_custkey") % 9, F.floor("o_totalprice")
    return _t(spark, sf, "orders").select("o_orderkey", *[_r(fleet.spill_priority(p, idle, size, uses), d).alias(p) for p, d in (("lru", 6), ("lfu", 6), ("size", 4))])


@query(f"select edge, case when edge % 6 = 0 then 4294967295 else cast(greatest(floor(edge * 1000000 * 8000.0 / (edge % 6 * 1e6)), 1) as bigint) end as millis from {_EDGES}")
def transfer_times(spark, sf):
    return _edges(spark, sf).select("edge", fleet.transfer_millis(F.col("edge") * 1_000_000, (F.col("edge") % 6) * 1e6).alias("millis"))


@query("""select s_suppkey, s_suppkey % 3 = 0 or (s_suppkey % 5 = 0 or s_suppkey % 101 >= 30) as allowed, s_suppkey % 3 = 0 as charging_only from supplier""")
def power_rules(spark, sf):
    k = F.col("s_suppkey")
    level = F.when(k % 5 != 0, k % 101)
    return _t(spark, sf, "supplier").select("s_suppkey", fleet.power_allows(level, k % 3 == 0, 30).alias("allowed"), fleet.power_allows(level, k % 3 == 0, 30, only_charging=True).alias("charging_only"))


@query("""select user_id, case when user_id % 3 = 0 then 3 when user_id % 3 = 1 then 1 else 2 end as replicas, case when user_id % 3 = 2 then 'STANDARD' when user_id % 3 = 0 and user_id % 100 < 30 then 'STANDARD' when user_id % 100 >= 90 then 'ARCHIVE' when user_id % 100 >= 30 then 'IA' else 'STANDARD' end as tier from (select distinct user_id from events)""")
def tier_recommendations(spark, sf):
    k = F.col("user_id")
    pattern = F.when(k % 3 == 0, "write_once_read_many").when(k % 3 == 1, "write_heavy").otherwise("repeated")
    return _t(spark, sf, "events").select("user_id").distinct().select("user_id", rules.replication_factor(pattern).alias("replicas"), rules.recommend_tier(pattern, k % 100).alias("tier"))


@query("""with o as (select *, datediff('day', o_orderdate, timestamp '2024-02-01') as age, o_custkey % 2 = 0 as latest, case when o_custkey % 3 = 0 then 'COLD' else 'STANDARD' end as class from orders)
select o_orderkey, case when not latest and age >= 9000 and 'k' || o_orderstatus like 'kF%' then 'old:expire' when not latest and age >= 8500 and class <> 'COLD' and 'k' || o_orderstatus like 'kF%' then 'old:COLD' when latest and o_orderstatus = 'O' and age >= 9200 then 'now:expire' end as action from o""")
def noncurrent_versions(spark, sf):
    rs = [
        rules.LifecycleRule("off", prefix="k", noncurrent_expire_days=1, enabled=False),
        rules.LifecycleRule("old", prefix="kF", noncurrent_expire_days=9000, noncurrent_transition_days=8500, noncurrent_class="COLD"),
        rules.LifecycleRule("now", prefix="kO", expire_days=9200),
    ]
    o = _t(spark, sf, "orders").withColumn("key", F.concat(F.lit("k"), "o_orderstatus"))
    a = rules.lifecycle_action(rs, key=F.col("key"), age=F.datediff(F.lit(NOW).cast("timestamp_ntz"), F.col("o_orderdate")), storage_class=F.when(F.col("o_custkey") % 3 == 0, "COLD").otherwise("STANDARD"), now=NOW, is_latest=F.col("o_custkey") % 2 == 0)
    return o.select("o_orderkey", a.alias("action"))


@query("""select s_suppkey, case when s_suppkey % 4 = 0 and s_suppkey % 3 > 0 then 'healed' when s_suppkey % 4 = 0 then 'healthy' when s_suppkey * 10 >= 300 then 'confirmed' else 'suspected' end as state from supplier""")
def partition_states(spark, sf):
    k = F.col("s_suppkey")
    was = F.when(k % 3 == 0, "healthy").when(k % 3 == 1, "suspected").otherwise("confirmed")
    return _t(spark, sf, "supplier").select("s_suppkey", rules.partition_state(k % 4, F.lit(10), k * 10, 300, was).alias("state"))


@query("""select o_orderkey, case when lower(o_orderstatus) in ('f', 'p') and o_totalprice >= 1000 and o_totalprice < 150000 and o_orderdate > timestamp '1996-01-01' and o_orderpriority like '%-%' then 'Allow' else 'NotApplicable' end as decision from orders""")
def condition_operators(spark, sf):
    tests = {
        "StringEqualsIgnoreCase": {"status": ["F", "p"]}, "NumericGreaterThanEquals": {"price": 1000}, "NumericLessThan": {"price": [150000]}, "DateGreaterThan": {"day": ["1996-01-01"]},
        "StringLike": {"priority": "*-*"}, "StringNotEquals": {"status": "X"}, "Null": {"nothing": "true"}, "SomethingNew": {"status": "never"},
    }
    s = rules.Statement("Allow", actions=("*",), resources=("*",), conditions=tests)
    context = {"status": F.lower("o_orderstatus"), "price": F.col("o_totalprice").cast("string"), "day": F.col("o_orderdate").cast("string"), "priority": F.col("o_orderpriority")}
    d = rules.policy_decision([s], principal=F.lit("me"), action=F.lit("get"), resource=F.lit("x"), context=context)
    return _t(spark, sf, "orders").select("o_orderkey", d.alias("decision"))


@query("""select o_orderkey, case when o_custkey % 7 = 0 then 'held' when o_custkey % 3 = 0 then 'unlocked' when o_orderdate <= timestamp '2000-01-01' then 'expired' when o_orderstatus = 'F' then 'governance' else 'compliance' end as status from orders""")
def lock_statuses(spark, sf):
    until = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderdate").cast("timestamp"))
    mode = F.when(F.col("o_orderstatus") == "F", "GOVERNANCE").otherwise("COMPLIANCE")
    return _t(spark, sf, "orders").select("o_orderkey", rules.lock_status(mode, until, F.col("o_custkey") % 7 == 0, "2000-01-01 00:00:00").alias("status"))


@query("""with a as (select l_suppkey as edge, sum(l_extendedprice) * 1000.0 / sum(l_quantity) / 1.5e6 as ratio from lineitem group by 1) select edge, ratio < 0.98 as slow, ratio > 1.02 as fast from a where ratio < 0.98 or ratio > 1.02""")
def slow_and_fast_edges(spark, sf):
    t = _t(spark, sf, "lineitem", "l_suppkey", "l_extendedprice", "l_quantity").withColumnRenamed("l_suppkey", "edge")
    expected = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("edge"), F.lit(1.5e6).alias("expected_speed"))
    d = fleet.drift(t, "edge", "l_extendedprice", "l_quantity", expected, 1)
    return d.select("edge", (F.col("ratio") < 0.98).alias("slow"), (F.col("ratio") > 1.02).alias("fast")).where("slow or fast")


_LOCATIONS = "(select distinct l_partkey, l_quantity, l_suppkey, l_suppkey % 17 as ms, l_suppkey % 5 = 0 as main from lineitem)"


def _locations(spark, sf):
    return _t(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_suppkey").distinct().withColumn("ms", F.col("l_suppkey") % 17).withColumn("main", F.col("l_suppkey") % 5 == 0)


def _plan(spark, sf, prefer):
    return fleet.read_plan(_locations(spark, sf), "l_partkey", "l_quantity", "l_suppkey", "ms", F.col("l_suppkey") % 7 > 0, 10, prefer, F.col("main")).select("l_partkey", "l_quantity", "l_suppkey", "readable")


@query(f"select l_partkey, l_quantity, l_suppkey, count(*) over (partition by l_partkey) >= 10 as readable from (select *, row_number() over (partition by l_partkey, l_quantity order by l_suppkey) rn from {_LOCATIONS} where l_suppkey % 7 > 0) where rn = 1")
def read_plan_any(spark, sf):
    return _plan(spark, sf, "any")


@query(f"select l_partkey, l_quantity, l_suppkey, count(*) over (partition by l_partkey) >= 10 as readable from (select *, row_number() over (partition by l_partkey, l_quantity order by not main, ms, l_suppkey) rn from {_LOCATIONS} where l_suppkey % 7 > 0) where rn = 1")
def read_plan_primary(spark, sf):
    return _plan(spark, sf, "primary")


@query(f"select l_partkey as chunk, arg_min(l_suppkey, (case when l_suppkey = 3 then ms - 10.0 else ms end, l_suppkey)) as edge from (select *, cast(l_suppkey % 23 as double) as ms from (select distinct l_partkey, l_suppkey from lineitem)) group by 1")
def nearest_or_local(spark, sf):
    loc = _t(spark, sf, "lineitem", "l_partkey", "l_suppkey").distinct().select(F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("edge"), (F.col("l_suppkey") % 23).alias("ms"))
    return fleet.nearest(loc, "chunk", "edge", "ms", F.lit(True), local=3, margin=10.0)


@query("select l_suppkey, count(distinct l_partkey) as replicas from lineitem group by 1")
def chunks_per_edge(spark, sf):
    return fleet.replica_counts(_t(spark, sf, "lineitem", "l_partkey", "l_suppkey"), "l_suppkey", "l_partkey")


@query("""with e as (select *, case when event_type in ('view', 'click') then 'get' else 'put' end as op from events) select op, count(*) as operations, count(*) filter (where event_type = 'error') as errors, round(count(*) filter (where event_type = 'error') / count(*), 6) as error_rate from e group by 1""")
def put_and_get_errors(spark, sf):
    e = _t(spark, sf, "events").withColumn("op", F.when(F.col("event_type").isin("view", "click"), "get").otherwise("put")).withColumn("size", F.lit(1))
    return metrics.store_metrics(e, ["op"], "event_type", "value", "size").select("op", "operations", "errors", _r("error_rate").alias("error_rate"))


@query(f"""with k as (select session, event_id, key, row_number() over (partition by session order by event_id desc) rn from {_KEYS}), r as (select session, event_id, try_cast(nullif(regexp_extract(key, '([0-9]+)$', 1), '') as bigint) x from k where rn <= 100 and event_id % 3 > 0), d as (select *, x - lag(x) over (partition by session order by event_id) d from r),
s as (select session, count(*) n, coalesce(avg(case when d is not null then case when abs(d) <= 5 then 1 else 0 end end), 0.0) share from d group by 1) select session, n as records, round(share, 6) as share, share > 0.5 and n >= 5 as sequential from s""")
def recent_sequential(spark, sf):
    return access.recent_sequential(_keys(spark, sf), ["session"], ["event_id"], "key", F.col("event_id") % 3 > 0).withColumn("share", _r("share"))


@query("select c_name, i as step, regexp_replace(c_name, '[0-9]+$', '') || lpad(cast(cast(regexp_extract(c_name, '([0-9]+)$', 1) as bigint) + i as varchar), cast(greatest(length(regexp_extract(c_name, '([0-9]+)$', 1)), length(cast(cast(regexp_extract(c_name, '([0-9]+)$', 1) as bigint) + i as varchar))) as int), '0') as next from customer, range(1, 4) r(i)")
def next_keys(spark, sf):
    return access.next_keys(_t(spark, sf, "customer", "c_name"), "c_name", 3).withColumn("step", F.col("step").cast("bigint"))


@query(f"select event_id, regexp_extract(key, '^(.*/)?', 1) as folder, regexp_extract(key, '([^/]*)$', 1) as name, regexp_extract(regexp_extract(key, '([^/]*)$', 1), '[^.]\.([^.]*)$', 1) as ending from {_KEYS}")
def key_parts(spark, sf):
    return _keys(spark, sf).select("event_id", *[c.alias(n) for n, c in access.key_parts(F.col("key")).items()])


@query("""with d as (select doc_id, octet_length(encode(text)) as size, row_number() over (order by doc_id) - 1 i, count(*) over () n from documents) select count(*) as objects, cast(sum(size) as bigint) as bytes, round(avg(size / 1000.0) filter (where i % greatest(1, cast(ceil(n / 50.0) as bigint)) = 0), 6) as mean_entropy, count(*) filter (where i % greatest(1, cast(ceil(n / 50.0) as bigint)) = 0) as sampled from d""")
def payload(spark, sf):
    d = _t(spark, sf, "documents", "doc_id", "text").select("doc_id", F.octet_length("text").alias("size"))
    return access.payload(d, "doc_id", "size", F.col("size") / 1000.0).withColumn("mean_entropy", _r("mean_entropy"))


# Collectives --------------------------------------------------------------------------


def _held(spark, sf):
    return _t(spark, sf, "events").groupBy((F.col("user_id") % 4).cast("int").alias("rank"), (F.col("event_id") % 50).alias("key")).agg(F.sum(F.floor("value").cast("long")).alias("value"))


_HELD = "(select cast(user_id % 4 as int) as rank, event_id % 50 as key, cast(sum(cast(floor(value) as bigint)) as bigint) as value from events group by 1, 2)"


@query(f"select rank as source, key, value, 2 as rank from {_HELD}")
def gathered(spark, sf):
    return collective.gather(_held(spark, sf), "rank", 2)


@query(f"select h.rank as source, key, value, r.rank as rank from {_HELD} h, (values (0), (1), (2), (3)) r(rank) where h.rank = 1")
def broadcasted(spark, sf):
    return collective.broadcast(_held(spark, sf), "rank", 1, 4)


@query(f"select h.rank as source, key, value, r.rank as rank from {_HELD} h, (values (0), (1), (2), (3)) r(rank)")
def all_gathered(spark, sf):
    return collective.all_gather(_held(spark, sf), "rank", 4)


@query(f"select r.rank as rank, key, value from (select key, max(value) as value from {_HELD} group by 1), (values (0), (1), (2), (3)) r(rank)")
def all_reduced(spark, sf):
    return collective.all_reduce(_held(spark, sf), "rank", "key", "value", "max", 4)


@query(f"select cast(key % 4 as int) as rank, key, cast(sum(value) as bigint) as value from {_HELD} group by 1, 2")
def reduce_scattered(spark, sf):
    return collective.reduce_scatter(_held(spark, sf), "rank", "key", "value", "sum", 4)
