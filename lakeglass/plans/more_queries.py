"""Further registered queries: constraints, scores, elections, overlays, clocks, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeglass.functions import content
from lakeglass.operators import access, crdt, dedup, fleet, folds, metrics, rules, versions
from lakeglass.plans.queries import _EDGES, _OBJECTS, MILLIS, NOW, _blocks, _edges, _objects, _r, _t, query
from lakeglass.sources import sinks


@query("""with p as (select event_type, 'b' || le as k, le, count(*) filter (where floor(value) <= le) c from events, (values (10.0::double),(50.0)) b(le) group by event_type, le),
l as (select event_type, '# TYPE latency_' || event_type || ' histogram' as value from (select distinct event_type from events)
union all select event_type, 'latency_' || event_type || '_bucket{le="' || le || '"} ' || c from p
union all select event_type, 'latency_' || event_type || '_bucket{le="+Inf"} ' || count(*) from events group by 1
union all select event_type, 'latency_' || event_type || '_sum ' || cast(sum(v) as bigint) from (select event_type, cast(floor(value) as bigint) v from events) group by 1
union all select event_type, 'latency_' || event_type || '_count ' || count(*) from events group by 1) select value from l""")
def prometheus_export(spark, sf):
    e = _t(spark, sf, "events").withColumn("value", F.floor("value").cast("bigint"))
    h = metrics.histogram_summary(e, ["event_type"], "value", (10.0, 50.0)).withColumn("name", F.concat(F.lit("latency_"), "event_type")).withColumn("sum", F.col("sum").cast("bigint"))
    return sinks.prometheus(None, h)


@query("""with s as (select s_suppkey as edge, s_acctbal / 10000.0 as x, s_suppkey % 3 - 1 as trend from supplier)
select edge, round(case when x > 0.8 then greatest(0.0, least(least((x - 0.8) * 5.0, 1.0) + case when trend > 0 then 0.3 when trend < 0 then -0.1 else 0.0 end, 1.0)) else 0.0 end, 6) as cost, round(greatest(1.0 - x, 0.0), 6) as headroom from s""")
def saturation_costs(spark, sf):
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("edge"), (F.col("s_acctbal") / 10000.0).alias("x"), (F.col("s_suppkey") % 3 - 1).alias("trend"))
    return s.select("edge", _r(fleet.saturation_cost(F.col("x"), F.col("trend"), 0.8)).alias("cost"), _r(fleet.headroom(F.col("x"))).alias("headroom"))


@query(f"""with c as (select chunk, edge, 1.0 + chunk % 7 as cost from (select distinct l_partkey as chunk, l_suppkey as edge from lineitem)), k as (select edge, edge % 9 <> 0 as available, case when edge % 5 = 0 then 'inf'::double else 1.0 + edge % 4 end as multiplier from {_EDGES} where edge % 2 = 0)
select c.chunk, c.edge, cost * coalesce(multiplier, 1.0) as cost from c left join k on c.edge = k.edge where coalesce(available, true) and coalesce(multiplier, 1.0) < 'inf'::double""")
def constrained_costs(spark, sf):
    c = _t(spark, sf, "lineitem", "l_partkey", "l_suppkey").select(F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("edge")).distinct().withColumn("cost", 1.0 + F.col("chunk") % 7)
    k = _edges(spark, sf).where("edge % 2 = 0").select("edge", (F.col("edge") % 9 != 0).alias("available"), F.when(F.col("edge") % 5 == 0, F.lit(float("inf"))).otherwise(1.0 + F.col("edge") % 4).alias("multiplier"))
    return fleet.apply_constraints(c, k, "edge").select("chunk", "edge", "cost")


@query("select event_id from events where (hour(ts) >= 22 or hour(ts) <= 5) and not (hour(ts) >= 1 and hour(ts) < 3)")
def time_windows(spark, sf):
    h = F.hour("ts")
    return _t(spark, sf, "events").where(fleet.in_hours(h, 22, 5) & ~fleet.in_hours(h, 1, 3, inclusive=False)).select("event_id")


@query("""select c_custkey, case when c_acctbal + 500 <= 4000 then round(1.0 + (c_acctbal + 500) / 4000, 8) when c_acctbal + 500 <= 8000 then round(1.0 + 2.0 * (c_acctbal + 500) / 4000, 8) else -1.0 end as multiplier from customer""")
def budget_multipliers(spark, sf):
    m = fleet.budget_multiplier(F.col("c_acctbal"), F.lit(4000.0), F.lit(500.0))
    return _t(spark, sf, "customer").select("c_custkey", F.when(m < F.lit(float("inf")), _r(m, 8)).otherwise(-1.0).alias("multiplier"))


@query("""select s_suppkey, case when s_suppkey % 10 = 0 then 0.0 else round(greatest(0.0, 100.0 - 30.0 * (s_acctbal / 10000.0) + case when s_suppkey % 2 = 0 and s_suppkey % 3 = 0 then 20.0 when s_suppkey % 2 = 0 then 10.0 else 0.0 end + case when s_suppkey % 4 = 0 then 30.0 else -50.0 end), 6) end as score from supplier""")
def placement_scores(spark, sf):
    k = F.col("s_suppkey")
    s = fleet.placement_score(k % 10 != 0, F.col("s_acctbal") / 10000.0, k % 2 == 0, k % 3 == 0, F.when(k % 4 == 0, "rdma").otherwise("tcp"), F.lit("rdma"))
    return _t(spark, sf, "supplier").select("s_suppkey", _r(s).alias("score"))


@query("""select s_suppkey, round(20.0 * s_acctbal * 1e9 / 1e12 + 30.0 * (1.0 - s_suppkey % 10 / 10.0) + case when s_suppkey % 2 = 0 then 40.0 else 0.0 end + 10.0 * s_nationkey * 1e9 / 1e10, 6) as score from supplier order by 2 desc, 1 limit 10""")
def best_nodes(spark, sf):
    k = F.col("s_suppkey")
    s = fleet.node_score(F.col("s_acctbal") * 1e9, (k % 10) / 10.0, k % 2 == 0, F.col("s_nationkey") * 1e9)
    return _t(spark, sf, "supplier").select("s_suppkey", _r(s).alias("score")).orderBy(F.desc("score"), "s_suppkey").limit(10)


@query("""select event_id, round(0.5 * greatest(0.0, least(1.0, 1.0 - user_id % 10 / 10.0)) + 0.3 * greatest(0.0, least(1.0, 1.0 - value / 500.0)) + 0.2 * greatest(0.0, least(1.0, 1.0 - value / 100.0)), 6) as quality from events""")
def network_quality(spark, sf):
    q = fleet.network_quality((F.col("user_id") % 10) / 10.0, F.col("value"), F.col("value"))
    return _t(spark, sf, "events").select("event_id", _r(q).alias("quality"))


@query("""with v as (select s_nationkey, s_suppkey, s_suppkey % 3 as cand from supplier), p as (select s_nationkey, cand, count(distinct s_suppkey) n from v group by 1, 2)
select s_nationkey, max_by(cand, (n, cand)) as leader, max(n) as votes, cast(sum(n) as bigint) as "cast", case when max(n) >= 3 then 'elected' when sum(n) >= 5 then 'split' else 'pending' end as outcome from p group by 1""")
def elections(spark, sf):
    v = _t(spark, sf, "supplier").withColumn("cand", F.col("s_suppkey") % 3)
    return fleet.election(v, "s_nationkey", "s_suppkey", "cand", 5)


@query("""with r as (select *, row_number() over (partition by l_partkey, l_quantity order by l_suppkey % 17, l_suppkey) rn from (select distinct l_partkey, l_quantity, l_suppkey from lineitem))
select l_partkey, l_quantity, l_suppkey, count(*) over (partition by l_partkey) >= 15 as readable from r where rn = 1""")
def read_plan(spark, sf):
    loc = _t(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_suppkey").distinct().withColumn("ms", F.col("l_suppkey") % 17)
    return fleet.read_plan(loc, "l_partkey", "l_quantity", "l_suppkey", "ms", F.lit(True), 15).select("l_partkey", "l_quantity", "l_suppkey", "readable")


@query("""with h as (select l_partkey, list(distinct cast(l_linenumber as int)) filter (where l_linestatus = 'O') x from lineitem group by 1)
select l_partkey, array_to_string(list_sort(list_filter(range(0, 8), lambda i: not list_contains(coalesce(x, []), i))), ',') as missing from h where len(list_filter(range(0, 8), lambda i: not list_contains(coalesce(x, []), i))) > 0""")
def repair_candidates(spark, sf):
    s = _t(spark, sf, "lineitem", "l_partkey", "l_linenumber", "l_linestatus")
    return fleet.repair_candidates(s, "l_partkey", "l_linenumber", F.col("l_linestatus") == "O", 8).select("l_partkey", F.array_join("missing", ",").alias("missing"))


@query("""select l_suppkey as edge, count(*) as samples, round(sum(l_extendedprice) * 1000.0 / sum(l_quantity), 4) as speed, round(sum(l_extendedprice) * 1000.0 / sum(l_quantity) / 1.5e6, 4) as ratio from lineitem group by 1 having count(*) >= 100""")
def drift(spark, sf):
    t = _t(spark, sf, "lineitem", "l_suppkey", "l_extendedprice", "l_quantity").withColumnRenamed("l_suppkey", "edge")
    expected = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("edge"), F.lit(1.5e6).alias("expected_speed"))
    return fleet.drift(t, "edge", "l_extendedprice", "l_quantity", expected, 100).select("edge", "samples", _r("speed", 4).alias("speed"), _r("ratio", 4).alias("ratio"))


@query("""with p as (select event_type, cast(floor(sqrt(value)) as bigint) as path, count(*) n from events group by 1, 2), f as (select *, sum(n) over (partition by event_type) / count(*) over (partition by event_type) fair from p) select event_type, path, n from f where n < 0.1 * fair""")
def underused_paths(spark, sf):
    e = _t(spark, sf, "events").withColumn("path", F.floor(F.sqrt("value")).cast("bigint"))
    return fleet.underused_paths(e, ["event_type"], "path")


@query("""with w as (select doc_id, size, lag(size) over o a, lead(size) over o b from """ + _OBJECTS + """ window o as (partition by bucket order by doc_id)) select doc_id, (a is null or size < a) and (b is null or size < b) as is_minimum from w""")
def local_minima(spark, sf):
    return fleet.local_minima(_objects(spark, sf), ["bucket"], "doc_id", "size").select("doc_id", "is_minimum")


@query("""with o as (select c_custkey k, c_acctbal v from customer where c_custkey % 3 <> 0), w as (select c_custkey k, c_acctbal * 2 v, c_custkey % 4 = 0 gone from customer where c_custkey % 2 = 0)
select coalesce(o.k, w.k) as k, case when w.k is not null then w.v else o.v end as v from o full join w on o.k = w.k where not coalesce(gone, false)""")
def clone_overlay(spark, sf):
    c = _t(spark, sf, "customer")
    base = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    own = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 2).alias("v"), (F.col("c_custkey") % 4 == 0).alias("gone"))
    return versions.overlay(base, own, "k", "v", "gone")


@query("select user_id, arg_min(event_id, (ts, event_id)) as event_id from events group by 1")
def first_seen(spark, sf):
    return versions.first_seen(_t(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("""with m as (select event_id % 40 as entry, user_id % 5 as node, value, epoch_us(ts) // 1000 as p, event_id % 2 as l, event_type = 'error' as gone from events), x as (select entry, max_by({'v': value, 'g': gone}, (p, l, node, gone, value)) b from m group by 1) select entry, b.v as value from x where not b.g""")
def lww_map(spark, sf):
    w = _t(spark, sf, "events").select((F.col("event_id") % 40).alias("entry"), (F.col("user_id") % 5).alias("node"), "value", F.expr(MILLIS).alias("physical"), (F.col("event_id") % 2).alias("logical"), (F.col("event_type") == "error").alias("gone"))
    return crdt.lww_map_merge(w, ["entry"], "value", "gone")


@query("""with a as (select event_type k, user_id % 5 n, max(event_id) x from events where event_id % 3 <> 0 group by 1, 2), b as (select event_type k, user_id % 5 n, max(event_id) x from events where event_id % 3 = 0 group by 1, 2)
select b.k as key, bool_and(coalesce(a.x, 0) >= b.x) as dominates from b left join a on a.k = b.k and a.n = b.n group by 1""")
def gcounter_dominates(spark, sf):
    s = _t(spark, sf, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 5).alias("node"), "event_id")
    state = lambda d: crdt.gcounter_state(d, "key", "node", "event_id")
    return crdt.gcounter_dominates(state(s.where("event_id % 3 <> 0")), state(s.where("event_id % 3 = 0")), "key", "node", "event_id")


@query("""with recursive o as (select user_id, epoch_us(ts) // 1000 // 86400000 as x, row_number() over (partition by user_id order by ts, event_id) i from events), f(user_id, i, p, l) as (select user_id, i, x, 0 from o where i = 1
union all select o.user_id, o.i, greatest(o.x, f.p), case when o.x > f.p then 0 else f.l + 1 end from o join f on o.user_id = f.user_id and o.i = f.i + 1) select user_id, max_by(p, i) as physical, max_by(l, i) as logical from f group by 1""")
def clock_ticks(spark, sf):
    e = _t(spark, sf, "events").withColumn("day", F.expr(f"{MILLIS} div 86400000"))
    return folds.clock_tick(e, "user_id", ["ts", "event_id"], "day")


@query("""with recursive o as (select user_id, case when event_type in ('error', 'view') then -1 else 1 end s, cast(floor(value) as bigint) v, row_number() over (partition by user_id order by ts, event_id) i from events),
f(user_id, i, b, n) as (select user_id, i, greatest(s * v, 0), greatest(s, 0) from o where i = 1 union all select o.user_id, o.i, greatest(f.b + s * v, 0), greatest(f.n + s, 0) from o join f on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, cast(max_by(b, i) as bigint) as bytes, cast(max_by(n, i) as bigint) as objects from f group by 1""")
def quota_usage(spark, sf):
    e = _t(spark, sf, "events").withColumn("size", F.floor("value").cast("long"))
    return rules.quota_usage(e, "user_id", "size", F.col("event_type").isin("error", "view"), ["ts", "event_id"])


@query("""select o_orderkey, o_custkey % 7 <> 0 and (o_custkey % 3 = 0 or o_orderdate <= timestamp '2000-01-01' or (o_orderstatus = 'F')) as deletable from orders""")
def retention_lock(spark, sf):
    until = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderdate").cast("timestamp"))
    mode = F.when(F.col("o_orderstatus") == "F", "GOVERNANCE").otherwise("COMPLIANCE")
    return _t(spark, sf, "orders").select("o_orderkey", rules.can_delete(mode, until, F.col("o_custkey") % 7 == 0, "2000-01-01 00:00:00", True).alias("deletable"))


@query("""select s_suppkey, not s_suppkey % 6 = 0 and s_acctbal / 10000.0 < 0.7 and (s_suppkey % 4 = 0 or s_suppkey * 3600 >= 86400) as due, case when s_suppkey / 400.0 < 0.01 then 2 when s_suppkey / 400.0 < 0.05 then 3 when s_suppkey / 400.0 < 0.1 then 4 when s_suppkey / 400.0 < 0.2 then 6 else 8 end as parity from supplier""")
def scrub_and_parity(spark, sf):
    k = F.col("s_suppkey")
    last = F.when(k % 4 != 0, F.lit(NOW).cast("timestamp") - F.make_dt_interval(hours=k.cast("int")))
    due = rules.scrub_due(k % 6 == 0, F.col("s_acctbal") / 10000.0, 0.7, last, NOW, 86400)
    return _t(spark, sf, "supplier").select("s_suppkey", due.alias("due"), rules.parity_for_loss(k / 400.0).alias("parity"))


@query("""select o_orderkey, case when o_custkey % 9 = 0 then 'pause' when o_totalprice / 500000 >= 0.9 or o_custkey % 8 = 0 or o_orderstatus = 'F' then 'full' when o_custkey % 2 > 0 then 'partial' else 'none' end as decision from orders""")
def reoptimisation(spark, sf):
    k = F.col("o_custkey")
    d = rules.reoptimise(k % 9 == 0, F.col("o_totalprice") / 500000, k % 8 == 0, F.col("o_orderstatus") == "F", k % 2, 0.9)
    return _t(spark, sf, "orders").select("o_orderkey", d.alias("decision"))


@query("""with h as (select user_id as item from events group by 1 having count(*) >= 12), w as (select user_id v, user_id - lag(user_id) over o d, row_number() over o i from events window o as (order by ts, event_id)), r as (select v as last, d from (select v, d, lead(d) over (order by i) nx from w) where abs(d) = 1 and nx is distinct from d),
f as (select unnest(range(item - 2, item + 3)) as item, 0.9::double s from h union all select last + i * d, 1.0 - 0.15 * (i - 1) from r, range(1, 5) x(i))
select i.item, round(coalesce(max(s), 0.0), 6) as score from (select c_custkey as item from customer) i left join f on f.item = i.item group by 1""")
def prediction_scores(spark, sf):
    log = _t(spark, sf, "events", "event_id", "ts", "user_id").withColumn("all", F.lit(1))
    hot = access.hot_items(log, "user_id", 12).select(F.col("user_id").alias("item"))
    found = access.sequential_runs(log, ["all"], ["ts", "event_id"], "user_id")
    runs = found.select((F.col("start") + (F.col("length") - 1) * F.col("direction")).alias("last"), "direction")
    return access.score_predictions(_t(spark, sf, "customer").select(F.col("c_custkey").alias("item")), runs, hot).withColumn("score", _r("score"))


@query("""with s as (select c_custkey as item, c_acctbal / 10000.0 as score from customer), r as (select *, row_number() over (order by score desc, item) - 1 i from s), b as (select cast(i // 100 as int) as batch, count(*) as n, avg(score) c from r group by 1)
select batch, n, round(c, 6) as confidence, case when c > 0.8 then 'high' when c > 0.5 then 'normal' else 'low' end as priority from b""")
def prediction_batches(spark, sf):
    s = _t(spark, sf, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_acctbal") / 10000.0).alias("score"))
    return access.prediction_batches(s, 100).select("batch", F.size("items").cast("long").alias("n"), _r("confidence").alias("confidence"), "priority")


@query("""with b as (select sha256(content) as hash, min(doc_id) as doc from (select doc_id, i as block, substr(text, cast(i * 256 + 1 as bigint), 256) as content from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 256) as bigint))) i from documents)) group by 1)
select hash, doc from b where doc % 4 = 0 and hash not in (select sha256(text) from documents) and doc >= 100 order by doc desc, hash limit 50""")
def gc_batch(spark, sf):
    reg = _blocks(spark, sf).groupBy("hash").agg(F.min("doc_id").alias("doc")).where("doc % 4 = 0")
    refs = _t(spark, sf, "documents", "text").select(dedup.content_hash(F.col("text")).alias("hash"))
    return dedup.collectable(reg, refs, "hash", F.col("doc"), 100, 50)


@query("""with h as (select doc_id, regexp_extract_all(hex(encode(text)), '..') x from documents where length(text) > 0), b as (select doc_id, i % 16 as p, cast(('0x' || x[i + 1]) as int) as v from (select doc_id, x, unnest(range(0, len(x))) i from h))
select doc_id, cast(sum(v) as bigint) as parity from (select doc_id, p, bit_xor(v) v from b group by 1, 2) group by 1""")
def xor_parity(spark, sf):
    d = _t(spark, sf, "documents", "doc_id", "text").where(F.length("text") > 0).select("doc_id", F.encode("text", "UTF-8").alias("b"))
    stripe = lambda i: F.hex(F.substring(F.col("b"), i * 16 + 1, F.lit(16)))
    stripes = d.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 16).cast("int")), stripe)).alias("h"))
    # The parity of whole stripes at once: two 64-bit halves, then their 16 bytes.
    half = lambda at: F.conv(F.rpad(F.substring("h", at, 16), 16, "0"), 16, -10).cast("bigint")
    whole = stripes.groupBy("doc_id").agg(F.bit_xor(half(1)).alias("l"), F.bit_xor(half(17)).alias("r"))
    bytes_ = [F.shiftrightunsigned(c, 56 - 8 * i).bitwiseAND(F.lit(255)) for c in ("l", "r") for i in range(8)]
    total = bytes_[0]
    for b in bytes_[1:]:
        total = total + b
    return whole.select("doc_id", total.cast("bigint").alias("parity"))
