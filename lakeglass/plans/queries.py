"""The registered queries of the storage-analytics operators, and DuckDB SQL for each.

The tables stand in for a store's own: ``events`` is the access log (a user is an
item), ``documents`` are objects, ``supplier`` is the fleet of edges, a row of
``lineitem`` a replica of a part on a supplier, ``orders`` are objects with an age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.functions import content
from lakeglass.operators import access, crdt, dedup, fleet, folds, metrics, rules, versions
from lakeglass.plans.select import select
from lakeglass.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The moment all ages refer to.
NOW = "2024-02-01 00:00:00"
MILLIS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
BOUNDS = (10.0, 25.0, 50.0, 100.0, 250.0)
LOW, HIGH = 30.0, 60.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return readers.read_parquet(spark, f"{sf_dir}/{name}.parquet", columns or None)


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects: ``doc_id, bucket, key, size, text``."""
    d = _t(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return d.select("doc_id", F.col("source").alias("bucket"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("key"), F.octet_length("text").cast("long").alias("size"), "text")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_OBJECTS = "(select doc_id, source as bucket, source || '/' || lang || '/' || doc_id as key, octet_length(encode(text)) as size, text from documents)"

# Select -----------------------------------------------------------------------------


@query("select l_orderkey, l_quantity from lineitem where l_quantity > 25 and l_returnflag like 'R%'")
def select_filter(spark, sf):
    return select(_t(spark, sf, "lineitem"), "SELECT l_orderkey, l_quantity FROM s3object s WHERE s.l_quantity > 25 AND l_returnflag LIKE 'R%'")


@query("select o_orderkey, o_orderpriority as priority from orders where o_orderstatus in ('F','P') and o_totalprice between 100000 and 200000 and o_orderpriority not like '%LOW'")
def select_in_between_like(spark, sf):
    return select(_t(spark, sf, "orders"), "SELECT o_orderkey, o_orderpriority AS priority FROM s3object WHERE o_orderstatus IN ('F','P') AND o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority NOT LIKE '%LOW'")


@query("select l_orderkey, l_quantity * l_discount as saved, l_returnflag || l_linestatus as flags, l_quantity / nullif(l_tax, 0) as per_tax from lineitem where l_discount * 100 + 1 >= 8 or not l_quantity < 49")
def select_arithmetic(spark, sf):
    return select(_t(spark, sf, "lineitem"), "SELECT l_orderkey, l_quantity * l_discount AS saved, l_returnflag || l_linestatus AS flags, l_quantity / l_tax AS per_tax FROM s3object WHERE l_discount * 100 + 1 >= 8 OR NOT l_quantity < 49")


@query("""with x as (select event_id, case when event_id % 5 = 0 then null else value end v, case when event_id % 7 = 0 then null else event_type end k from events)
select event_id from x where (v is null and k is null) or (v > 100) is true""")
def select_null_semantics(spark, sf):
    x = _t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("k"))
    return select(x, "SELECT event_id FROM s3object WHERE (v IS NULL AND k IS NULL) OR v > 100")


@query("""with x as (select event_id, case when event_id % 5 = 0 then null else value end v, case when event_id % 7 = 0 then null else event_type end k from events)
select event_id from x where k is not distinct from null or (v is not null and not (v between 10 and 400)) or v is null""")
def select_compat(spark, sf):
    x = _t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("k"))
    return select(x, "SELECT event_id FROM s3object WHERE k = NULL OR v NOT BETWEEN 10 AND 400", mode="compat")


@query("select event_id, event_type from (select *, row_number() over (order by event_id) rn from events where value > 200) where rn <= 25")
def select_limit(spark, sf):
    ordered = _t(spark, sf, "events").where("value > 200").orderBy("event_id")
    return select(ordered, "SELECT event_id, event_type FROM s3object LIMIT 25")


@query("select cast(event_id as varchar) || ',' || event_type || ',\"' || replace(props, '\"', '\"\"') || '\"' as value from events where event_type = 'error'")
def csv_sink(spark, sf):
    return sinks.csv_lines(_t(spark, sf, "events").where("event_type = 'error'"), ["event_id", "event_type", "props"])


@query("select '{\"c_custkey\":' || c_custkey || case when c_custkey % 3 = 0 then '' else ',\"segment\":\"' || c_mktsegment || '\"' end || '}' as value from customer")
def json_sink(spark, sf):
    return sinks.json_lines(_t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")))


# Listings ---------------------------------------------------------------------------


@query(f"""select key, size, n > 100 as is_truncated from (select key, size, count(*) over () n, row_number() over (order by key) rn from {_OBJECTS} where starts_with(key, 'src1') and key > 'src1/en/5') where rn <= 100""")
def list_prefix_topk(spark, sf):
    return readers.list_objects(_objects(spark, sf).select("key", "size"), prefix="src1", start_after="src1/en/5", max_keys=100)


@query(f"select bucket || '/' || split_part(key, '/', 2) || '/' as common_prefix, count(*) as n_keys, cast(sum(size) as bigint) as bytes from {_OBJECTS} where starts_with(key, 'src3/') group by 1")
def common_prefix_rollup(spark, sf):
    return readers.common_prefixes(_objects(spark, sf).select("key", "size"), prefix="src3/")


@query("select distinct source as bucket from documents")
def list_buckets(spark, sf):
    return readers.list_buckets(_objects(spark, sf))


@query(f"select count(*) as n_objects, cast(sum(size) as bigint) as total_bytes from {_OBJECTS}")
def walk_total(spark, sf):
    return readers.total_size(_objects(spark, sf))


# Metrics ----------------------------------------------------------------------------


@query("select event_type, le, cast(count(*) filter (where value <= le) as bigint) as \"count\" from events, (values (10.0::double),(25.0),(50.0),(100.0),(250.0)) b(le) group by event_type, le")
def hist_cumulative(spark, sf):
    return metrics.cumulative_histogram(_t(spark, sf, "events", "event_type", "value"), ["event_type"], "value", BOUNDS)


@query("""with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 rn, count(*) over (partition by event_type) n from events)
select event_type, p as percent, value from s, (values (50.0::double),(90.0),(99.0)) q(p) where rn = floor(p / 100 * (n - 1) + 0.5)""")
def pctl_nearest_rank(spark, sf):
    return metrics.nearest_rank(_t(spark, sf, "events", "event_type", "value"), ["event_type"], "value", [50, 90, 99])


@query("""select user_id, count(*) as operations, cast(sum(octet_length(encode(props))) as bigint) as bytes, round(avg(value), 6) as mean_latency, count(*) filter (where event_type = 'error') as errors,
round(count(*) filter (where event_type = 'error') / count(*), 6) as error_rate from events group by 1""")
def error_ratio_by_item(spark, sf):
    e = _t(spark, sf, "events").withColumn("bytes", F.octet_length("props"))
    m = metrics.store_metrics(e, ["user_id"], "event_type", "value", "bytes")
    return m.withColumn("mean_latency", _r("mean_latency")).withColumn("error_rate", _r("error_rate"))


@query("""select event_type, cast(sum(bytes) as bigint) as bytes, count(*) as "count", min(value) as min_latency, max(value) as max_latency, cast(floor(sum(value) / count(*)) as bigint) as avg_latency
from (select *, octet_length(encode(props)) as bytes from events) group by 1""")
def stage_stats(spark, sf):
    return metrics.stage_stats(_t(spark, sf, "events").withColumn("bytes", F.octet_length("props")), "event_type", "value", "bytes")


@query("""select case when grouping(o_orderpriority) = 0 then 'bucket' when grouping(o_custkey) = 0 then 'user' else 'global' end as scope,
coalesce(o_orderpriority, cast(o_custkey as varchar), '*') as name, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as bytes, count(*) as objects from orders group by grouping sets ((o_orderpriority),(o_custkey),())""")
def usage_grouping_sets(spark, sf):
    o = _t(spark, sf, "orders").withColumn("size", F.floor("o_totalprice").cast("long"))
    return metrics.usage_grouping_sets(o, "o_orderpriority", "o_custkey", "size")


@query("""select event_type, cast(sum(user_id) as bigint) as "sum", max(user_id) as "max", min(user_id) as "min", bit_and(user_id) as bit_and, bit_or(user_id) as bit_or, bit_xor(user_id) as bit_xor from events group by 1""")
def reduce_operators(spark, sf):
    return metrics.reduce_values(_t(spark, sf, "events", "event_type", "user_id"), ["event_type"], "user_id").drop("product")


@query("""select s_suppkey, round(0.4 * ok + 0.3 * (1.0 - least(ms / 5000.0, 1.0)) + 0.3 * up, 6) as score from (
select s_suppkey, (s_suppkey % 100) / 100.0 as ok, s_acctbal as ms, 1.0 - (s_suppkey % 7) / 10.0 as up from supplier)""")
def health_score(spark, sf):
    k = F.col("s_suppkey")
    return _t(spark, sf, "supplier").select("s_suppkey", _r(fleet.health_score((k % 100) / 100.0, F.col("s_acctbal"), 1.0 - (k % 7) / 10.0)).alias("score"))


@query("""select event_type, v.value as "value" from (select event_type, max_by(value, (ts, event_id)) as value from events group by 1) v""")
def gauge_last(spark, sf):
    return metrics.gauge(_t(spark, sf, "events"), ["event_type"], "value", ["ts", "event_id"])


# Access log --------------------------------------------------------------------------


@query("select user_id, count(*) as accesses from events group by 1 having count(*) >= 70")
def hot_items(spark, sf):
    return access.hot_items(_t(spark, sf, "events", "user_id"), "user_id", 70)


@query("select user_id, count(*) as accesses, count(*) // 61 as rate from events group by 1 order by rate desc, accesses desc, user_id limit 10")
def hot_topk(spark, sf):
    return access.top_items(_t(spark, sf, "events", "user_id"), "user_id", 10, 60)


@query("""select c_custkey as user_id, last_access from customer left join (select user_id, max(ts) last_access from events group by 1) e on c_custkey = user_id
where last_access is null or last_access < timestamp '2024-01-30 00:00:00'""")
def cold_items(spark, sf):
    catalog = _t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return access.cold_items(catalog, _t(spark, sf, "events", "user_id", "ts"), "user_id", NOW, 2)


@query("""select user_id, count(*) filter (where event_type in ('view','click')) as reads, count(*) filter (where event_type in ('purchase','signup')) as writes, cast(sum(octet_length(encode(props))) as bigint) as bytes,
min(value) as min_latency, max(value) as max_latency, max(ts) as last_access from events group by 1""")
def access_stats(spark, sf):
    return access.access_stats(_t(spark, sf, "events"), "user_id", "event_type", F.octet_length("props"), "value", ["view", "click"], ["purchase", "signup"])


@query("""with h as (select 'hour' as kind, cast(hour(ts) as int) as value, count(*) n from events group by 2), d as (select 'weekday' as kind, cast(isodow(ts) - 1 as int) as value, count(*) n from events group by 2)
select * from (select * from h order by n desc, value limit 1) union all select * from (select * from d order by n desc, value limit 1)""")
def peak_hour_mode(spark, sf):
    return access.peak(_t(spark, sf, "events", "ts"))


@query("""with s as (select event_type, event_id, user_id, user_id - lag(user_id) over w d, lag(user_id) over w f from events window w as (partition by event_type order by event_id)),
x as (select *, case when abs(d) = 1 then d else 0 end dd from s), y as (select *, case when dd <> 0 and coalesce(lag(dd) over (partition by event_type order by event_id), 0) <> dd then 1 else 0 end st from x),
z as (select *, sum(st) over (partition by event_type order by event_id) run from y)
select event_type, arg_min(f, event_id) as start, count(*) + 1 as length, cast(dd as int) as direction from z where dd <> 0 group by event_type, run, dd""")
def seq_runs(spark, sf):
    return access.sequential_runs(_t(spark, sf, "events", "event_type", "event_id", "user_id"), ["event_type"], ["event_id"], "user_id")


@query("""with g as (select user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) gap from events), m as (select *, floor(avg(gap) over (partition by user_id)) mg from g),
p as (select user_id, count(*) as records, cast(max(mg) as bigint) as mean_gap, count(*) filter (where gap > 3 * mg) as long_gaps from m group by 1)
select *, records // (long_gaps + 1) as mean_burst, records >= 10 and long_gaps >= 2 and records // (long_gaps + 1) >= 5 as bursty from p""")
def burst_gaps(spark, sf):
    return access.burst_gaps(_t(spark, sf, "events", "user_id", "event_id", "ts"), "user_id", F.expr(MILLIS), ["ts", "event_id"])


@query("""with o as (select event_type, user_id, row_number() over (partition by event_type order by event_id) i from events),
p as (select a.user_id as item, b.user_id as other, count(*) as n from o a join o b on a.event_type = b.event_type and b.i between a.i + 1 and a.i + 9 where a.user_id <> b.user_id group by 1, 2)
select item, other, n, cast(rank as int) as rank from (select *, row_number() over (partition by item order by n desc, other) as rank from p) where rank <= 3""")
def coaccess_topk(spark, sf):
    return access.co_access(_t(spark, sf, "events", "event_type", "event_id", "user_id"), "user_id", ["event_id"], ["event_type"], 9, 3)


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn <= 5")
def keep_newest_n(spark, sf):
    return access.keep_last(_t(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("select event_id from events where ts >= timestamp '2024-02-01' - interval 3 days")
def retention_by_age(spark, sf):
    return access.keep_since(_t(spark, sf, "events"), "ts", NOW, 3 * 86400).select("event_id")


@query("select event_id, list_aggregate(list(event_type) over (partition by user_id order by ts, event_id rows between 3 preceding and current row), 'string_agg', '>') as recent from events")
def session_window(spark, sf):
    return access.recent_window(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", 4).select("event_id", F.array_join("recent", ">").alias("recent"))


@query("""with x as (select source, cast(regexp_extract(key, '(\\d+)$', 1) as bigint) x, doc_id from (select source, doc_id, source || '/' || lang || '/' || doc_id as key from documents)),
d as (select source, x - lag(x) over (partition by source order by doc_id) d from x)
select source, count(*) as records, round(coalesce(avg(case when d is not null then cast(abs(d) <= 5 as int) end), 0.0), 6) as share, coalesce(avg(case when d is not null then cast(abs(d) <= 5 as int) end), 0.0) > 0.5 and count(*) >= 5 as sequential from d group by 1""")
def sequential_keys(spark, sf):
    o = _objects(spark, sf).withColumnRenamed("bucket", "source")
    return access.sequential_keys(o, ["source"], ["doc_id"], "key").withColumn("share", _r("share"))


@query("""select key, regexp_extract(key, '^(.*?)(\\d+)(\\D*)$', 1) || case when length(cast(n + 1 as varchar)) < length(d) then lpad(cast(n + 1 as varchar), cast(length(d) as int), '0') else cast(n + 1 as varchar) end || regexp_extract(key, '^(.*?)(\\d+)(\\D*)$', 3) as next_key
from (select key, regexp_extract(key, '^(.*?)(\\d+)(\\D*)$', 2) as d, cast(regexp_extract(key, '^(.*?)(\\d+)(\\D*)$', 2) as bigint) as n from (select 'batch_' || lpad(cast(doc_id as varchar), 6, '0') || '.bin' as key from documents))""")
def next_batch_key(spark, sf):
    key = F.concat(F.lit("batch_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".bin"))
    return _t(spark, sf, "documents", "doc_id").select(key.alias("key")).select("key", access.increment_key(F.col("key")).alias("next_key"))


@query("""with s as (select user_id, count(*) filter (where event_type in ('view','click')) r, count(*) filter (where event_type in ('purchase','signup')) w from events group by 1)
select user_id, case when w = 1 and r > 0 then 'write_once_read_many' when coalesce(r / nullif(r + w, 0), 0.0) < 0.3 then 'write_heavy' when r > 100 then 'repeated' when user_id % 2 = 0 then 'sequential' else 'random' end as pattern from s""")
def access_patterns(spark, sf):
    s = access.access_stats(_t(spark, sf, "events"), "user_id", "event_type", F.octet_length("props"), "value", ["view", "click"], ["purchase", "signup"])
    return s.select("user_id", access.access_pattern(F.col("reads"), F.col("writes"), F.col("user_id") % 2 == 0).alias("pattern"))


# Versions ----------------------------------------------------------------------------

def _manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = _t(spark, sf, "documents", "doc_id", "text", "lang")
    old = d.where("doc_id % 10 <> 0").select("doc_id", F.md5("text").alias("checksum"))
    new = d.where("doc_id % 10 <> 1").select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("checksum"))
    return old, new


_DIFF = """with a as (select doc_id, md5(text) c from documents where doc_id % 10 <> 0), b as (select doc_id, md5(case when doc_id % 3 = 0 then text || '!' else text end) c from documents where doc_id % 10 <> 1),
d as (select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' when a.c <> b.c then 'modified' else 'same' end as change, a.c as old_checksum, b.c as new_checksum from a full join b on a.doc_id = b.doc_id)"""


@query(_DIFF + " select * from d")
def snapshot_diff(spark, sf):
    return versions.diff(*_manifests(spark, sf), "doc_id", "checksum")


@query(_DIFF + """ select count(*) filter (where change = 'added') as added, count(*) filter (where change = 'removed') as removed, count(*) filter (where change = 'modified') as modified, count(*) filter (where change = 'same') as same,
round(count(*) filter (where change = 'same') / count(*), 6) as dedup_ratio from d""")
def delta_stats(spark, sf):
    return versions.diff_summary(versions.diff(*_manifests(spark, sf), "doc_id", "checksum")).withColumn("dedup_ratio", _r("dedup_ratio"))


@query("select distinct md5(text) as checksum from documents where doc_id % 2 = 0 intersect select md5(text) from documents where doc_id % 2 = 1")
def shared_chunks(spark, sf):
    d = _t(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5("text").alias("checksum"))
    return versions.shared(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "checksum")


@query("select user_id, v.event_id as event_id, v.value as value from (select user_id, max_by({'event_id': event_id, 'value': value}, (ts, event_id)) v from events where ts <= timestamp '2024-01-15' and event_type <> 'error' group by 1)")
def latest_version_asof(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    out = versions.as_of(e, ["user_id"], ["ts", "event_id"], F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz"), F.col("event_type") == "error")
    return out.select("user_id", "event_id", "value")


@query("""select f.event_id, v.value as asof_value from (select * from events where event_type = 'purchase') f asof left join (select user_id, ts, value from events where event_type = 'signup') v on f.user_id = v.user_id and f.ts >= v.ts""")
def asof_join(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = versions.as_of_join(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'signup'").select("user_id", "ts", "value"), "user_id", "ts", "ts", "value", "event_id")
    return out.select("event_id", "asof_value")


@query("select event_id, rn = 1 as is_latest, previous from (select event_id, row_number() over w rn, lead(event_id) over w previous from events window w as (partition by user_id order by ts desc, event_id desc))")
def version_neighbours(spark, sf):
    return versions.with_neighbours(_t(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "event_id").select("event_id", "is_latest", "previous")


@query("""with recursive v as (select distinct n_nationkey as version, case when n_nationkey < 2 then null else n_nationkey // 2 end as parent from nation),
c(version, parent, depth) as (select version, parent, 0 from v where version = 24 union all select v.version, v.parent, c.depth + 1 from v join c on v.version = c.parent) select version, depth from c""")
def version_history(spark, sf):
    v = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("version"), F.expr("case when n_nationkey >= 2 then cast(n_nationkey div 2 as int) end").alias("parent"))
    return versions.history(v, "version", "parent", 24)


@query("""select o_custkey, s as shard from (select o_custkey, unnest(range(0, cast(max(t) as bigint))) s from (select o_custkey, 7 as t from orders) group by 1) w
anti join (select o_custkey, o_orderkey % 7 as shard from orders) r on w.o_custkey = r.o_custkey and w.s = r.shard""")
def shard_missing(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 7).alias("shard"), F.lit(7).alias("total"))
    return versions.missing_numbers(o, ["o_custkey"], "shard", "total")


# Fleet -------------------------------------------------------------------------------

_REPLICAS = "(select distinct l_partkey as chunk, l_suppkey as edge from lineitem)"
_EDGES = "(select s_suppkey as edge, s_acctbal * 1e6 as bps, cast(s_suppkey % 13 as int) as active, cast(s_suppkey % 5 * 4 as int) as most, s_suppkey * 1000.0 as rtt from supplier)"


def _replicas(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem", "l_partkey", "l_suppkey").select(F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("edge")).distinct()


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _t(spark, sf, "supplier", "s_suppkey", "s_acctbal").select(k.alias("edge"), (F.col("s_acctbal") * 1e6).alias("bps"), (k % 13).cast("int").alias("active"), (k % 5 * 4).cast("int").alias("most"), (k * 1000.0).alias("rtt"))


@query(f"select chunk, count(distinct edge) as replicas from {_REPLICAS} group by 1 having count(distinct edge) < 20")
def replica_under(spark, sf):
    return fleet.under_replicated(_replicas(spark, sf), "chunk", "edge", 20)


@query(f"select chunk, count(distinct edge) as replicas from {_REPLICAS} group by 1 having count(distinct edge) > 31")
def replica_over(spark, sf):
    return fleet.over_replicated(_replicas(spark, sf), "chunk", "edge", 30)


@query(f"select count(*) as unique_chunks, cast(sum(r) as bigint) as total_replicas, round(avg(r), 6) as average_replication from (select chunk, count(*) r from {_REPLICAS} group by 1)")
def availability(spark, sf):
    return fleet.availability(_replicas(spark, sf), "chunk", "edge").withColumn("average_replication", _r("average_replication"))


_COST = f"""(select r.chunk, r.edge, 0.5 * case when bps <= 0 then 1.0 else least(p_size * 1e6 * 8.0 / bps / 10.0, 1.0) end + 0.3 * least(rtt / 100000.0, 1.0) + 0.2 * case when most <= 0 then 1.0 else least(active / most, 1.0) end as cost
from {_REPLICAS} r join part on p_partkey = r.chunk join {_EDGES} e on e.edge = r.edge where active < most)"""


def _costs(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _t(spark, sf, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("chunk"), (F.col("p_size") * 1e6).alias("bytes"))
    cost = 0.5 * fleet.bandwidth_cost(F.col("bytes"), F.col("bps")) + 0.3 * fleet.rtt_cost(F.col("rtt"), 100000) + 0.2 * fleet.load_cost(F.col("active"), F.col("most"))
    return fleet.cost_matrix(chunks, _replicas(spark, sf), _edges(spark, sf), "chunk", "edge", cost, F.col("active") < F.col("most"))


@query(f"select chunk, edge, round(cost, 6) as cost from {_COST}")
def cost_matrix(spark, sf):
    return _costs(spark, sf).withColumn("cost", _r("cost"))


@query(f"select chunk, edge, cast(rank as int) as rank from (select *, row_number() over (partition by chunk order by round(cost, 9), edge) as rank from {_COST} where round(cost, 9) <= 0.8) where rank <= 3")
def topk_paths(spark, sf):
    return fleet.cheapest(_costs(spark, sf).withColumn("cost", _r("cost", 9)), "chunk", "edge", 3, 0.8).select("chunk", "edge", "rank")


@query(f"select edge, round(coalesce(active / nullif(most, 0), 0.0), 6) as load, case when coalesce(active / nullif(most, 0), 0.0) > 0.8 then 'over' when coalesce(active / nullif(most, 0), 0.0) < 0.3 then 'under' else 'normal' end as load_class from {_EDGES}")
def load_classes(spark, sf):
    return fleet.load_classes(_edges(spark, sf), "active", "most", 0.3, 0.8).select("edge", _r("load").alias("load"), "load_class")


@query("""with s as (select s_suppkey as edge, s_acctbal / 10000.0 as x from supplier)
select count(*) filter (where x >= 0.9) as saturated, count(*) filter (where x >= 0.7 and x < 0.9) as near, round(avg(x), 6) as mean, round(max(x), 6) as "max", max_by(edge, (x, -edge)) as most_saturated from s""")
def saturation_summary(spark, sf):
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("edge"), (F.col("s_acctbal") / 10000.0).alias("x"))
    return fleet.saturation_summary(s, "edge", "x", 0.9, 0.7).withColumn("mean", _r("mean")).withColumn("max", _r("max"))


@query("""with p as (select event_type, user_id % 4 as path, count(*) n from events group by 1, 2), t as (select event_type, cast(sum(n) as bigint) as connections, count(*) as paths, sum(n * n) sq, max(n) mx from p group by 1)
select event_type, connections, paths, round(paths / connections, 6) as diversity, round(case when paths <= 1 then 0.0 else greatest(0.0, 1.0 - (sq / paths - (connections / paths) ** 2) / ((connections / paths) ** 2 * paths)) end, 6) as balance, mx > 0.5 * connections as overloaded_path from t""")
def path_diversity(spark, sf):
    e = _t(spark, sf, "events", "event_type", "user_id").withColumn("path", F.col("user_id") % 4)
    return fleet.path_diversity(e, ["event_type"], "path").withColumn("diversity", _r("diversity")).withColumn("balance", _r("balance"))


@query("""with a as (select s_nationkey, max_by(s_suppkey, (-s_acctbal, -s_suppkey)) as s_suppkey from supplier where s_suppkey % 4 <> 0 group by 1) select * from a""")
def nearest_domain(spark, sf):
    return fleet.nearest(_t(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", F.col("s_suppkey") % 4 != 0)


@query("""with m as (select l_partkey as chunk, l_quantity as shard, l_linestatus = 'O' as ok from lineitem), p as (select chunk, count(distinct case when ok then shard end) as healthy from m group by 1)
select chunk, healthy, healthy >= 10 as recoverable, healthy < 14 as needs_repair from p""")
def shard_states(spark, sf):
    s = _t(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_linestatus").withColumnRenamed("l_partkey", "chunk")
    return fleet.shard_state(s, "chunk", "l_quantity", F.col("l_linestatus") == "O", 10, 4)


@query("select o_orderkey, cast((row_number() over (partition by o_orderstatus order by o_orderkey) - 1) % 4 as int) as rank from orders")
def scatter_round_robin(spark, sf):
    return fleet.round_robin(_t(spark, sf, "orders", "o_orderkey", "o_orderstatus"), ["o_orderkey"], 4, ["o_orderstatus"]).select("o_orderkey", F.col("rank").cast("int").alias("rank"))


@query("select c_custkey, cast((row_number() over (order by c_custkey) - 1) % 8 as int) as rank from customer")
def collective_read(spark, sf):
    return fleet.round_robin(_t(spark, sf, "customer", "c_custkey"), ["c_custkey"], 8)


@query("select o_orderkey, cast(floor(i / ceil(n / 4)) as int) as rank from (select o_orderkey, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 i, count(*) over (partition by o_orderstatus) n from orders)")
def scatter_block(spark, sf):
    return fleet.block_assignment(_t(spark, sf, "orders", "o_orderkey", "o_orderstatus"), ["o_orderkey"], 4, ["o_orderstatus"]).select("o_orderkey", "rank")


@query("select p_partkey, p_brand, cast(before as bigint) as freed_before from (select *, coalesce(sum(p_size) over (partition by p_brand order by p_retailprice desc, p_partkey rows between unbounded preceding and 1 preceding), 0) before from part) where before < 100")
def eviction(spark, sf):
    return fleet.evict(_t(spark, sf, "part"), "p_retailprice", "p_partkey", "p_size", 100, ["p_brand"]).select("p_partkey", "p_brand", "freed_before")


@query("select s_nationkey, count(*) as members, count(*) filter (where s_acctbal > 2000) as reachable, count(*) // 2 + 1 as quorum, count(*) filter (where s_acctbal > 2000) >= count(*) // 2 + 1 as has_quorum from supplier group by 1")
def quorum_status(spark, sf):
    return fleet.quorum(_t(spark, sf, "supplier"), ["s_nationkey"], F.col("s_acctbal") > 2000)


@query("select doc_id, cast(coalesce(sum(size) over (partition by bucket order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from " + _OBJECTS)
def chunk_offsets(spark, sf):
    return fleet.chunk_offsets(_objects(spark, sf), ["bucket"], "doc_id", "size").select("doc_id", "offset")


@query("""select f.f as file, c.doc_id as "index" from (select n_nationkey as f, n_nationkey * 7 as a, n_nationkey * 7 + n_nationkey % 5 as b from nation) f join documents c on c.doc_id >= a and c.doc_id < b""")
def file_chunk_range_join(spark, sf):
    files = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("file"), (F.col("n_nationkey") * 7).cast("long").alias("a"), (F.col("n_nationkey") * 7 + F.col("n_nationkey") % 5).cast("long").alias("b"))
    return fleet.file_chunks(files, _t(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "index"), "a", "b", "index").select("file", "index")


# Rules -------------------------------------------------------------------------------

LIFECYCLE = (
    rules.LifecycleRule("low", prefix="5-", expire_days=8000),
    rules.LifecycleRule("urgent", prefix="1-", expire_days=9500, transition_days=8500, transition_class="GLACIER"),
    rules.LifecycleRule("all", transition_days=9000, transition_class="IA"),
)


@query("""with a as (select o_orderkey, o_orderpriority k, case when o_orderstatus = 'F' then 'GLACIER' else 'STANDARD' end c, greatest(0, cast(floor((epoch(timestamp '2024-02-01') - epoch(o_orderdate)) / 86400) as bigint)) age from orders)
select o_orderkey, age, case when starts_with(k, '5-') and age >= 8000 then 'low:expire' when starts_with(k, '1-') and age >= 9500 then 'urgent:expire' when starts_with(k, '1-') and age >= 8500 and c <> 'GLACIER' then 'urgent:GLACIER' when age >= 9000 and c <> 'IA' then 'all:IA' end as action from a""")
def lifecycle_actions(spark, sf):
    o = _t(spark, sf, "orders").withColumn("age", rules.age_days(F.col("o_orderdate"), NOW))
    storage = F.when(F.col("o_orderstatus") == "F", "GLACIER").otherwise("STANDARD")
    return o.select("o_orderkey", "age", rules.lifecycle_action(LIFECYCLE, key=F.col("o_orderpriority"), age=F.col("age"), storage_class=storage, now=NOW).alias("action"))


@query("""with s as (select user_id, count(*) n, cast(floor((epoch(timestamp '2024-02-01') - epoch(max(ts))) / 86400) as bigint) idle from events group by 1), t as (select *, n / 50.0 as rate, case when user_id % 3 = 0 then 'IA' else 'STANDARD' end cur from s),
u as (select *, case when rate >= 1.0 then 'STANDARD' when idle >= 30 then 'ARCHIVE' when idle >= 7 then 'IA' end target from t)
select user_id, case when user_id % 11 = 0 or target = cur then null else target end as decision from u""")
def tier_decisions(spark, sf):
    s = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    d = rules.tier_decision(
        idle_days=rules.age_days(F.col("last"), NOW), rate_per_day=F.col("n") / 50.0, current=F.when(F.col("user_id") % 3 == 0, "IA").otherwise("STANDARD"),
        protected=F.col("user_id") % 11 == 0, active=F.lit(False),
    )
    return s.select("user_id", d.alias("decision"))


@query("""with u as (select o_custkey as scope, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) used from orders group by 1) select scope, round(100.0 * used / 4000000, 6) as percent, t as threshold from u, (values (50.0::double),(80.0),(100.0)) v(t) where 100.0 * used / 4000000 >= t""")
def quota_alerts(spark, sf):
    u = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("scope")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("used")).withColumn("limit", F.lit(4000000))
    return rules.quota_alerts(u, "scope", "used", "limit", [50, 80, 100]).withColumn("percent", _r("percent"))


@query("""select c_custkey, case when c_acctbal + 500 > 9000 then case when c_mktsegment = 'MACHINERY' then 'grace' else 'denied' end when c_acctbal + 500 > 8000 then 'soft' when 100.0 * (c_acctbal + 500) / 9000 >= 80 then 'warn80' when 100.0 * (c_acctbal + 500) / 9000 >= 50 then 'warn50' else 'ok' end as verdict from customer""")
def quota_verdicts(spark, sf):
    v = rules.quota_verdict(F.col("c_acctbal"), F.lit(500.0), F.lit(9000.0), F.lit(8000.0), F.col("c_mktsegment") == "MACHINERY", thresholds=(80.0, 50.0))
    return _t(spark, sf, "customer").select("c_custkey", v.alias("verdict"))


STATEMENTS = (
    rules.Statement("Allow", actions=("view", "cl*"), resources=("users/*",)),
    rules.Statement("Allow", actions=("purchase",), resources=("users/1*",), conditions={"NumericLessThan": {"value": "100"}}),
    rules.Statement("Deny", actions=("*",), resources=("users/?3",)),
    rules.Statement("Deny", not_actions=("view", "click", "purchase", "error"), resources=("users/7*",)),
)


@query("""select event_id, case when regexp_full_match(r, 'users/.3') or (not event_type in ('view','click','purchase','error') and starts_with(r, 'users/7')) then 'Deny' when event_type = 'view' or starts_with(event_type, 'cl') or (event_type = 'purchase' and starts_with(r, 'users/1') and value < 100) then 'Allow' else 'NotApplicable' end as decision
from (select *, 'users/' || user_id as r from events)""")
def policy_decision(spark, sf):
    d = rules.policy_decision(STATEMENTS, principal=F.lit("*"), action=F.col("event_type"), resource=F.concat(F.lit("users/"), F.col("user_id")), context={"value": F.col("value").cast("string")})
    return _t(spark, sf, "events").select("event_id", d.alias("decision"))


NOTIFICATIONS = (rules.Notification("audit", ("*",), "users/1"), rules.Notification("errors", ("error",)), rules.Notification("sales", ("purchase", "sign*"), suffix="5"))


@query("""with e as (select event_id, event_type t, 'users/' || user_id as k from events) select event_id, 'audit' as destination from e where starts_with(k, 'users/1') union all select event_id, 'errors' from e where t = 'error'
union all select event_id, 'sales' from e where (t = 'purchase' or starts_with(t, 'sign')) and suffix(k, '5')""")
def event_routing(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "event_type", F.concat(F.lit("users/"), F.col("user_id")).alias("key"))
    return rules.route_events(e, NOTIFICATIONS, "event_type", "key").select("event_id", "destination")


@query("select o_orderkey, case when o_orderpriority = '1-URGENT' then 'abort' when o_orderstatus = 'F' and o_custkey % 2 = 0 and o_custkey % 3 <> 0 then 'retry' when o_custkey % 5 <> 0 then 'reroute' else 'abort' end as action from orders")
def failover_decisions(spark, sf):
    k = F.col("o_custkey")
    retries, reason = F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(0), F.when(F.col("o_orderstatus") == "F", "timeout").otherwise("offline")
    return _t(spark, sf, "orders").select("o_orderkey", rules.failover(retries, 3, reason, k % 2 == 0, k % 3 == 0, F.when(k % 5 != 0, k)).alias("action"))


# Deduplication -----------------------------------------------------------------------


@query("select doc_id, min(doc_id) over (partition by sha256(text)) as first_key from documents")
def dedup_exact(spark, sf):
    d = _t(spark, sf, "documents", "doc_id", "text").select("doc_id", dedup.content_hash(F.col("text")).alias("h"))
    return dedup.duplicates(d, "doc_id", "h").select("doc_id", "first_key")


_BLOCKS = "(select doc_id, i as block, substr(text, cast(i * 256 + 1 as bigint), 256) as content from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 256) as bigint))) i from documents))"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.fixed_blocks(_t(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", 256).withColumn("hash", dedup.content_hash(F.col("content")))


@query(f"select sha256(content) as hash, cast(max(octet_length(encode(content))) as bigint) as size, count(*) as refs from {_BLOCKS} group by 1")
def dedup_fixed_blocks(spark, sf):
    return dedup.registry(_blocks(spark, sf), "hash", F.octet_length("content").cast("long")).select("hash", "size", "refs")


@query(f"""with r as (select sha256(content) h, max(octet_length(encode(content))) s, count(*) n from {_BLOCKS} group by 1)
select count(*) as chunks, cast(sum(s) as bigint) as bytes, cast(sum(n) as bigint) as refs, count(*) filter (where n = 0) as unreferenced, round(sum(n) / count(*), 6) as avg_refs, 1.0::double as compression_ratio from r""")
def registry_stats(spark, sf):
    return dedup.registry_stats(dedup.registry(_blocks(spark, sf), "hash", F.octet_length("content").cast("long"))).withColumn("avg_refs", _r("avg_refs"))


@query(f"""with r as (select sha256(content) h, count(*) n, sum(octet_length(encode(content))) b, max(octet_length(encode(content))) f from {_BLOCKS} group by 1)
select count(*) as new_chunks, cast(sum(n - 1) as bigint) as duplicate_chunks, cast(sum(f) as bigint) as new_bytes, cast(sum(b - f) as bigint) as duplicate_bytes, round(sum(b - f) / sum(b), 6) as dedup_ratio from r""")
def registration_stats(spark, sf):
    return dedup.registration(_blocks(spark, sf), "hash", ["doc_id", "block"], F.octet_length("content").cast("long")).withColumn("dedup_ratio", _r("dedup_ratio"))


@query(f"select distinct sha256(content) as hash from {_BLOCKS} where doc_id % 4 = 0 except select sha256(content) from {_BLOCKS} where doc_id % 4 <> 0")
def gc_candidates(spark, sf):
    return dedup.unregister(_blocks(spark, sf), "doc_id", F.col("doc_id") % 4 == 0, "hash")


@query("select doc_id, sha256(text) as hash from documents where length(text) > 0")
def reassembled(spark, sf):
    return dedup.reassemble(_blocks(spark, sf), "doc_id", "block", "content").select("doc_id", "hash")


# Replicated data -----------------------------------------------------------------------


@query("select event_type as key, cast(sum(m) as bigint) as value from (select event_type, user_id % 5 node, max(event_id) m from events group by 1, 2) group by 1")
def gcounter_merge(spark, sf):
    s = _t(spark, sf, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 5).alias("node"), F.col("event_id").alias("n"))
    return crdt.gcounter_value(s, "key", "node", "n")


@query("""with m as (select event_type key, user_id % 5 node, max(event_id) u, max(event_id // 3) d from events group by 1, 2) select key, cast(sum(u) - sum(d) as bigint) as value, round(sum(u) / (sum(u) + sum(d)), 6) as ratio from m group by 1""")
def pncounter_value(spark, sf):
    s = _t(spark, sf, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 5).alias("node"), F.col("event_id").alias("up"), F.expr("event_id div 3").alias("down"))
    return crdt.pncounter_value(s, "key", "node", "up", "down").withColumn("ratio", _r("ratio"))


@query("select user_id as key, max_by(event_type, (epoch_ms(ts) // 3600000, event_id % 3, event_id)) as value from events group by 1")
def lww_merge(spark, sf):
    w = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.expr(f"{MILLIS} div 3600000").alias("physical"), (F.col("event_id") % 3).alias("logical"), F.col("event_id").alias("node"))
    return crdt.lww_merge(w, "key", "value")


@query("""with a as (select user_id % 20 as key, event_type as element, user_id % 5 as node, event_id % 50 as dot from events), d as (select distinct * from a), r as (select distinct key, element, node, dot from a where dot % 2 = 0)
select key, element, count(*) as dots from (select * from d except select * from r) group by 1, 2""")
def orset_merge(spark, sf):
    a = _t(spark, sf, "events").select((F.col("user_id") % 20).alias("key"), F.col("event_type").alias("element"), (F.col("user_id") % 5).alias("node"), (F.col("event_id") % 50).alias("dot"))
    return crdt.orset_merge(a, a.where("dot % 2 = 0"), "key", "element", "node", "dot")


@query("""with w as (select user_id % 20 as key, user_id % 3 as node, epoch_ms(ts) // 86400000 as p, 0 as l, event_id as v from events), n as (select key, node, max((p, l, v)) w from w group by 1, 2), t as (select key, max((w[1], w[2])) t from n group by 1)
select n.key, n.node, n.w[3] as value from n join t on n.key = t.key where (n.w[1], n.w[2]) = t.t""")
def mv_register(spark, sf):
    w = _t(spark, sf, "events").select((F.col("user_id") % 20).alias("key"), (F.col("user_id") % 3).alias("node"), F.expr(f"{MILLIS} div 86400000").alias("p"), F.lit(0).alias("l"), F.col("event_id").alias("value"))
    return crdt.mv_merge(w, "key", "value", "node", "p", "l")


# Folds ---------------------------------------------------------------------------------


@query("""with recursive o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) i from events), f(user_id, i, a) as (select user_id, i, value from o where i = 1 union all select o.user_id, o.i, 0.2 * o.value + (1 - 0.2) * f.a from o join f on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, round(max_by(a, i), 6) as value from f group by 1""")
def ema_by_key(spark, sf):
    return folds.ema(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 0.2).withColumn("value", _r("value"))


@query("""with recursive o as (select user_id, cast(floor(value * 1000) as bigint) x, row_number() over (partition by user_id order by ts, event_id) i from events),
f(user_id, i, s, v) as (select user_id, i, x, x // 2 from o where i = 1 union all select o.user_id, o.i, (7 * f.s + o.x) // 8, (3 * f.v + abs(f.s - o.x)) // 4 from o join f on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, max_by(s, i) as srtt, max_by(v, i) as rttvar, max_by(s, i) + 4 * max_by(v, i) as rto from f group by 1""")
def rtt_rfc6298(spark, sf):
    e = _t(spark, sf, "events").withColumn("us", F.floor(F.col("value") * 1000).cast("long"))
    return folds.smoothed_rtt(e, ["user_id"], ["ts", "event_id"], "us")


@query("""with recursive o as (select user_id, cast(floor(value) as bigint) x, row_number() over (partition by user_id order by ts, event_id) i from events), f(user_id, i, m) as (select user_id, i, x from o where i = 1 union all select o.user_id, o.i, (f.m * (o.i - 1) + o.x) // o.i from o join f on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, max_by(m, i) as value from f group by 1""")
def truncating_mean(spark, sf):
    e = _t(spark, sf, "events").withColumn("us", F.floor("value").cast("long"))
    return folds.truncating_mean(e, ["user_id"], ["ts", "event_id"], "us")


@query("""with c as (select user_id, event_id, ts, case when value < 30 then 'degraded' when value >= 60 then 'healthy' end x from events), s as (select *, coalesce(last_value(x ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), 'healthy') state from c),
b as (select *, coalesce(lag(state) over (partition by user_id order by ts, event_id), 'healthy') before from s) select event_id, before, state from b where state <> before""")
def health_triggers(spark, sf):
    return folds.hysteresis(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", LOW, HIGH).select("event_id", "before", "state")


@query("select event_id, cast(least(cast(floor(value) as bigint), greatest(1000 - coalesce(before, 0), 0)) as bigint) as granted from (select event_id, value, sum(cast(floor(value) as bigint)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) before from events)")
def bounded_counter(spark, sf):
    e = _t(spark, sf, "events").withColumn("n", F.floor("value").cast("long"))
    return folds.bounded_counter(e, ["user_id"], ["event_id"], "n", 1000).select("event_id", "granted")


# Content --------------------------------------------------------------------------------


@query("""with c as (select doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) b, octet_length(encode(text)) n from documents where length(text) > 0), p as (select doc_id, b, count(*) / max(n) p from c group by 1, 2),
e as (select d.doc_id, round(coalesce(e, 0.0), 6) as entropy from documents d left join (select doc_id, greatest(0.0, -sum(p * log2(p)) / 8.0) e from p group by 1) x on d.doc_id = x.doc_id)
select doc_id, entropy, case when entropy > 0.95 then 'none' when entropy > 0.7 then 'fast' when entropy > 0.3 then 'balanced' else 'maximum' end as strategy from e""")
def entropy_by_doc(spark, sf):
    e = _r(content.entropy_of(F.col("text")))
    return _t(spark, sf, "documents", "doc_id", "text").select("doc_id", e.alias("entropy")).withColumn("strategy", content.compression_strategy(F.col("entropy")))


@query()
def cdc_chunks(spark, sf):
    return content.chunk_objects(_t(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", 1024)


@query("""with l as (select n_regionkey k, list(sha256(n_name) order by n_nationkey) x from nation group by 1) select k as region, sha256(unhex(sha256(unhex(sha256(unhex(x[1]) || unhex(x[2]))) || unhex(sha256(unhex(x[3]) || unhex(x[4]))))) || unhex(sha256(unhex(sha256(unhex(x[5]) || unhex(x[5]))) || unhex(sha256(unhex(x[5]) || unhex(x[5])))))) as root from l""")
def merkle_root(spark, sf):
    n = _t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.unhex(F.sha2(F.col("n_name").cast("binary"), 256)).alias("h")))).alias("x"))
    return n.select("region", F.lower(F.hex(content.merkle_root(F.transform("x", lambda e: e["h"])))).alias("root"))


@query("select doc_id, i as shard, i * 1000 as \"offset\", least(1000, size - i * 1000) as size from (select doc_id, size, unnest(range(0, cast(ceil(size / 1000) as bigint))) i from " + _OBJECTS + ")")
def tensor_shards(spark, sf):
    return content.shard_ranges(_objects(spark, sf), "doc_id", "size", 1000, 1000)


@query("""with t as (select doc_id, octet_length(encode(text)) as n, regexp_extract_all(hex(encode(text)[1:4096]), '..') as h from documents), c as (select doc_id, n, len(h) m, list_sum(list_transform(h, lambda x: case when x < '80' then 1 else 0 end)) a, list_sum(list_transform(h, lambda x: case when (x >= '20' and x <= '7E') or x in ('09', '0A', '0D') then 1 else 0 end)) p from t)
select doc_id, case when n < 256 then 'unknown' when p / m > 0.9 and a / m > 0.85 then 'text/plain' else 'application/octet-stream' end as content_type from c""")
def text_classes(spark, sf):
    return _t(spark, sf, "documents", "doc_id", "text").select("doc_id", content.content_type(F.col("text")).alias("content_type"))
