"""Registered queries: versions, chunk trees, deduplication, replicated data and tensors, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeglass.functions import content
from lakeglass.operators import crdt, dedup, trees, versions
from lakeglass.plans.queries import _BLOCKS, _OBJECTS, _blocks, _objects, _r, _t, query

# Versions ---------------------------------------------------------------------------


@query("""select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders where o_orderstatus <> 'P') where rn > 3""")
def prune_snapshots(spark, sf):
    o = _t(spark, sf, "orders")
    return versions.prune(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, F.col("o_orderstatus") == "P").select("o_orderkey")


@query("""select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn > 2 and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'N')""")
def prune_unreferenced(spark, sf):
    gone = versions.prune(_t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_orderkey")
    used = _t(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return versions.only_in(gone, used, "o_orderkey")


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders where o_orderstatus = 'O' group by 1")
def latest_snapshots(spark, sf):
    return versions.latest_snapshot(_t(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "O")


@query("select o_orderkey, o_orderdate from orders where o_custkey = (select min(o_custkey) from orders) order by o_orderdate, o_orderkey")
def bucket_snapshots(spark, sf):
    o = _t(spark, sf, "orders")
    return o.join(o.agg(F.min("o_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("""with a as (select c_custkey k, c_acctbal c from customer where c_custkey % 3 > 0), b as (select c_custkey k, case when c_custkey % 5 = 0 then c_acctbal + 1 else c_acctbal end c from customer where c_custkey % 4 > 0)
select coalesce(a.k, b.k) as k, case when a.k is null then 'removed' when b.k is null then 'added' when a.c is distinct from b.c then 'modified' else 'same' end as change, b.c as old_c, a.c as new_c from a full join b on a.k = b.k""")
def inverted_delta(spark, sf):
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    old = c.where(k % 3 > 0).select(k.alias("k"), F.col("c_acctbal").alias("c"))
    new = c.where(k % 4 > 0).select(k.alias("k"), F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c"))
    return versions.invert(versions.diff(old, new, "k", "c"))


@query("""with a as (select c_custkey k, c_acctbal c, c_nationkey p from customer), b as (select c_custkey k, case when c_custkey % 5 = 0 then c_acctbal + 1 else c_acctbal end c, case when c_custkey % 7 = 0 then c_nationkey + 1 else c_nationkey end p from customer)
select a.k as k, case when a.c <> b.c then 'modified' when a.p <> b.p then 'moved' else 'same' end as change from a join b on a.k = b.k""")
def moved_entries(spark, sf):
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    old = c.select(k.alias("k"), F.col("c_acctbal").alias("c"), F.col("c_nationkey").alias("p"))
    new = c.select(k.alias("k"), F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c"), F.when(k % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("p"))
    return versions.diff(old, new, "k", "c", "p").select("k", "change")


@query("select distinct l_partkey from lineitem where l_suppkey = 7")
def required_chunks(spark, sf):
    return versions.required(_t(spark, sf, "lineitem", "l_suppkey", "l_partkey"), "l_suppkey", 7, "l_partkey")


@query("""select l_partkey as chunk, l_suppkey as edge from lineitem where l_returnflag = 'N' union select l_partkey, l_suppkey + 1000 from lineitem where l_returnflag = 'A' except select l_partkey, l_suppkey from lineitem where l_returnflag = 'R'""")
def location_batches(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_returnflag", F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("edge"))
    of = lambda flag: li.where(F.col("l_returnflag") == flag)
    return versions.apply_locations(of("N"), of("A").withColumn("edge", F.col("edge") + 1000), of("R"), ["chunk", "edge"])


@query("select l_partkey, array_to_string(list_sort(list(distinct n_regionkey)), ',') as members from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1")
def object_domains(spark, sf):
    s = _t(spark, sf, "supplier").join(F.broadcast(_t(spark, sf, "nation", "n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    li = _t(spark, sf, "lineitem", "l_partkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return versions.members(li, "l_partkey", "n_regionkey").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("select p_partkey from part where list_contains(string_split(p_type, ' '), (select max(string_split(p_type, ' ')[1]) from part))")
def models_by_tag(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.split("p_type", " ").alias("tags"))
    return versions.with_tag(p, "tags", p.agg(F.max(F.col("tags")[0])).first()[0]).select("p_partkey")


@query("""with l as (select 1::bigint as version, null::bigint as parent, 0::bigint as n_chunks), m as (select count(distinct p_partkey) n from part) select version, parent, n_chunks from l union all select 2, 1, n from m""")
def version_commit(spark, sf):
    log = spark.createDataFrame([(1, None, 0, "", "first")], "version bigint, parent bigint, n_chunks bigint, root string, message string")
    return versions.commit(log, _t(spark, sf, "part", "p_partkey"), "p_partkey", "second").select("version", "parent", "n_chunks")


# Deduplication ------------------------------------------------------------------------


@query(f"select doc_id, block from (select doc_id, block, sha256(content) h from {_BLOCKS}) where h in (select sha256(content) from {_BLOCKS} where doc_id % 2 = 0)")
def known_chunks(spark, sf):
    b = _blocks(spark, sf)
    return dedup.known(b, b.where("doc_id % 2 = 0").select("hash").distinct(), "hash").select("doc_id", "block")


@query(f"select distinct sha256(content) as hash from {_BLOCKS} except select sha256(content) from {_BLOCKS} where doc_id % 3 = 0")
def unreferenced_chunks(spark, sf):
    b = _blocks(spark, sf)
    return dedup.unreferenced(b.select("hash").distinct(), b.where("doc_id % 3 = 0"), "hash")


@query(f"""with r as (select sha256(content) h, count(*) n, max(octet_length(encode(content))) s from {_BLOCKS} group by 1) select round(sum(s) / (sum(s) + sum((n - 1) * s)), 6) as ratio from r""")
def store_ratio(spark, sf):
    reg = dedup.registry(_blocks(spark, sf), "hash", F.octet_length("content").cast("long"))
    t = reg.agg(F.sum("size").alias("stored"), F.sum((F.col("refs") - 1) * F.col("size")).alias("saved"))
    return t.select(_r(dedup.store_ratio(F.col("stored"), F.col("saved"))).alias("ratio"))


@query(f"""with b as (select doc_id, block, sha256(content) h, octet_length(encode(content)) n from {_BLOCKS}) select doc_id, block, case when n <= 64 then 'inline' when row_number() over (partition by h, n <= 64 order by doc_id, block) = 1 then 'new' else 'shared' end as stored from b""")
def block_allocation(spark, sf):
    return dedup.allocate(_blocks(spark, sf), "hash", "content", ["doc_id", "block"], 64).select("doc_id", "block", "stored")


_HMAC = "sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode({x}))))"


def _hmac(x: str, key: str = "a shared secret") -> str:
    padded = key.encode().ljust(64, b"\0")
    return _HMAC.format(o=bytes(b ^ 0x5C for b in padded).hex(), i=bytes(b ^ 0x36 for b in padded).hex(), x=x)


@query(f"select c_custkey, {_hmac('c_name')} as token from customer")
def keyed_hashes(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", dedup.keyed_hash("a shared secret", F.col("c_name")).alias("token"))


@query("select a.c_custkey as c_custkey, b.c_custkey as reference from customer a left join (select min(c_custkey) as c_custkey, c_mktsegment as m from customer where c_mktsegment <> 'BUILDING' group by 2) b on a.c_mktsegment = b.m")
def blind_lookup(spark, sf):
    c = _t(spark, sf, "customer").withColumn("token", dedup.keyed_hash("k", F.col("c_mktsegment")))
    index = c.where("c_mktsegment <> 'BUILDING'").groupBy("token").agg(F.min("c_custkey").alias("reference"))
    return dedup.blind_lookup(c.select("c_custkey", "token"), index, "token").select("c_custkey", "reference")


_WEIGHT = "cast(('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) as ubigint)"


@query(f"""with w as (select p_partkey, {_WEIGHT} as w from (select p_partkey, sha256(p_name) h from part)) select p_partkey, cast(w as varchar) as weight, case when w = 0 then 64 else length(bin(w)) - length(rtrim(bin(w), '0')) end as zeros from w""")
def chunk_weights(spark, sf):
    h = dedup.content_hash(F.col("p_name"))
    return _t(spark, sf, "part").select("p_partkey", content.weight(h).cast("string").alias("weight"), content.trailing_zeros(h).cast("bigint").alias("zeros"))


# Trees --------------------------------------------------------------------------------


_CHUNKS = "(select doc_id, i * 700 as \"offset\", least(700, size - i * 700) as size from (select doc_id, size, unnest(range(0, cast(ceil(size / 700) as bigint))) i from " + _OBJECTS + "))"


def _chunks(spark, sf):
    return content.shard_ranges(_objects(spark, sf), "doc_id", "size", 700, 1_000_000).select("doc_id", "offset", "size")


@query(f"""select l.doc_id as doc_id, l.at as "at", c."offset" as "offset" from (select doc_id, unnest([0, size // 2, size - 1, size]) as at from {_OBJECTS}) l join {_CHUNKS} c on l.doc_id = c.doc_id and l.at >= c."offset" and l.at < c."offset" + c.size""")
def leaf_lookup(spark, sf):
    at = _objects(spark, sf).select("doc_id", F.explode(F.expr("array(0L, size div 2, size - 1, size)")).alias("at"))
    return trees.leaf_at(_chunks(spark, sf), at, "doc_id", "offset", "size", "at").select("doc_id", "at", "offset")


@query(f"""select distinct e.doc_id as doc_id, c."offset" as "offset" from (select doc_id, size // 3 as b, size // 3 + doc_id % 1500 as e from {_OBJECTS}) e join {_CHUNKS} c on e.doc_id = c.doc_id and e.b < c."offset" + c.size and greatest(e.e, e.b + 1) > c."offset" """)
def affected_chunks(spark, sf):
    edits = _objects(spark, sf).select("doc_id", F.expr("size div 3").alias("b"), F.expr("size div 3 + doc_id % 1500").alias("e"))
    return trees.affected(_chunks(spark, sf), edits, "doc_id", "offset", "size", "b", "e").select("doc_id", "offset").distinct()


@query(f"""with a as (select distinct sha256(content) h from {_BLOCKS} where doc_id % 3 > 0), b as (select distinct sha256(content) h from {_BLOCKS} where doc_id % 3 < 2) select coalesce(a.h, b.h) as hash, case when a.h is null then 'added' when b.h is null then 'removed' else 'shared' end as change from a full join b on a.h = b.h""")
def tree_diff(spark, sf):
    b = _blocks(spark, sf)
    return trees.tree_diff(b.where("doc_id % 3 > 0"), b.where("doc_id % 3 < 2"), "hash")


_BLOCK_WEIGHTS = "(select doc_id, block, n, " + _WEIGHT + " as w from (select doc_id, block, octet_length(encode(content)) * (block % 3 + 1) as n, sha256(content) h from " + _BLOCKS + "))"


def _weighted(spark, sf):
    b = _blocks(spark, sf)
    return b.select("doc_id", "block", (F.octet_length("content") * (F.col("block") % 3 + 1)).cast("bigint").alias("n"), content.weight(F.col("hash")).alias("w"))


@query(f"""select doc_id, block from (select *, lag(w) over o b, lead(w) over o a from {_BLOCK_WEIGHTS} window o as (partition by doc_id order by block)) where n < 400 and a is not null and (b is null or w < b) and w < a""")
def light_chunks(spark, sf):
    return trees.light_chunks(_weighted(spark, sf), ["doc_id"], "block", "n", "w", 400).select("doc_id", "block")


@query(f"""with k as (select *, coalesce(n < 400 and a is not null and (b is null or w < b) and w < a, false) light from (select *, lag(w) over o b, lead(w) over o a from {_BLOCK_WEIGHTS} window o as (partition by doc_id order by block))),
j as (select *, lag(light) over (partition by doc_id order by block) took, lag(n) over (partition by doc_id order by block) more from k) select doc_id, block, cast(n + case when took then more else 0 end as bigint) as n from j where not light""")
def merged_chunks(spark, sf):
    return trees.merge_light(_weighted(spark, sf), ["doc_id"], "block", "n", "w", 400).select("doc_id", "block", F.col("n").cast("bigint").alias("n"))


@query(f"""select doc_id, "offset" + i * 300 as "offset", least(300, size - i * 300) as size from (select *, unnest(range(0, cast(ceil(size / 300) as bigint))) i from {_CHUNKS})""")
def split_chunks(spark, sf):
    return trees.split_oversized(_chunks(spark, sf), ["doc_id"], "offset", "size", 300)


@query("""with b as (select n_nationkey, n_name x, n_name || 'z' as y from nation) select n_nationkey, cast((select sum(bit_count(cast(xor(ascii(substr(x, length(x) - i, 1)), ascii(substr(y, i + 1, 1))) as int))) from range(0, least(8, length(x))) r(i)) + cast(('0x' || substr(sha256(x), 15, 2)) as int) as bigint) as priority from b""")
def boundary_priorities(spark, sf):
    before, after = F.col("n_name"), F.concat("n_name", F.lit("z"))
    p = trees.boundary_priority(before.cast("binary"), after.cast("binary"), dedup.content_hash(before))
    return _t(spark, sf, "nation").select("n_nationkey", p.cast("bigint").alias("priority"))


@query(f"""select doc_id, block, row_number() over (partition by doc_id order by w, block) as rank from (select *, lead(n) over (partition by doc_id order by block) nx from {_BLOCK_WEIGHTS}) where nx is not null and (n < 300 or nx < 300)""")
def weak_boundaries(spark, sf):
    return trees.weak_boundaries(_weighted(spark, sf), ["doc_id"], "block", "n", "w", 300).select("doc_id", "block", F.col("rank").cast("bigint").alias("rank"))


@query("select count(*) as checked, count(*) as valid from nation")
def merkle_proofs(spark, sf):
    # Every nation's name is proven to be in a tree over its region's names, and the proofs are checked.
    leaf = F.unhex(F.sha2(F.col("n_name").cast("binary"), 256))
    regions = _t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", leaf.alias("h")))).alias("x"))
    regions = regions.withColumn("leaves", F.transform("x", lambda e: e["h"])).withColumn("root", content.merkle_root(F.col("leaves")))
    each = regions.select("root", "leaves", F.posexplode("leaves").alias("i", "leaf")).withColumn("proof", content.merkle_proof_of(F.col("leaves"), F.col("i")))
    ok = content.merkle_verify(F.col("leaf"), F.col("proof"), F.col("root"), F.col("i"))
    return each.agg(F.count("*").alias("checked"), F.count_if(ok).alias("valid"))


@query("select 12 as checked, 12 as valid")
def merkle_sample(spark, sf):
    leaf = F.unhex(F.sha2(F.col("n_name").cast("binary"), 256))
    tree = _t(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", leaf.alias("h")))).alias("x")).select(F.transform("x", lambda e: e["h"]).alias("leaves"))
    return content.merkle_sample(tree, "leaves", 12, 5).select(F.col("checked").cast("int").alias("checked"), F.col("valid").cast("int").alias("valid"))


# Replicated data -----------------------------------------------------------------------


@query("""with w as (select user_id % 20 as key, user_id % 3 as node, epoch_ms(ts) // 86400000 as p, event_id as v from events), n as (select key, node, max((p, v)) w from w group by 1, 2) select key, arg_max(w[2], (w[1], node)) as value from n group by 1""")
def mv_resolved(spark, sf):
    w = _t(spark, sf, "events").select((F.col("user_id") % 20).alias("key"), (F.col("user_id") % 3).alias("node"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 86400000").alias("physical"), F.lit(0).alias("logical"), F.col("event_id").alias("value"))
    merged = crdt.mv_merge(w, "key", "value", "node", "physical", "logical")
    stamps = w.groupBy("key", "node", "value").agg(F.max("physical").alias("physical"), F.max("logical").alias("logical"))
    return crdt.lww_merge(merged.join(stamps, ["key", "node", "value"]), "key", "value")


@query("select user_id % 20 as key, max(event_id) as value from events where event_id > 500 group by 1")
def crdt_delta(spark, sf):
    w = _t(spark, sf, "events").select((F.col("user_id") % 20).alias("key"), F.col("event_id").alias("physical"), F.lit(0).alias("logical"), F.lit(0).alias("node"), F.col("event_id").alias("value"))
    return crdt.lww_merge(crdt.delta(w, (500, 0)), "key", "value")


@query("select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey where a.s_suppkey % 2 = b.s_suppkey % 2")
def concurrent_stamps(spark, sf):
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.struct(F.col("s_nationkey").alias("physical"), (F.col("s_suppkey") % 2).alias("logical"), F.col("s_suppkey").alias("node")).alias("stamp"))
    a, b = (s.select(F.col("s_suppkey").alias(n), "s_nationkey", F.col("stamp").alias(f"{n}s")) for n in ("a", "b"))
    return a.join(b, "s_nationkey").where((F.col("a") < F.col("b")) & crdt.concurrent(F.col("as"), F.col("bs"))).select("a", "b")


@query("select cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as conflicts, count(*) as merged from events")
def merge_stats(spark, sf):
    parts = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("merged"), F.count_if(F.col("event_type") == "error").alias("conflicts"))
    return crdt.merge_statistics(parts.select("merged", "conflicts"))


_ADDS = "(select user_id % 20 as key, event_type as element, user_id % 5 as node, event_id % 50 as dot, event_id as value from events)"


def _adds(spark, sf):
    return _t(spark, sf, "events").select((F.col("user_id") % 20).alias("key"), F.col("event_type").alias("element"), (F.col("user_id") % 5).alias("node"), (F.col("event_id") % 50).alias("dot"), F.col("event_id").alias("physical"), F.lit(0).alias("logical"), F.col("event_id").alias("value"))


@query(f"""with k as (select distinct key, element, node, dot from {_ADDS} where dot % 4 > 0), a as (select distinct key, element from {_ADDS}) select a.key as key, a.element as element, count(k.dot) > 0 as present from a left join k on a.key = k.key and a.element = k.element group by 1, 2""")
def orset_membership(spark, sf):
    a = _adds(spark, sf)
    merged = crdt.orset_merge(a, a.where("dot % 4 = 0"), "key", "element", "node", "dot")
    return crdt.orset_contains(merged, a.select("key", "element").distinct(), "key", "element")


@query(f"""select key, element, max(value) as value from {_ADDS} group by 1, 2 having count(*) filter (where dot % 4 > 0) > 0""")
def ormap_entries(spark, sf):
    a = _adds(spark, sf)
    return crdt.ormap_merge(a, a.where("dot % 4 = 0"), "key", "element", "node", "dot", "value")


# Content --------------------------------------------------------------------------------


@query("""select p_partkey, case p_partkey % 4 when 0 then 8 when 1 then 4 when 2 then 2 end as bytes, cast(ceil(p_size / 8.0) as bigint) as chunks, cast(ceil(ceil(p_size * 100 / 6.0) / 2) * 2 as bigint) as shard, 10 / 6.0 as overhead from part""")
def sizes(spark, sf):
    k = F.col("p_partkey") % 4
    dtype = F.when(k == 0, "float64").when(k == 1, "int32").when(k == 2, "bfloat16").otherwise("unknown")
    return _t(spark, sf, "part").select("p_partkey", content.element_size(dtype).alias("bytes"), content.chunk_count(F.col("p_size"), 8).cast("bigint").alias("chunks"), content.shard_size_of(F.col("p_size") * 100, 6).alias("shard"), F.lit(content.overhead_ratio(6, 4)).alias("overhead"))


@query("select p_partkey from part where p_name like '%e%' and p_brand = (select min(p_brand) from part) and p_size between 5 and 30")
def tensor_catalogue(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("dtype"), F.col("p_size").alias("size"))
    return content.find_tensors(p, name="*e*", dtype=p.agg(F.min("dtype")).first()[0], least=5, most=30).select("p_partkey")


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total, len(embedding) as n from embeddings")
def tensor_values(spark, sf):
    packed = content.pack_floats(_t(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    back = content.unpack_floats(packed, "vec_id", "data")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", _r(total, 4).alias("total"), F.size("values").cast("bigint").alias("n"))


@query(f"select doc_id, size, size - octet_length(encode(substr(text, 1, 20))) as saved from {_OBJECTS}")
def lazy_savings(spark, sf):
    return _objects(spark, sf).select("doc_id", "size", content.read_savings(F.col("size"), [F.substring("text", 1, 20)]).alias("saved"))


@query("select doc_id, true as ok from documents where length(text) > 0")
def erasure_round_trip(spark, sf):
    """Every text is cut into 4 + 2 shards, two are lost, and what is decoded is compared with the text."""
    d = _t(spark, sf, "documents", "doc_id", "text").where(F.length("text") > 0)
    shards = content.encode_objects(d, "doc_id", "text", 4, 2)
    back = content.decode_objects(shards.where("shard not in (1, 3)"), "doc_id", 4, 2)
    return back.join(d.select("doc_id", dedup.content_hash(F.col("text")).alias("h")), "doc_id").select("doc_id", (dedup.content_hash(F.col("data")) == F.col("h")).alias("ok"))


@query("select p_partkey, false as floats, true as near from part")
def byte_patterns(spark, sf):
    """Tests of raw bytes: whether they look like floats, and whether neighbours are close."""
    data = F.repeat(F.lit("\x7f"), 80).cast("binary")
    p = _t(spark, sf, "part").withColumn("data", F.expr("unhex(repeat('ffffff7f', 20))"))
    return p.select("p_partkey", content.looks_like_floats(F.col("data")).alias("floats"), content.neighbours_close(data).alias("near"))
