"""Replicas, edges, load, saturation and cost-based placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.operators.metrics import ratio
from lakeglass.operators.numbering import number_rows


def replica_counts(replicas: DataFrame, chunk: str, edge: str) -> DataFrame:
    return replicas.groupBy(chunk).agg(F.count_distinct(edge).alias("replicas"))


def availability(replicas: DataFrame, chunk: str, edge: str) -> DataFrame:
    """Distinct chunks, replicas in total, and the average replication (0 when empty)."""
    per = replica_counts(replicas, chunk, edge)
    return per.agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum("replicas"), F.lit(0)).alias("total_replicas"), F.coalesce(F.avg("replicas"), F.lit(0.0)).alias("average_replication"))


def under_replicated(replicas: DataFrame, chunk: str, edge: str, least: int) -> DataFrame:
    return replica_counts(replicas, chunk, edge).where(F.col("replicas") < least)


def over_replicated(replicas: DataFrame, chunk: str, edge: str, factor: int) -> DataFrame:
    """More than one replica above the factor."""
    return replica_counts(replicas, chunk, edge).where(F.col("replicas") > factor + 1)


def fleet_snapshot(edges: DataFrame, capacity: str, used: str, online: Column) -> DataFrame:
    return edges.agg(
        F.count("*").alias("edges"), F.count_if(online).alias("online"), F.sum(capacity).alias("capacity"), F.sum(used).alias("used"),
        ratio(F.sum(used), F.sum(capacity), 0.0).alias("utilisation"),
    )


def domain_capacity(edges: DataFrame, domain: str, capacity: str, used: str, online: Column) -> DataFrame:
    """Capacity of every domain: in total, and free on the edges that are online."""
    free = F.sum(F.when(online, F.col(capacity) - F.col(used)).otherwise(0))
    return edges.groupBy(domain).agg(F.sum(capacity).alias("total"), free.alias("available"))


def healthy_only(edges: DataFrame, health: str, threshold: float) -> DataFrame:
    return edges.where(F.col(health) >= threshold)


# Costs --------------------------------------------------------------------------


def bandwidth_cost(chunk_bytes: Column, bits_per_second: Column) -> Column:
    """Seconds to send the chunk over 10, at most 1; 1 without bandwidth."""
    return F.when(bits_per_second <= 0, 1.0).otherwise(F.least(chunk_bytes * 8.0 / bits_per_second / 10.0, F.lit(1.0)))


def rtt_cost(rtt_us: Column, max_rtt_us: float) -> Column:
    return F.least(rtt_us / F.lit(float(max_rtt_us)), F.lit(1.0))


def load_cost(active: Column, most: Column) -> Column:
    return F.when(most <= 0, 1.0).otherwise(F.least(active / most, F.lit(1.0)))


def saturation_cost(saturation: Column, trend: Column, threshold: float) -> Column:
    """Five times the excess over the threshold, more when rising, less when falling, within 0 to 1."""
    excess = F.when(saturation > threshold, F.least((saturation - threshold) * 5.0, F.lit(1.0))).otherwise(0.0)
    change = F.when(trend > 0, 0.3).when(trend < 0, -0.1).otherwise(0.0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(excess + F.when(excess > 0, change).otherwise(0.0), F.lit(1.0))), F.lit(0.0))


def headroom(saturation: Column) -> Column:
    return F.greatest(F.lit(1.0) - saturation, F.lit(0.0))


def transfer_millis(size: Column, bits_per_second: Column) -> Column:
    """Estimated transfer time, at least 1 ms; the largest 32-bit number without bandwidth."""
    return F.when(bits_per_second <= 0, F.lit(4294967295)).otherwise(F.greatest(F.floor(size * 8000.0 / bits_per_second), F.lit(1))).cast("long")


def health_score(success: Column, response_ms: Column, uptime: Column, weights: Sequence[float] = (0.4, 0.3, 0.3)) -> Column:
    return weights[0] * success + weights[1] * (1.0 - F.least(response_ms / 5000.0, F.lit(1.0))) + weights[2] * uptime


def network_quality(loss: Column, latency_ms: Column, jitter_ms: Column, max_latency: float = 500.0, max_jitter: float = 100.0) -> Column:
    """Half loss, three tenths latency, one fifth jitter; each a factor of 0 to 1."""
    factor = lambda x, most: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - x / most))
    return 0.5 * factor(loss, 1.0) + 0.3 * factor(latency_ms, max_latency) + 0.2 * factor(jitter_ms, max_jitter)


def cost_matrix(chunks: DataFrame, replicas: DataFrame, edges: DataFrame, chunk: str, edge: str, cost: Column, accepts: Column) -> DataFrame:
    """Sparse matrix ``chunk, edge, cost`` over the replicas on edges that accept transfers."""
    return replicas.select(chunk, edge).distinct().join(chunks, chunk).join(edges.where(accepts), edge).select(chunk, edge, cost.alias("cost"))


def apply_constraints(costs: DataFrame, constraints: DataFrame, edge: str) -> DataFrame:
    """Multiply costs by the edges' multipliers; edges that are unavailable or infinitely dear go."""
    both = costs.join(constraints.select(edge, "available", "multiplier"), edge, "left")
    kept = both.where(F.coalesce("available", F.lit(True)) & (F.coalesce("multiplier", F.lit(1.0)) < F.lit(float("inf"))))
    return kept.withColumn("cost", F.col("cost") * F.coalesce("multiplier", F.lit(1.0))).drop("available", "multiplier")


def cheapest(costs: DataFrame, chunk: str, edge: str, k: int, max_cost: float) -> DataFrame:
    """The ``k`` cheapest edges of every chunk, ties to the smaller edge."""
    w = Window.partitionBy(chunk).orderBy("cost", edge)
    return costs.where(F.col("cost") <= max_cost).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_hours(hour: Column, start: int, end: int, inclusive: bool = True) -> Column:
    """Whether an hour lies in a window that may pass midnight; the end hour belongs to it if ``inclusive``."""
    last = hour <= end if inclusive else hour < end
    return (hour >= start) & last if start <= end else (hour >= start) | last


def budget_multiplier(used: Column, budget: Column, size: Column) -> Column:
    """1 + ratio up to the budget, 1 + 2 ratio up to twice it, infinite beyond."""
    r = F.try_divide(used + size, budget)
    return F.when(budget.isNull(), 1.0).when(r <= 1, 1.0 + r).when(r <= 2, 1.0 + 2.0 * r).otherwise(F.lit(float("inf")))


def power_allows(level: Column, charging: Column, least: int, only_charging: bool = False) -> Column:
    enough = level.isNull() | (level >= least)
    return F.coalesce(charging, F.lit(False)) if only_charging else F.coalesce(charging, F.lit(False)) | enough


# Load ---------------------------------------------------------------------------


def load_classes(edges: DataFrame, active: str, most: str, low: float, high: float) -> DataFrame:
    load = ratio(F.col(active), F.when(F.col(most) > 0, F.col(most)), 0.0)
    return edges.withColumn("load", load).withColumn("load_class", F.when(F.col("load") > high, "over").when(F.col("load") < low, "under").otherwise("normal"))


def load_imbalance(loads: DataFrame, n: int) -> DataFrame:
    """Whether a tick is out of balance: ``n`` overloaded edges, or one and ``n`` underloaded."""
    per = loads.agg(F.count_if(F.col("load_class") == "over").alias("over"), F.count_if(F.col("load_class") == "under").alias("under"))
    return per.withColumn("imbalanced", (F.col("over") >= n) | ((F.col("over") >= 1) & (F.col("under") >= n)))


def saturation_summary(edges: DataFrame, edge: str, saturation: str, saturated: float, near: float) -> DataFrame:
    s = F.col(saturation)
    return edges.agg(
        F.count_if(s >= saturated).alias("saturated"), F.count_if((s >= near) & (s < saturated)).alias("near"),
        F.coalesce(F.avg(s), F.lit(0.0)).alias("mean"), F.max(s).alias("max"), F.max_by(edge, F.struct(s, -F.col(edge))).alias("most_saturated"),
    )


def path_diversity(connections: DataFrame, group: Sequence[str], path: str) -> DataFrame:
    """Connections, distinct paths, their ratio, and the fairness of the split over paths."""
    per = connections.groupBy(*group, path).agg(F.count("*").alias("n"))
    total = per.groupBy(*group).agg(F.sum("n").alias("connections"), F.count("*").alias("paths"), F.sum(F.col("n") * F.col("n")).alias("_sq"), F.max("n").alias("_most"))
    fair = F.col("connections") / F.col("paths")
    deviation = F.col("_sq") / F.col("paths") - fair * fair
    score = F.when(F.col("paths") <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - deviation / (fair * fair * F.col("paths"))))
    return total.select(
        *group, "connections", "paths", ratio(F.col("paths"), F.col("connections"), 0.0).alias("diversity"), score.alias("balance"), (F.col("_most") > 0.5 * F.col("connections")).alias("overloaded_path")
    )


def underused_paths(connections: DataFrame, group: Sequence[str], path: str) -> DataFrame:
    """Paths with less than a tenth of their fair share."""
    per = connections.groupBy(*group, path).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    return per.withColumn("_fair", F.sum("n").over(w) / F.count("*").over(w)).where(F.col("n") < 0.1 * F.col("_fair")).drop("_fair")


def drift(transfers: DataFrame, edge: str, size: str, millis: str, expected: DataFrame, least: int) -> DataFrame:
    """Actual against expected speed per edge with at least ``least`` samples."""
    actual = transfers.groupBy(edge).agg(F.count("*").alias("samples"), F.try_divide(F.sum(size) * 1000.0, F.sum(millis)).alias("speed")).where(F.col("samples") >= least)
    return actual.join(expected, edge).withColumn("ratio", ratio(F.col("speed"), F.col("expected_speed"), 0.0))


# Placement ----------------------------------------------------------------------


def placement_score(healthy: Column, load: Column, gpu: Column, wants_gpu: Column, transport: Column, wanted_transport: Column) -> Column:
    """100 less 30 per load, with bonuses for accelerators and transport; 0 if unhealthy."""
    bonus = F.when(wants_gpu & gpu, 20.0).when(gpu, 10.0).otherwise(0.0)
    fit = F.when(wanted_transport.isNull(), 0.0).when(transport == wanted_transport, 30.0).otherwise(-50.0)
    return F.when(~healthy, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 30.0 * load + bonus + fit))


def node_score(free_bytes: Column, load: Column, gpu: Column, bits_per_second: Column) -> Column:
    """20 per free TB, 30 for an idle node, 40 for a GPU, 10 per 10 Gbit/s."""
    return 20.0 * free_bytes / 1e12 + 30.0 * (1.0 - load) + F.when(gpu, 40.0).otherwise(0.0) + 10.0 * bits_per_second / 1e10


def nearest(locations: DataFrame, shard: str, domain: str, latency: str, healthy: Column, local: str | None = None, margin: float = 10.0) -> DataFrame:
    """The healthy domain with the least latency per shard; the local one wins within ``margin``."""
    ms = F.coalesce(F.col(latency).cast("double"), F.lit(1.7976931348623157e308))
    here = (F.col(domain) == local) if local is not None else F.lit(False)
    eff = F.when(here, ms - margin).otherwise(ms)
    return locations.where(healthy).groupBy(shard).agg(F.min_by(domain, F.struct(eff, domain)).alias(domain))


def read_plan(locations: DataFrame, obj: str, shard: str, domain: str, latency: str, healthy: Column, k: int, prefer: str = "nearest", primary: Column | None = None) -> DataFrame:
    """One source per shard, and whether enough shards are readable.

    ``prefer`` is nearest, any (the first domain), primary (it if healthy, else the
    nearest) or round_robin (shards take turns over the domains that hold them).
    """
    near = F.coalesce(F.col(latency), F.lit(2147483647))
    order = {"nearest": [near, domain], "any": [domain], "primary": [(~F.coalesce(primary, F.lit(False))).cast("int") if primary is not None else F.lit(0), near, domain]}
    if prefer == "round_robin":
        turn = Window.partitionBy(obj, shard).orderBy(domain)
        held = locations.where(healthy).withColumn("_at", F.row_number().over(turn) - 1).withColumn("_of", F.count("*").over(Window.partitionBy(obj, shard)))
        plan = held.where(F.col("_at") == F.pmod(F.crc32(F.col(shard).cast("string").cast("binary")), F.col("_of"))).drop("_at", "_of")
        return plan.withColumn("readable", F.count("*").over(Window.partitionBy(obj)) >= k)
    w = Window.partitionBy(obj, shard).orderBy(*order[prefer])
    plan = locations.where(healthy).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return plan.withColumn("readable", F.count("*").over(Window.partitionBy(obj)) >= k)


def by_proximity(domains: DataFrame, domain: str, region: str, local: str, local_region: str) -> DataFrame:
    return domains.withColumn("distance", F.when(F.col(domain) == local, 0).when(F.col(region) == local_region, 1).otherwise(2)).orderBy("distance", domain)


def round_robin(items: DataFrame, order: Sequence[str], ranks: int, partition: Sequence[str] = ()) -> DataFrame:
    """Item ``i`` of the order goes to rank ``i mod ranks``."""
    if ranks <= 0:
        raise ValueError("ranks must be positive")
    if not partition:
        return number_rows(items, order, "_i").withColumn("rank", F.pmod("_i", F.lit(ranks)).cast("int")).drop("_i")
    return items.withColumn("rank", F.pmod(F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1, F.lit(ranks)))


def block_assignment(items: DataFrame, order: Sequence[str], ranks: int, partition: Sequence[str]) -> DataFrame:
    """Blocks of ``ceil(n / ranks)`` neighbours go to one rank."""
    w = Window.partitionBy(*partition)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return items.withColumn("_i", i).withColumn("_n", n).withColumn("rank", F.expr(f"cast(_i div ceil(_n / {ranks}) as int)")).drop("_i", "_n")


def plan_shards(objects: DataFrame, obj: str, total: int, domains: Sequence[str]) -> DataFrame:
    """Round-robin of an object's shards over the allowed domains, starting from its hash."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("shard")
    names = F.array(*[F.lit(d) for d in domains])
    return objects.select(obj, spread).withColumn("domain", F.element_at(names, (F.pmod(F.crc32(F.col(obj).cast("string").cast("binary")) + F.col("shard"), F.lit(len(domains))) + 1).cast("int")))


def shard_state(shards: DataFrame, obj: str, shard: str, healthy: Column, k: int, m: int) -> DataFrame:
    """Healthy distinct shards per object, whether it can be read and whether it needs repair."""
    per = shards.groupBy(obj).agg(F.count_distinct(F.when(healthy, F.col(shard))).alias("healthy"))
    return per.withColumn("recoverable", F.col("healthy") >= k).withColumn("needs_repair", F.col("healthy") < k + m)


def repair_candidates(shards: DataFrame, obj: str, shard: str, healthy: Column, total: int) -> DataFrame:
    """Objects with shards missing, and which."""
    have = F.collect_set(F.when(healthy, F.col(shard).cast("int")))
    per = shards.groupBy(obj).agg(have.alias("_have"))
    return per.select(obj, F.array_except(F.sequence(F.lit(0), F.lit(total - 1)), "_have").alias("missing")).where(F.size("missing") > 0)


def evict(tensors: DataFrame, score: str, tie: str, size: str, needed: int, partition: Sequence[str] = ()) -> DataFrame:
    """Candidates by descending score until enough bytes are freed; the one that crosses is included."""
    w = Window.partitionBy(*partition).orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, -1)
    return tensors.withColumn("freed_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("freed_before") < needed)


def spill_priority(policy: str, idle_ms: Column, size: Column, uses: Column) -> Column:
    """Score of a tensor for spilling: idle time, idle time per use, or idle time by size."""
    if policy == "lru":
        return idle_ms.cast("double")
    if policy == "lfu":
        return idle_ms / F.log2(uses + 2.0)
    if policy == "size":
        return idle_ms * F.sqrt(size.cast("double"))
    raise ValueError(policy)


def quorum(votes: DataFrame, group: Sequence[str], reachable: Column) -> DataFrame:
    """Reachable members against a majority of all."""
    per = votes.groupBy(*group).agg(F.count("*").alias("members"), F.count_if(reachable).alias("reachable"))
    return per.withColumn("quorum", F.floor(F.col("members") / 2) + 1).withColumn("has_quorum", F.col("reachable") >= F.col("quorum"))


def election(votes: DataFrame, group: str, voter: str, candidate: str, members: int) -> DataFrame:
    """Elected with a majority, split when all voted without one, else pending."""
    per = votes.groupBy(group, candidate).agg(F.count_distinct(voter).alias("n"))
    top = per.groupBy(group).agg(F.max_by(candidate, F.struct("n", candidate)).alias("leader"), F.max("n").alias("votes"), F.sum("n").alias("cast"))
    outcome = F.when(F.col("votes") >= members // 2 + 1, "elected").when(F.col("cast") >= members, "split").otherwise("pending")
    return top.withColumn("outcome", outcome)


def chunk_offsets(chunks: DataFrame, keys: Sequence[str], order: str, size: str) -> DataFrame:
    """Byte offset of every chunk: the sizes before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def file_chunks(files: DataFrame, chunks: DataFrame, start: str, end: str, index: str) -> DataFrame:
    """Range join of files with their chunks ``[start, end)``, as an equi-join on the expanded index."""
    wanted = files.where(F.col(end) > F.col(start)).withColumn(index, F.explode(F.sequence(F.col(start), F.col(end) - 1)))
    return wanted.join(chunks, index)


def local_minima(chunks: DataFrame, keys: Sequence[str], order: str, weight: str) -> DataFrame:
    """Positions whose weight is below both neighbours' (an edge has one)."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(weight).over(w), F.lead(weight).over(w)
    return chunks.withColumn("is_minimum", (before.isNull() | (F.col(weight) < before)) & (after.isNull() | (F.col(weight) < after)))
