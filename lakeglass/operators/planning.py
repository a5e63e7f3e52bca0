"""Scheduler plans: rebalancing, prepositioning, repair queues, constraints, estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.operators.fleet import in_hours
from lakeglass.operators.folds import ordered_fold
from lakeglass.operators.numbering import number_rows


def saturation_penalty(saturation: Column, trend: Column, samples: Column, threshold: float = 0.8, scale: float = 2.0, rising: float = 0.2, falling: float = 0.1, least_samples: int = 3) -> Column:
    """Excess over the threshold times ``scale``, at most 1, plus the trend where samples suffice, within 0 to 1."""
    excess = F.when(saturation > threshold, F.least((saturation - threshold) * scale, F.lit(1.0))).otherwise(0.0)
    change = F.when(samples < least_samples, 0.0).when(trend > 0, rising).when(trend < 0, -falling).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(excess + change, F.lit(1.0)))


def window_active(ts: Column, start: int, end: int, days: Sequence[int] = (), offset_hours: int = 0) -> Column:
    """Whether a moment lies in a daily window, on one of ``days`` (Monday 0; none means all).

    ``offset_hours`` is the window's zone against the moment's.  A window may pass
    midnight, and its end hour belongs to it; the day is that of the moment itself.
    """
    local = ts + F.make_dt_interval(hours=F.lit(offset_hours))
    inside = in_hours(F.hour(local), start, end)
    return inside & F.weekday(local).isin(*days) if days else inside


def combined_multiplier(time: Column | None = None, cost: Column | None = None, power: Column | None = None) -> Column:
    """The product of the multipliers an edge has; 1 where it has none."""
    out = F.lit(1.0)
    for factor in (time, cost, power):
        if factor is not None:
            out = out * F.coalesce(factor, F.lit(1.0))
    return out


def deep_scrub_due(paused: Column, load: Column, max_load: float, last_run: Column, now: str, every_seconds: int, start: int, end: int, days: Sequence[int]) -> Column:
    """As a light scrub, but within a window whose end hour does not belong to it, on given weekdays (Sunday 0)."""
    moment = F.lit(now).cast("timestamp_ntz")
    elapsed = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last_run.cast("timestamp"))
    inside = in_hours(F.hour(moment), start, end, inclusive=False) & (F.dayofweek(moment) - 1).isin(*days)
    return ~paused & inside & (load <= max_load) & (last_run.isNull() | (elapsed >= every_seconds))


def eta_millis(remaining: Column, bytes_per_second: Column) -> Column:
    """Milliseconds that the remaining bytes take; null when nothing remains or nothing moves."""
    return F.when((bytes_per_second > 0) & (remaining > 0), F.floor(remaining / bytes_per_second * 1000.0))


def drift_average(samples: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, millis: str, alpha: float = 0.3) -> DataFrame:
    """Moving average of the speed per key, in whole bits per second; samples of no duration are ignored."""
    rates = samples.where(F.col(millis) > 0).withColumn("_bps", F.expr(f"({size} * 8 * 1000) div {millis}"))

    def step(acc: Column, r: Column) -> Column:
        x = r["_bps"].cast("double")
        return F.when(acc.isNull(), x).otherwise(F.lit(alpha) * x + F.lit(1.0 - alpha) * acc)

    return ordered_fold(rates, keys, order, ["_bps"], F.lit(None).cast("double"), step)


def repair_queue(jobs: DataFrame, priority: str, created: str, tie: str, n: int | None = None) -> DataFrame:
    """Jobs in the order they are taken: smallest priority, then oldest; the next ``n`` if given."""
    ordered = jobs.orderBy(priority, created, tie)
    return ordered if n is None else ordered.limit(n)


def rebalance_plan(edges: DataFrame, chunks: DataFrame, edge: str, chunk: str, active: str, most: str, low: float, high: float, limit: int) -> DataFrame:
    """At most ``limit`` moves ``chunk, source, target, benefit`` from overloaded to underloaded edges, best first.

    Every move goes to the edge that is least loaded at that moment, and changes both
    loads by one over the number of edges, so moves depend on each other.  What is
    folded are the edges' loads (a fleet has thousands), not the chunks: of these only
    the first ``limit`` can move, since overloaded edges are served in order and one
    move is planned for every chunk while it pays.
    """
    load = F.coalesce(F.try_divide(F.col(active).cast("double"), F.col(most).cast("double")), F.lit(0.0))
    fleet = edges.select(F.col(edge).alias("e"), load.alias("load"))
    loads = F.array_sort(F.collect_list(F.struct("e", "load")))
    state = fleet.agg(loads.alias("loads"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("load") > high, F.col("e")))).alias("over"), F.collect_set(F.when(F.col("load") < low, F.col("e"))).alias("under"))
    first = chunks.select(chunk).distinct().orderBy(chunk).limit(limit).agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    op = "struct<chunk:bigint,source:bigint,target:bigint,benefit:double>"
    tries = F.flatten(F.transform("over", lambda e: F.transform("chunks", lambda c: F.struct(e.alias("e"), c.alias("c")))))

    def step(acc: Column, at: Column) -> Column:
        of = lambda e: F.element_at(F.filter(acc["loads"], lambda x: x["e"] == e), 1)["load"]
        free = F.filter(acc["loads"], lambda x: F.array_contains(acc["under"], x["e"]))
        target = F.array_min(F.transform(free, lambda x: F.struct(F.greatest(F.floor(x["load"] * 1000), F.lit(0)).alias("k"), x["e"].alias("e"), x["load"].alias("load"))))
        benefit = of(at["e"]) - target["load"]
        moves = (F.size(acc["ops"]) < limit) & target.isNotNull() & (benefit > 0)
        weight = 1.0 / acc["n"]
        shifted = F.transform(acc["loads"], lambda x: F.struct(x["e"].alias("e"), F.when(x["e"] == at["e"], x["load"] - weight).when(x["e"] == target["e"], x["load"] + weight).otherwise(x["load"]).alias("load")))
        one = F.array(F.struct(at["c"].cast("bigint").alias("chunk"), at["e"].cast("bigint").alias("source"), target["e"].cast("bigint").alias("target"), benefit.alias("benefit")))
        return F.struct(F.when(moves, shifted).otherwise(acc["loads"]).alias("loads"), acc["under"].alias("under"), acc["n"].alias("n"), F.when(moves, F.concat(acc["ops"], one)).otherwise(acc["ops"]).alias("ops"))

    begin = F.struct(F.col("loads"), F.col("under"), F.col("n"), F.array().cast(f"array<{op}>").alias("ops"))
    # Only the first edges can use up the limit; an edge pays for at most its load times the edges.
    plan = state.withColumn("_one", F.lit(1)).join(first.withColumn("_one", F.lit(1)), "_one").select(F.aggregate(F.slice(tries, 1, limit * 4), begin, step, lambda acc: acc["ops"]).alias("ops"))  # one row each
    return plan.select(F.explode("ops").alias("o")).select("o.*").orderBy(F.desc("benefit"), "source", "chunk")


def preposition_plan(predicted: DataFrame, locations: DataFrame, edges: DataFrame, chunk: str, edge: str, confidence: str, least_confidence: float, limit: int) -> DataFrame:
    """Copies of predicted chunks to edges that lack them: ``chunk, source, target, confidence, priority``.

    The source is the healthiest holder (health at least 0.5, load below 0.9), the
    target the least loaded edge (below 0.8) that does not hold the chunk; ties to the
    smaller edge.  The first ``limit`` chunks in their order are taken, then the plan is
    sorted by priority.  ``edges`` has ``health`` and ``load``.

    Targets are found without pairing chunks and edges: the free edges are ranked, and
    a chunk held by h edges needs only look at the first h + 1 of them.
    """
    held = locations.select(chunk, edge).distinct()
    source = held.join(edges, edge).where("health >= 0.5 and load < 0.9").groupBy(chunk).agg(F.max_by(edge, F.struct("health", (-F.col(edge)).alias("_t"))).alias("source"))
    free = number_rows(edges.where("load < 0.8"), ["load", edge], "_rank").select(F.col("_rank"), F.col(edge).alias("_free"))
    holders = held.groupBy(chunk).agg(F.collect_set(edge).alias("_held"))
    chosen = predicted.where(F.col(confidence) >= least_confidence).join(holders, chunk).join(source, chunk)
    looks = chosen.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.size("_held").cast("long"))).alias("_rank")).join(free, "_rank").where(~F.array_contains("_held", F.col("_free")))
    target = looks.groupBy(chunk, confidence, "source").agg(F.min_by("_free", "_rank").alias("target"))
    priority = F.when(F.col(confidence) >= 0.9, "high").when(F.col(confidence) >= 0.7, "medium").otherwise("low")
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return target.orderBy(chunk).limit(limit).withColumn("priority", priority).orderBy(order, chunk)


def ranked_domains(latencies: DataFrame, domain: str, average_ms: str, age_seconds: Column, max_age: int) -> DataFrame:
    """Domains by whole milliseconds of their average, without stale ones; ties to the smaller name."""
    fresh = latencies.where(age_seconds <= max_age).select(domain, F.floor(average_ms).cast("bigint").alias("millis"))
    return fresh.withColumn("rank", F.rank().over(Window.orderBy("millis"))).orderBy("millis", domain)


def prestage(predictions: DataFrame, holdings: DataFrame, session: str, item: str, node: str) -> DataFrame:
    """Predicted items of a session that its node does not hold yet."""
    return predictions.join(holdings.select(node, item), [node, item], "left_anti").select(session, node, item)


def backpressure_summary(queues: DataFrame, depth: str, high: int, low: int) -> DataFrame:
    """Bytes queued, queues above the high mark, and use of the mark in percent (0 without a mark)."""
    total = F.coalesce(F.sum(depth), F.lit(0))
    percent = (total / F.lit(float(high)) * 100.0) if high > 0 else F.lit(0.0)
    return queues.agg(total.alias("queue_bytes"), F.count_if(F.col(depth) > high).alias("pressured"), F.count_if(F.col(depth) < low).alias("idle"), percent.alias("usage_percent"))
