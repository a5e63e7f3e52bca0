"""Counters, gauges, histograms, percentiles, rates and health verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, default: float) -> Column:
    """``part / whole``, or ``default`` where the whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(float(default)))


def steady_mean(value: str) -> Column:
    """Mean of a group that no order of its rows changes, so that its whole part is certain.

    Sums of doubles depend on their order.  Values that are decimals of up to 19 digits
    before and 9 after the point are summed exactly; a group with others is averaged as doubles.
    """
    x, exact = F.col(value), F.col(value).try_cast("decimal(28,9)")
    fits = F.bool_and(F.coalesce(exact.cast("double") == x.cast("double"), x.isNull()))
    return F.when(fits, F.try_divide(F.sum(exact).cast("double"), F.count(x))).otherwise(F.avg(x))


def counter(df: DataFrame, keys: Sequence[str], amount: str | None = None) -> DataFrame:
    """Events per key, and the sum of ``amount``."""
    aggs = [F.count("*").alias("count")]
    if amount:
        aggs.append(F.coalesce(F.sum(amount), F.lit(0)).alias("total"))
    return df.groupBy(*keys).agg(*aggs)


def gauge(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The last value per key; ``order`` must be a total order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"))


def cumulative_histogram(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Rows ``keys, le, count``: observations up to each bound. One pass, then bounds are unpivoted."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)])
    return counts.select(*keys, F.explode(pairs).alias("_e")).select(*keys, "_e.le", "_e.count")


def histogram_summary(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """One row per key: cumulative ``buckets``, ``sum``, ``count`` and ``mean`` (0 when empty)."""
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("count")) for b in bounds])
    return df.groupBy(*keys).agg(buckets.alias("buckets"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"), F.count(value).alias("count"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """Exact nearest-rank percentiles: rows ``keys, percent, value``.

    The rank is ``round(p / 100 * (n - 1))``, halves away from zero, over the sorted
    values without NaN.  Equal values are counted first, so what is ranked is the
    distinct values; nothing is collected into one row.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_hi", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent")
    rank = F.floor(F.col("percent") / 100 * (F.col("_n") - 1) + 0.5)
    return placed.select("*", wanted).where((rank < F.col("_hi")) & (rank >= F.col("_hi") - F.col("_c"))).select(*keys, "percent", F.col("_v").alias("value"))


def store_metrics(df: DataFrame, keys: Sequence[str], op: str, latency: str, size: str, error: str = "error") -> DataFrame:
    """Operations, bytes, mean latency and error rate per key."""
    errors = F.count_if(F.col(op) == error)
    return df.groupBy(*keys).agg(
        F.count("*").alias("operations"),
        F.sum(size).alias("bytes"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("mean_latency"),
        errors.alias("errors"),
        ratio(errors, F.count("*"), 0.0).alias("error_rate"),
    )


def stage_stats(df: DataFrame, stage: str, latency: str, size: str) -> DataFrame:
    """Bytes, count, least, most and integer mean latency per stage."""
    return df.groupBy(stage).agg(
        F.sum(size).alias("bytes"), F.count("*").alias("count"), F.min(latency).alias("min_latency"), F.max(latency).alias("max_latency"), F.floor(F.sum(latency) / F.count("*")).alias("avg_latency")
    )


def pipeline_summary(stages: DataFrame, seconds: float) -> DataFrame:
    """Throughput, and end-to-end latency as the sum of the stages' means."""
    return stages.agg((F.max("bytes") / F.lit(seconds)).alias("bytes_per_second"), F.sum("avg_latency").alias("end_to_end_latency"))


def shard_health(healthy: Column, total: Column, lost: Column, decoded: Column, attempts: Column) -> dict[str, Column]:
    """Health ratio (1 when empty), loss rate (0) and decode success rate (1)."""
    return {"shard_health": ratio(healthy, total, 1.0), "shard_loss": ratio(lost, total, 0.0), "decode_success": ratio(decoded, attempts, 1.0)}


def is_healthy(get_error_rate: Column, put_error_rate: Column, shard_health: Column, missing: Column) -> Column:
    return (get_error_rate < 0.01) & (put_error_rate < 0.01) & (shard_health >= 0.9) & (missing == 0)


def usage_grouping_sets(df: DataFrame, bucket: str, user: str, size: str) -> DataFrame:
    """Bytes and objects by bucket, by user and over all, in one pass."""
    sets = df.groupingSets([[bucket], [user], []], bucket, user)
    scope = F.when(F.grouping(bucket) == 0, F.lit("bucket")).when(F.grouping(user) == 0, F.lit("user")).otherwise(F.lit("global"))
    return sets.agg(scope.alias("scope"), F.sum(size).alias("bytes"), F.count("*").alias("objects")).select("scope", F.coalesce(F.col(bucket).cast("string"), F.col(user).cast("string"), F.lit("*")).alias("name"), "bytes", "objects")


def reduce_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum, greatest, least, product and bitwise folds of an integer column."""
    whole = F.col(value).cast("long")
    return df.groupBy(*keys).agg(
        F.sum(whole).alias("sum"), F.max(whole).alias("max"), F.min(whole).alias("min"), F.product(F.col(value).cast("double")).alias("product"),
        F.bit_and(whole).alias("bit_and"), F.bit_or(whole).alias("bit_or"), F.bit_xor(whole).alias("bit_xor"),
    )


def average_metrics(df: DataFrame, keys: Sequence[str], defaults: dict[str, float], biased: bool = False) -> DataFrame:
    """Means per key; ``biased`` adds one default to each sum, as an accumulator that starts from the defaults does."""
    mean = {c: ((F.sum(c) + F.lit(d)) / F.count("*") if biased else F.avg(c)) for c, d in defaults.items()}
    return df.groupBy(*keys).agg(*[m.alias(c) for c, m in mean.items()])


def reduce_floats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same folds of a floating column; the bitwise ones go through whole numbers."""
    x, whole = F.col(value).cast("double"), F.col(value).cast("long")
    return df.groupBy(*keys).agg(
        F.sum(x).alias("sum"), F.max(x).alias("max"), F.min(x).alias("min"), F.product(x).alias("product"),
        F.bit_and(whole).cast("double").alias("bit_and"), F.bit_or(whole).cast("double").alias("bit_or"), F.bit_xor(whole).cast("double").alias("bit_xor"),
    )


def registry_snapshot(counters: DataFrame | None = None, gauges: DataFrame | None = None, histograms: DataFrame | None = None) -> DataFrame:
    """All metrics in one table: ``name, kind, value, count``.

    ``counters`` and ``gauges`` are ``name, value``; ``histograms`` are ``name, sum,
    count``, whose value is the mean (0 when empty).
    """
    parts = [df.select("name", F.lit(kind).alias("kind"), F.col("value").cast("double").alias("value"), F.lit(None).cast("long").alias("count")) for df, kind in ((counters, "counter"), (gauges, "gauge")) if df is not None]
    if histograms is not None:
        parts.append(histograms.select("name", F.lit("histogram").alias("kind"), ratio(F.col("sum"), F.col("count"), 0.0).alias("value"), F.col("count").cast("long").alias("count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def healer_stats(jobs: DataFrame, keys: Sequence[str], kind: str, ok: Column, millis: str, size: Column) -> DataFrame:
    """Scans and repairs, how many failed, their mean times (0 when none), and bytes moved by repairs that worked."""
    scan, repair = F.col(kind) == "scan", F.col(kind) == "repair"
    mean = lambda which: F.coalesce(F.avg(F.when(which, F.col(millis))), F.lit(0.0))
    return jobs.groupBy(*keys).agg(
        F.count_if(scan).alias("scans"), F.count_if(scan & ~ok).alias("scans_failed"), mean(scan & ok).alias("avg_scan_ms"),
        F.count_if(repair & ok).alias("repairs"), F.count_if(repair & ~ok).alias("repairs_failed"), mean(repair & ok).alias("avg_repair_ms"),
        F.coalesce(F.sum(F.when(repair & ok, size)), F.lit(0)).alias("bytes"),
    )


def error_ppm(errors: Column, scanned: Column) -> Column:
    """Errors per million; 0 when nothing was scanned."""
    return ratio(errors, scanned, 0.0) * 1e6


def compression(df: DataFrame, keys: Sequence[str], original: str, compressed: str) -> DataFrame:
    """Bytes before over bytes after (0 when there are none), and the share saved."""
    a, b = F.coalesce(F.sum(original), F.lit(0)), F.coalesce(F.sum(compressed), F.lit(0))
    return df.groupBy(*keys).agg(F.count("*").alias("items"), ratio(a, b, 0.0).alias("ratio"), F.when(a > 0, 1.0 - b / a).otherwise(0.0).alias("savings"))


def latency_by_domain(df: DataFrame, domain: str, millis: str) -> DataFrame:
    """Least, most and whole mean latency per domain."""
    return df.groupBy(domain).agg(F.min(millis).alias("min_ms"), F.max(millis).alias("max_ms"), F.floor(steady_mean(millis)).cast("bigint").alias("mean_ms"), F.count("*").alias("samples"))
