"""Ordered folds: moving averages, smoothed round-trip times, hysteresis, throttles.

Each fold needs its key's records in order.  They run as one ``aggregate`` over the
sorted records of a key, in the JVM.  A key's records are held by one task, so they
are for series of bounded length (a device, an edge, a session); the streaming
versions keep only the state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fold the records of every key, sorted by ``order`` then ``fields``, into ``value``."""
    records = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    out = F.aggregate("_r", start, step, finish) if finish else F.aggregate("_r", start, step)
    return df.groupBy(*keys).agg(records.alias("_r")).select(*keys, out.alias("value"))


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float, reseed_at_zero: bool = False) -> DataFrame:
    """Exponential moving average: the first sample seeds; with ``reseed_at_zero`` so does any after 0."""

    def step(acc: Column, r: Column) -> Column:
        x = r[value].cast("double")
        fresh = acc.isNull() | (acc == 0) if reseed_at_zero else acc.isNull()
        return F.when(x.isNull(), acc).when(fresh, x).otherwise(F.lit(alpha) * x + F.lit(1.0 - alpha) * acc)

    return ordered_fold(df, keys, order, [value], F.lit(None).cast("double"), step)


def bandwidth(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, millis: str, alpha: float = 0.2) -> DataFrame:
    """Moving average, peak and number of transfer rates (bytes per second); zero durations are ignored."""
    rates = df.where(F.col(millis) > 0).withColumn("_rate", F.col(size) * 1000.0 / F.col(millis))
    peak = rates.groupBy(*keys).agg(F.max("_rate").alias("peak"), F.count("*").alias("samples"))
    return ema(rates, keys, order, "_rate", alpha).withColumnRenamed("value", "average").join(peak, list(keys))


def smoothed_rtt(df: DataFrame, keys: Sequence[str], order: Sequence[str], rtt_us: str) -> DataFrame:
    """Smoothed round-trip time, variance and timeout with weights 1/8 and 1/4, truncated at each step.

    The variance uses the smoothed time before the update.
    """

    def step(acc: Column, r: Column) -> Column:
        x = r[rtt_us].cast("long")
        srtt, var = acc["srtt"], acc["rttvar"]
        new_var = F.floor((3 * var + F.abs(srtt - x)) / 4)
        new_srtt = F.floor((7 * srtt + x) / 8)
        first = F.struct(x.alias("srtt"), F.floor(x / 2).cast("long").alias("rttvar"))
        return F.when(srtt.isNull(), first).otherwise(F.struct(new_srtt.cast("long").alias("srtt"), new_var.cast("long").alias("rttvar")))

    start = F.struct(F.lit(None).cast("long").alias("srtt"), F.lit(None).cast("long").alias("rttvar"))
    out = ordered_fold(df, keys, order, [rtt_us], start, step)
    return out.select(*keys, "value.srtt", "value.rttvar", (F.col("value.srtt") + 4 * F.col("value.rttvar")).alias("rto"))


def truncating_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Running integer mean, truncated at every record, so it depends on the order."""

    def step(acc: Column, r: Column) -> Column:
        n = acc["n"] + 1
        return F.struct(n.alias("n"), F.floor((acc["mean"] * acc["n"] + r[value].cast("long")) / n).cast("long").alias("mean"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("mean"))
    return ordered_fold(df, keys, order, [value], start, step, lambda acc: acc["mean"])


def hysteresis(df: DataFrame, partition: Sequence[str], order: Sequence[str], score: str, low: float, high: float) -> DataFrame:
    """State changes of a trigger that degrades below ``low`` and recovers only from ``high`` on.

    The state is that of the last score outside the band; a window carries it, so no
    key has to be collected.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    crossed = F.when(F.col(score) < low, F.lit("degraded")).when(F.col(score) >= high, F.lit("healthy"))
    state = F.coalesce(F.last(crossed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("healthy"))
    before = F.coalesce(F.lag("state").over(w), F.lit("healthy"))
    return df.withColumn("state", state).withColumn("before", before).where("state <> before")


def bounded_counter(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, bound: int) -> DataFrame:
    """What each increment of a bounded counter was granted: at most what was left."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(bound) - F.coalesce(F.sum(amount).over(w), F.lit(0)), F.lit(0))
    return df.withColumn("granted", F.least(F.col(amount), left))


def throttle(df: DataFrame, keys: Sequence[str], order: Sequence[str], depth: str, low: float, high: float, floor: float = 0.1, alpha: float = 0.3) -> DataFrame:
    """Smoothed throttle ratio: 1 up to ``low``, falling to 0.5 at ``high``, then on to ``floor``."""
    d = F.col(depth).cast("double")
    ratio = F.when(d <= low, 1.0).when(d <= high, 1.0 - 0.5 * (d - low) / (high - low)).otherwise(F.greatest(F.lit(floor), 0.5 * (1.0 - (d - high) / high)))
    return ema(df.withColumn("_ratio", ratio), keys, order, "_ratio", alpha)


def clock_tick(events: DataFrame, node: str, order: Sequence[str], physical: str) -> DataFrame:
    """Hybrid logical clock of each node after its last event: (greatest time, logical count since)."""

    def step(acc: Column, r: Column) -> Column:
        now = r[physical].cast("long")
        ahead = now > acc["physical"]
        return F.struct(F.greatest(now, acc["physical"]).alias("physical"), F.when(ahead, F.lit(0)).otherwise(acc["logical"] + 1).cast("int").alias("logical"))

    start = F.struct(F.lit(-1).cast("long").alias("physical"), F.lit(0).cast("int").alias("logical"))
    return ordered_fold(events, [node], order, [physical], start, step).select(node, "value.physical", "value.logical")
