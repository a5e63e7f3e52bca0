"""Merges of conflict-free replicated data, as aggregations over all replicas' states.

Merging is taking a maximum or a union, so any number of replicas merge in one
aggregation with partial sums on the map side; duplicate and reordered deliveries
change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = ("physical", "logical", "node")


def stamp(columns: Sequence[str] = STAMP) -> Column:
    """A hybrid logical clock stamp, compared field by field."""
    return F.struct(*columns)


def concurrent(a: Column, b: Column) -> Column:
    """Stamps of equal time and count from different nodes."""
    return (a["physical"] == b["physical"]) & (a["logical"] == b["logical"]) & (a["node"] != b["node"])


def gcounter_state(states: DataFrame, key: str, node: str, count: str) -> DataFrame:
    """Merged per-node counts: the highest seen."""
    return states.groupBy(key, node).agg(F.max(count).alias(count))


def gcounter_value(states: DataFrame, key: str, node: str, count: str) -> DataFrame:
    return gcounter_state(states, key, node, count).groupBy(key).agg(F.sum(count).alias("value"))


def gcounter_dominates(a: DataFrame, b: DataFrame, key: str, node: str, count: str) -> DataFrame:
    """Per key of ``b``, whether ``a`` has seen at least as much from every node."""
    both = b.select(key, node, F.col(count).alias("_b")).join(a.select(key, node, F.col(count).alias("_a")), [key, node], "left")
    return both.groupBy(key).agg(F.bool_and(F.coalesce("_a", F.lit(0)) >= F.col("_b")).alias("dominates"))


def pncounter_value(states: DataFrame, key: str, node: str, up: str, down: str) -> DataFrame:
    """Increments less decrements, each merged per node; and the share of increments."""
    merged = states.groupBy(key, node).agg(F.max(up).alias("_u"), F.max(down).alias("_d"))
    u, d = F.sum("_u"), F.sum("_d")
    return merged.groupBy(key).agg((u - d).alias("value"), F.coalesce(F.try_divide(u.cast("double"), (u + d).cast("double")), F.lit(0.0)).alias("ratio"))


def lww_merge(writes: DataFrame, key: str, value: str, columns: Sequence[str] = STAMP) -> DataFrame:
    """Last writer wins: the value with the greatest stamp (the value itself breaks what remains)."""
    return writes.groupBy(key).agg(F.max_by(value, F.struct(*columns, value)).alias(value))


def lww_map_merge(writes: DataFrame, keys: Sequence[str], value: str, removed: str, columns: Sequence[str] = STAMP) -> DataFrame:
    """Per map entry the last write, without entries whose last write removes them."""
    last = writes.groupBy(*keys).agg(F.max_by(F.struct(value, removed), F.struct(*columns, removed, value)).alias("_v"))
    return last.where(~F.col(f"_v.{removed}")).select(*keys, f"_v.{value}")


def mv_merge(writes: DataFrame, key: str, value: str, node: str, physical: str, logical: str) -> DataFrame:
    """Values that no other node's later stamp dominates.

    A value is dominated if another node has written later; so what survives is each
    key's greatest (time, count), and that node's own earlier ones are superseded.
    """
    latest = writes.groupBy(key, node).agg(F.max(F.struct(physical, logical, value)).alias("_w"))
    top = latest.groupBy(key).agg(F.max(F.struct(f"_w.{physical}", f"_w.{logical}")).alias("_top"))
    kept = latest.join(top, key).where(F.struct(f"_w.{physical}", f"_w.{logical}") == F.col("_top"))
    return kept.select(key, node, F.col(f"_w.{value}").alias(value))


def orset_merge(adds: DataFrame, removes: DataFrame | None, key: str, element: str, node: str, count: str) -> DataFrame:
    """Elements with a dot that was added and not observed as removed; the number of such dots."""
    dots = adds.select(key, element, node, count).distinct()
    if removes is not None:
        dots = dots.join(removes.select(key, element, node, count), [key, element, node, count], "left_anti")
    return dots.groupBy(key, element).agg(F.count("*").alias("dots"))


def orset_contains(merged: DataFrame, asked: DataFrame, key: str, element: str) -> DataFrame:
    """``asked`` with ``present``: whether the merged set has the element."""
    return asked.join(merged.select(key, element).distinct().withColumn("_in", F.lit(True)), [key, element], "left").withColumn("present", F.coalesce("_in", F.lit(False))).drop("_in")


def ormap_merge(adds: DataFrame, removes: DataFrame, key: str, element: str, node: str, count: str, value: str, columns: Sequence[str] = STAMP) -> DataFrame:
    """An observed-remove map: entries are kept like set elements, and each holds its last write's value."""
    kept = orset_merge(adds, removes, key, element, node, count).select(key, element)
    last = adds.groupBy(key, element).agg(F.max_by(value, F.struct(*columns, value)).alias(value))
    return kept.join(last, [key, element])


def delta(writes: DataFrame, since: tuple[int, int]) -> DataFrame:
    """Writes after a stamp."""
    return writes.where(F.struct("physical", "logical") > F.struct(F.lit(since[0]).cast("long"), F.lit(since[1]).cast("int")))


def merge_statistics(stats: DataFrame) -> DataFrame:
    """Combined statistics of many merges: the sums of their fields."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats.columns])
