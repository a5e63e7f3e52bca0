"""Chunk trees and layers as tables: ``chunk, offset, size`` and a layer number.

A layer is the ordered list of an object's chunks.  Lookups by byte are range joins on
a coarse grid, so they are equi-joins; comparisons of layers are set operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of one cell of the grid that range joins meet on.
GRID = 4096


def leaf_at(chunks: DataFrame, lookups: DataFrame, key: str, offset: str, size: str, at: str) -> DataFrame:
    """The chunk that holds each byte ``at`` of an object (no row beyond its end)."""
    first, last = F.expr(f"{offset} div {GRID}"), F.expr(f"({offset} + {size} - 1) div {GRID}")
    cells = chunks.where(F.col(size) > 0).withColumn("_cell", F.explode(F.sequence(first, last)))
    wanted = lookups.withColumn("_cell", F.expr(f"{at} div {GRID}"))
    return wanted.join(cells, [key, "_cell"]).where((F.col(at) >= F.col(offset)) & (F.col(at) < F.col(offset) + F.col(size))).drop("_cell")


def affected(chunks: DataFrame, edits: DataFrame, key: str, offset: str, size: str, begin: str, end: str) -> DataFrame:
    """Chunks that overlap an edit of the bytes ``[begin, end)`` (an insertion is empty and touches the chunk it falls in)."""
    first, last = F.expr(f"{offset} div {GRID}"), F.expr(f"({offset} + {size} - 1) div {GRID}")
    cells = chunks.where(F.col(size) > 0).withColumn("_cell", F.explode(F.sequence(first, last)))
    stop = F.greatest(F.col(end), F.col(begin) + 1)
    wanted = edits.withColumn("_stop", stop).withColumn("_cell", F.explode(F.sequence(F.expr(f"{begin} div {GRID}"), F.expr(f"(_stop - 1) div {GRID}"))))
    hit = wanted.join(cells, [key, "_cell"]).where((F.col(begin) < F.col(offset) + F.col(size)) & (F.col("_stop") > F.col(offset)))
    return hit.drop("_cell", "_stop").distinct()


def tree_diff(old: DataFrame, new: DataFrame, chunk: str) -> DataFrame:
    """Chunks of either tree: ``chunk, change`` (added, removed, shared)."""
    a, b = old.select(chunk).distinct().withColumn("_a", F.lit(1)), new.select(chunk).distinct().withColumn("_b", F.lit(1))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("shared")
    return a.join(b, chunk, "full_outer").select(chunk, change.alias("change"))


def light_chunks(chunks: DataFrame, keys: Sequence[str], order: str, size: str, weight: str, least: int) -> DataFrame:
    """Chunks below ``least`` bytes that are lighter than both neighbours; the last never is.

    A chunk's weight is that of its right boundary; before the first one it is infinite.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(weight).over(w), F.lead(weight).over(w)
    marked = chunks.withColumn("_before", before).withColumn("_after", after)
    light = (F.col(size) < least) & F.col("_after").isNotNull() & (F.col("_before").isNull() | (F.col(weight) < F.col("_before"))) & (F.col(weight) < F.col("_after"))
    return marked.where(light).drop("_before", "_after")


def merge_light(chunks: DataFrame, keys: Sequence[str], order: str, size: str, weight: str, least: int) -> DataFrame:
    """One round of balancing: every light chunk joins its right neighbour, whose weight it takes.

    Two neighbours are never both light, so a round's merges do not meet.
    """
    light = light_chunks(chunks, keys, order, size, weight, least).select(*keys, order).withColumn("_light", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(order)
    marked = chunks.join(light, [*keys, order], "left").withColumn("_take", F.coalesce(F.lag("_light").over(w), F.lit(0))).withColumn("_more", F.lag(size).over(w))
    return marked.where("_light is null").withColumn(size, F.col(size) + F.when(F.col("_take") == 1, F.col("_more")).otherwise(0)).drop("_light", "_take", "_more")


def differing_bits(before: Column, after: Column, width: int = 8) -> Column:
    """Bits that differ between the bytes before a boundary, read backwards, and those after it."""
    n = F.least(F.lit(width), F.octet_length(before), F.octet_length(after))
    one = lambda data, i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")
    bits = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i <= n, F.bit_count(one(before, F.octet_length(before) - i + 1).bitwiseXOR(one(after, i)))).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b.cast("int"))


def boundary_priority(before: Column, after: Column, hash_hex: Column) -> Column:
    """Strength of a boundary: differing bits around it, plus the top byte of its hash's weight."""
    return differing_bits(before, after) + F.conv(F.substring(hash_hex, 15, 2), 16, 10).cast("int")


def weak_boundaries(chunks: DataFrame, keys: Sequence[str], order: str, size: str, priority: str, least: int) -> DataFrame:
    """Inner boundaries next to a chunk below ``least`` bytes, weakest first in ``rank``; those that merging removes."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = chunks.withColumn("_next", F.lead(size).over(w)).where(F.col("_next").isNotNull() & ((F.col(size) < least) | (F.col("_next") < least)))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(priority, order))).drop("_next")


def split_oversized(chunks: DataFrame, keys: Sequence[str], offset: str, size: str, most: int) -> DataFrame:
    """Chunks above ``most`` bytes cut into parts of at most that size."""
    n = F.ceil(F.col(size) / F.lit(most)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("_i")
    start = F.col("_i").cast("long") * most
    return chunks.select("*", parts).select(*keys, (F.col(offset) + start).alias(offset), F.least(F.lit(most).cast("long"), F.col(size) - start).alias(size))
