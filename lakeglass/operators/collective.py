"""Collective operations over ranks: each rank holds rows, and receives some.

A row is ``rank, key, value``.  What an operation hands to every rank is a join with
the ranks, and what it hands to one is a projection, so nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDUCERS = {"sum": F.sum, "max": F.max, "min": F.min, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor}


def gather(objects: DataFrame, rank: str, root: int) -> DataFrame:
    """Every rank's rows at ``root``; ``source`` is where they came from."""
    return objects.withColumnRenamed(rank, "source").withColumn(rank, F.lit(root))


def _ranks(objects: DataFrame, rank: str, size: int) -> DataFrame:
    return objects.sparkSession.range(size).select(F.col("id").cast(objects.schema[rank].dataType).alias(rank))


def broadcast(objects: DataFrame, rank: str, root: int, size: int) -> DataFrame:
    """The rows of ``root`` at every one of ``size`` ranks."""
    copies = F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: r.cast(objects.schema[rank].dataType)))
    return objects.where(F.col(rank) == root).withColumnRenamed(rank, "source").withColumn(rank, copies)


def all_gather(objects: DataFrame, rank: str, size: int) -> DataFrame:
    """Every rank's rows at every rank; ``source`` is where they came from."""
    copies = F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: r.cast(objects.schema[rank].dataType)))
    return objects.withColumnRenamed(rank, "source").withColumn(rank, copies)


def all_reduce(objects: DataFrame, rank: str, key: str, value: str, how: str, size: int) -> DataFrame:
    """The reduction of every key over all ranks, at every rank."""
    reduced = objects.groupBy(key).agg(REDUCERS[how](value).alias(value))
    copies = F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: r.cast(objects.schema[rank].dataType)))
    return reduced.withColumn(rank, copies).select(rank, key, value)


def reduce_scatter(objects: DataFrame, rank: str, key: str, value: str, how: str, size: int) -> DataFrame:
    """The reduction of every key over all ranks, each key at the rank ``key mod size``."""
    reduced = objects.groupBy(key).agg(REDUCERS[how](value).alias(value))
    return reduced.withColumn(rank, F.pmod(F.col(key), F.lit(size)).cast(objects.schema[rank].dataType)).select(rank, key, value)


def barrier_counts(objects: DataFrame, rank: str, size: int) -> DataFrame:
    """Rows that every rank holds, ranks without any included."""
    return _ranks(objects, rank, size).join(objects.groupBy(rank).agg(F.count("*").alias("n")), rank, "left").withColumn("n", F.coalesce("n", F.lit(0)))
