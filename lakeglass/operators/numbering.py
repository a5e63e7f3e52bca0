"""Global row numbers without a single task that sorts everything."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint, in the folder that the cluster names if it does."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def number_rows(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Number all rows from 0 in ``order``.

    Rows are dealt by ranges of the order, ranges are counted, and each range starts
    where the one before ends.  Rows that tie in ``order`` share a range, so a total
    order is wanted.
    """
    ranged = stable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_row", within).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_row")).drop("_range", "_row", "_start")
