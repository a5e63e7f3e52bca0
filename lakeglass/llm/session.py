"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeglass.llm.textbatch import release, tidy

#: Bytes of one row of a fitted model on its way to the driver.
MODEL_PART = 4_000_000


#: Rows of an Arrow batch where results are materialised; JVM and worker each hold a batch or two for every task.
BATCH_ROWS = 2000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made inside send Arrow batches of at most ``BATCH_ROWS`` rows; the session is left as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure reliable checkpoints have a folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only where it
    is unset (tests, one machine) a folder of our own is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint that outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage through a table written to the shared checkpoint folder and read again.

    Unlike a checkpoint it carries no inferred constraints along, which grow from round
    to round of an iteration, and Spark knows its size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Keys up to this many (16 bytes each) are broadcast to be joined with.
BROADCAST_KEYS = 1_000_000


def small_keys(keys: DataFrame) -> DataFrame:
    """``keys``, materialised, and marked for broadcast if they are counted to be few; else joined by shuffle."""
    keys = materialise(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of a shared store, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_sample(candidates: DataFrame, group: str, bounds: dict[Any, tuple[int, int]] | tuple[int, int], rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The first rows of each group by ``h``, up to a number of rows and of bytes of ``text``.

    ``candidates`` holds ``key``, ``group``, ``h`` and ``text``, already thinned to
    about the number wanted; equal keys count once.  ``bounds`` are (rows, bytes), for
    each group or for all.  What is chosen is decided without the texts, which are
    fetched from ``rows`` by ``key`` afterwards.  A row is taken if those before it
    leave room, so the bytes end at most one text beyond their bound.
    """
    one = candidates.select(*key, group, "h", F.octet_length("text").cast("long").alias("_bytes")).distinct()
    order = Window.partitionBy(group).orderBy("h", *key)
    ranked = one.withColumn("_n", F.row_number().over(order)).withColumn("_before", F.sum("_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    if isinstance(bounds, tuple):
        fits = (F.col("_n") <= bounds[0]) & (F.coalesce("_before", F.lit(0)) < bounds[1])
    else:
        fits = F.lit(False)
        for value, (n, size) in bounds.items():
            fits = fits | ((F.col(group) == value) & (F.col("_n") <= n) & (F.coalesce("_before", F.lit(0)) < size))
    chosen = ranked.where(fits).select(*key, group, "h")
    return rows.join(F.broadcast(chosen), list(key)).dropDuplicates([*key, group])  # size: the bounds


def fit_remotely(rows: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """``fit`` of all ``rows`` (a bounded sample) in one task of an executor; only the model travels here."""
    schema = rows.schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        model = fit(pa.Table.from_batches(held).rename_columns(names))
        held.clear()
        release()
        data = pickle.dumps(model)
        del model
        for i in range(0, len(data), MODEL_PART):
            yield pa.RecordBatch.from_arrays([pa.array([i // MODEL_PART], pa.int32()), pa.array([data[i : i + MODEL_PART]], pa.binary())], names=["part", "data"])

    with small_batches(rows.sparkSession):
        found = sorted((r["part"], r["data"]) for r in rows.repartition(1).mapInArrow(tidy(run), "part int, data binary").collect())
    if found:
        return pickle.loads(b"".join(bytes(d) for _, d in found))
    from pyspark.sql.pandas.types import to_arrow_schema

    return fit(to_arrow_schema(schema).empty_table())
