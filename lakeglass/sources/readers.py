"""Readers: CSV and JSON with per-cell types, Parquet, whole objects, byte ranges, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def infer_cell(text: Column) -> Column:
    """Type of one CSV cell, as a variant: integer, finite double, boolean, null if empty, else text."""
    number = text.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))) & text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull(), F.to_variant_object(F.array(text.try_cast("bigint"))))
        .when(finite, F.to_variant_object(F.array(number)))
        .when(F.lower(text).isin("true", "false"), F.to_variant_object(F.array(F.lower(text) == "true")))
        .when(F.length(text) > 0, F.to_variant_object(F.array(text)))
    )


def read_csv(spark: SparkSession, path: str, *, header: str = "USE", delimiter: str = ",", typed: bool = True) -> DataFrame:
    """Read CSV; ``header`` is USE (names), IGNORE (skipped) or NONE (``_1``, ``_2``, ...).

    Short rows are filled with nulls and surplus cells dropped.  ``typed`` gives every
    cell its own type (variant columns); otherwise cells are text.
    """
    df = spark.read.csv(path, sep=delimiter, header=header in ("USE", "IGNORE"), mode="PERMISSIVE", enforceSchema=False, escape='"')
    if header != "USE":
        df = df.toDF(*[f"_{i + 1}" for i in range(len(df.columns))])
    if not typed:
        return df
    return df.select(*[F.try_variant_get(infer_cell(F.col(f"`{c}`")), "$[0]", "variant").alias(c) for c in df.columns])


def read_json(spark: SparkSession, path: str, *, document: bool = False, schema: str | None = None) -> DataFrame:
    """Read JSON lines, or one document per file whose top-level array is one row per element.

    A line that is no JSON fails the read.  Values that are no objects become
    ``{"_1": value}``.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        return reader.schema(schema).option("multiLine", document).json(path)
    return reader.option("multiLine", document).json(path)


def read_json_variant(spark: SparkSession, path: str, *, document: bool = False) -> DataFrame:
    """JSON rows with their own types, as one variant column ``row``."""
    text = spark.read.text(path, wholetext=document).where(F.length(F.trim("value")) > 0)
    value = F.parse_json("value")
    rows = text.select(value.alias("v"))
    if document:
        is_list = F.schema_of_variant("v").startswith("ARRAY")
        listed = F.when(is_list, F.variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
        rows = rows.select(F.explode(listed).alias("v"))
    wrapped = F.parse_json(F.concat(F.lit('{"_1":'), F.to_json("v"), F.lit("}")))
    return rows.select(F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")).otherwise(wrapped).alias("row"))


def read_parquet(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Read Parquet; with ``fields`` only those that exist, so that the others are never read."""
    df = spark.read.parquet(path)
    return df if fields is None else df.select(*[f for f in fields if f in df.columns])


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Whole objects: ``key, size, last_modified, content``, folders walked."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), "content")


def scan_range(content: Column, start: int | None, end: int | None) -> Column:
    """Bytes ``[start, end)`` of an object, clamped to it; not aligned to records."""
    begin = max(0, start or 0)
    stop = F.octet_length(content) if end is None else F.least(F.lit(end), F.octet_length(content))
    return F.substring(content, F.lit(begin + 1), F.greatest(stop - begin, F.lit(0)))


def total_size(objects: DataFrame) -> DataFrame:
    """Files and bytes of a walk."""
    return objects.agg(F.count("*").alias("n_objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def list_objects(catalog: DataFrame, *, prefix: str = "", start_after: str | None = None, max_keys: int = 1000) -> DataFrame:
    """A page of a listing: keys under ``prefix`` after ``start_after``, in order.

    ``is_truncated`` says whether more keys follow; the prefix test reaches the scan.
    """
    keys = catalog.where(F.col("key").startswith(prefix)) if prefix else catalog
    if start_after is not None:
        keys = keys.where(F.col("key") > start_after)
    page = keys.orderBy("key").limit(max_keys + 1).withColumn("_n", F.expr("row_number() over (order by key)"))
    return page.withColumn("is_truncated", F.expr(f"max(_n) over () > {max_keys}")).where(F.col("_n") <= max_keys).drop("_n")


def common_prefixes(catalog: DataFrame, *, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """Keys rolled up at the first delimiter after ``prefix``, with counts and bytes."""
    rest = F.expr(f"substring(key, {len(prefix) + 1})")
    at = F.instr(rest, delimiter)
    rolled = F.when(at > 0, F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))).otherwise(F.col("key"))
    return catalog.where(F.col("key").startswith(prefix)).groupBy(rolled.alias("common_prefix")).agg(F.count("*").alias("n_keys"), F.sum("size").alias("bytes"))


def list_buckets(catalog: DataFrame, bucket: str = "bucket") -> DataFrame:
    return catalog.select(bucket).distinct()


# Archives ---------------------------------------------------------------------------
#
# An archive is a folder of two Parquet tables: ``files`` (path, size, first chunk, end
# chunk, hash of the whole) and ``chunks`` (index, hash, size, compressed content).


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of an archive: ``path, size, chunk_start, chunk_end, hash``."""
    return spark.read.parquet(f"{folder}/files")


def archive_chunk(spark: SparkSession, folder: str, index: int) -> DataFrame:
    """One chunk: ``index, hash, size, content`` (decompressed); the index prunes the scan."""
    return _unpacked(spark.read.parquet(f"{folder}/chunks").where(F.col("index") == index))


def archive_extract(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """Files with their content, ``path, content, intact``: chunks in order, and whether the hash agrees."""
    files = archive_files(spark, folder)
    files = files if path is None else files.where(F.col("path") == path)
    wanted = files.where("chunk_end > chunk_start").withColumn("index", F.explode(F.sequence("chunk_start", F.col("chunk_end") - 1)))
    parts = wanted.join(_unpacked(spark.read.parquet(f"{folder}/chunks")).select("index", "content"), "index")
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", F.hex("content").alias("x")))), lambda c: c["x"]), ""))
    built = parts.groupBy("path").agg(whole.alias("content"))
    content = F.coalesce("content", F.unhex(F.lit("")))
    return files.join(built, "path", "left").select("path", content.alias("content"), (F.sha2(content, 256) == F.col("hash")).alias("intact"))


def archive_stats(spark: SparkSession, folder: str) -> DataFrame:
    """``files, bytes, chunks, stored``: what the archive holds, and what its chunks take."""
    files = archive_files(spark, folder).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.lit(1).alias("_one"))
    chunks = spark.read.parquet(f"{folder}/chunks").agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length("packed")), F.lit(0)).alias("stored"), F.lit(1).alias("_one"))
    return files.join(chunks, "_one").drop("_one")


def _unpacked(chunks: DataFrame) -> DataFrame:
    from collections.abc import Iterator
    import zlib

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"index": batch["index"], "hash": batch["hash"], "size": batch["size"], "content": [zlib.decompress(p) for p in batch["packed"]]})

    return chunks.select("index", "hash", "size", "packed").mapInPandas(run, "index bigint, hash string, size bigint, content binary")
