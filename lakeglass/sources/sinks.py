"""Sinks: CSV and JSON text, Prometheus exposition, event fan-out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_field(value: Column, delimiter: str = ",") -> Column:
    """Text of a value for CSV: quoted where it holds the delimiter, a quote or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    special = F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: Sequence[str] | None = None, delimiter: str = ",") -> DataFrame:
    """One CSV record per row, in the order of ``columns``."""
    return df.select(F.concat_ws(delimiter, *[csv_field(F.col(f"`{c}`"), delimiter) for c in columns or df.columns]).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def prometheus(counters: DataFrame | None = None, histograms: DataFrame | None = None) -> DataFrame:
    """Exposition lines.

    ``counters``: ``name, kind, value``.  ``histograms``: ``name, buckets
    array<struct<le,count>>, sum, count`` with cumulative bucket counts.
    """
    out: DataFrame | None = None
    if counters is not None:
        kind = F.concat_ws(" ", F.lit("# TYPE"), "name", "kind")
        out = counters.select(F.explode(F.array(kind, F.concat_ws(" ", "name", F.col("value").cast("string")))).alias("value"))
    if histograms is not None:
        bucket = F.transform("buckets", lambda b: F.concat(F.col("name"), F.lit('_bucket{le="'), b["le"].cast("string"), F.lit('"} '), b["count"].cast("string")))
        tail = F.array(
            F.concat(F.col("name"), F.lit('_bucket{le="+Inf"} '), F.col("count").cast("string")),
            F.concat(F.col("name"), F.lit("_sum "), F.col("sum").cast("string")),
            F.concat(F.col("name"), F.lit("_count "), F.col("count").cast("string")),
        )
        lines = histograms.select(F.explode(F.concat(F.array(F.concat_ws(" ", F.lit("# TYPE"), "name", F.lit("histogram"))), bucket, tail)).alias("value"))
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        raise ValueError("nothing to export")
    return out


def metrics_json(snapshot: DataFrame) -> DataFrame:
    """One JSON object per metric, in fields ``name, kind, value, count``; absent ones are left out."""
    return snapshot.select(F.to_json(F.struct("name", "kind", "value", "count")).alias("value"))


def fan_out(routed: DataFrame, targets: dict[str, Callable[[DataFrame], None]]) -> None:
    """Hand every target the events routed to it (``destination`` names the target).

    Works on a batch, or as the function of ``foreachBatch``; what was routed is
    computed once for all targets.
    """
    routed = routed.persist()
    try:
        for name, write in targets.items():
            write(routed.where(F.col("destination") == name))
    finally:
        routed.unpersist()


def write_archive(objects: DataFrame, path: str, content: str, folder: str, target: int = 65_536) -> None:
    """Write objects as an archive: cut by content, hashed and compressed chunks, and an index of files.

    Chunks are numbered file by file over the whole archive, by ranges that are counted
    first; see :mod:`lakeglass.sources.readers` for the layout.
    """
    from collections.abc import Iterator
    import zlib

    import pandas as pd

    from lakeglass.functions.content import monotone_chunks
    from lakeglass.operators.numbering import number_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["_data"], strict=True):
                data = bytes(raw) if raw is not None else b""
                cuts = monotone_chunks(data, target)
                if cuts:
                    yield pd.DataFrame({"path": [name] * len(cuts), "part": range(len(cuts)), "size": [n for _, n in cuts], "packed": [zlib.compress(data[o : o + n], 3) for o, n in cuts], "raw": [data[o : o + n] for o, n in cuts]})

    source = objects.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("_data"))
    cut = source.mapInPandas(run, "path string, part int, size bigint, packed binary, raw binary").select("path", "part", "size", "packed", F.sha2("raw", 256).alias("hash"))
    numbered = number_rows(cut, ["path", "part"], "index")
    numbered.select("index", "hash", "size", "packed", "path").write.mode("overwrite").parquet(f"{folder}/chunks")
    ranges = objects.sparkSession.read.parquet(f"{folder}/chunks").groupBy("path").agg(F.min("index").alias("chunk_start"), (F.max("index") + 1).alias("chunk_end"))
    data = F.coalesce("_data", F.unhex(F.lit("")))
    files = source.select("path", F.octet_length(data).cast("bigint").alias("size"), F.sha2(data, 256).alias("hash")).join(ranges, "path", "left")
    zero = F.lit(0).cast("bigint")
    files.select("path", "size", F.coalesce("chunk_start", zero).alias("chunk_start"), F.coalesce("chunk_end", zero).alias("chunk_end"), "hash").write.mode("overwrite").parquet(f"{folder}/files")
