"""Chunk registries: exact and block deduplication, reference counts, collection of garbage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.operators.metrics import ratio


def content_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def fixed_blocks(objects: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Fixed-size blocks of a text: ``key, block, content``; an empty text has none."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("block"), F.substring(F.col(text), i * size + 1, F.lit(size)).alias("content"))))
    return objects.select(key, F.explode(blocks).alias("_b")).select(key, "_b.block", "_b.content")


def registry(chunks: DataFrame, hash_: str, size: Column, compressed: Column | None = None) -> DataFrame:
    """One row per distinct chunk: size, compressed size (else the size), references."""
    comp = size if compressed is None else F.coalesce(compressed, size)
    return chunks.groupBy(hash_).agg(F.max(size).alias("size"), F.max(comp).alias("compressed"), F.count("*").alias("refs"))


def registry_stats(reg: DataFrame) -> DataFrame:
    bytes_, comp, refs = F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("compressed"), F.lit(0)), F.coalesce(F.sum("refs"), F.lit(0))
    return reg.agg(
        F.count("*").alias("chunks"), bytes_.alias("bytes"), refs.alias("refs"), F.count_if(F.col("refs") == 0).alias("unreferenced"),
        ratio(refs, F.count("*"), 0.0).alias("avg_refs"), ratio(comp, bytes_, 1.0).alias("compression_ratio"),
    )


def registration(chunks: DataFrame, hash_: str, order: Sequence[str], size: Column) -> DataFrame:
    """New and duplicate chunks and bytes when chunks arrive in ``order``, and the share saved."""
    per = chunks.groupBy(hash_).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.min_by(size, F.struct(*order)).alias("first_bytes"))
    new, dup = F.coalesce(F.sum("first_bytes"), F.lit(0)), F.coalesce(F.sum(F.col("bytes") - F.col("first_bytes")), F.lit(0))
    return per.agg(F.count("*").alias("new_chunks"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_chunks"), new.alias("new_bytes"), dup.alias("duplicate_bytes"), ratio(dup, new + dup, 0.0).alias("dedup_ratio"))


def known(chunks: DataFrame, reg: DataFrame, hash_: str) -> DataFrame:
    """Chunks that the registry has already."""
    return chunks.join(reg.select(hash_), hash_, "left_semi")


def unreferenced(reg: DataFrame, references: DataFrame, hash_: str) -> DataFrame:
    return reg.join(references.select(hash_), hash_, "left_anti")


def unregister(references: DataFrame, version: str, gone: Column, hash_: str) -> DataFrame:
    """Chunks that lose their last reference when the versions ``gone`` are dropped."""
    return references.where(gone).select(hash_).distinct().join(references.where(~gone).select(hash_), hash_, "left_anti")


def collectable(reg: DataFrame, references: DataFrame, hash_: str, age: Column, min_age: int, batch: int) -> DataFrame:
    """Unreferenced chunks old enough to collect, oldest first, one batch."""
    return unreferenced(reg.where(age >= min_age), references, hash_).orderBy(age.desc(), hash_).limit(batch)


def reassemble(chunks: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Objects from their chunks in order, with their hash for the integrity check."""
    parts = F.array_sort(F.collect_list(F.struct(order, content)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[content]), "").alias("text")).withColumn("hash", content_hash(F.col("text")))


def store_ratio(stored: Column, saved: Column) -> Column:
    """Stored over stored plus saved, 1 when empty."""
    return ratio(stored, stored + saved, 1.0)


def duplicates(objects: DataFrame, key: str, hash_: str) -> DataFrame:
    """Every object with the first one of equal content."""
    return objects.withColumn("first_key", F.min(key).over(Window.partitionBy(hash_)))


def keyed_hash(key: str, data: Column) -> Column:
    """A hash that only holders of the key can make: the nested construction over SHA-256, with the key padded to a block."""
    padded = key.encode().ljust(64, b"\0")
    if len(padded) > 64:
        raise ValueError("a key has at most 64 bytes")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data.cast("binary")), 256))), 256)


def allocate(blocks: DataFrame, checksum: str, data: str, order: Sequence[str], inline: int) -> DataFrame:
    """How every block is stored: ``inline`` when short, ``new`` for the first of its checksum, else ``shared``."""
    size = F.octet_length(F.col(data))
    first = F.row_number().over(Window.partitionBy(checksum, size <= inline).orderBy(*order)) == 1
    return blocks.withColumn("stored", F.when(size <= inline, "inline").when(first, "new").otherwise("shared"))


def blind_lookup(tokens: DataFrame, index: DataFrame, token: str) -> DataFrame:
    """Each token with its reference, null where the index has none; the data behind a token stays unknown."""
    return tokens.join(index, token, "left")
