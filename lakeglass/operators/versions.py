"""Versions, snapshots, diffs and the set operations between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, content: str, position: str | None = None) -> DataFrame:
    """Full outer comparison of two manifests: ``key, change`` and both contents.

    Changes: added, removed, modified, moved (same content, other ``position``), same.
    """
    fields = [content] + ([position] if position else [])
    a = old.select(F.col(key).alias("_k"), *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("_old"))
    b = new.select(F.col(key).alias("_l"), *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
    change = change.when(~F.col(f"old_{content}").eqNullSafe(F.col(f"new_{content}")), "modified")
    if position:
        change = change.when(~F.col(f"old_{position}").eqNullSafe(F.col(f"new_{position}")), "moved")
    both = a.join(b, a["_k"] == b["_l"], "full_outer")
    return both.select(F.coalesce("_k", "_l").alias(key), change.otherwise("same").alias("change"), *[f"{side}_{f}" for f in fields for side in ("old", "new")])


def diff_summary(changes: DataFrame) -> DataFrame:
    """Counts per change and the share that stayed (1 when there is nothing)."""
    same = F.count_if(F.col("change").isin("same", "moved"))
    return changes.agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "same")],
        F.coalesce(F.try_divide(same.cast("double"), F.count("*").cast("double")), F.lit(1.0)).alias("dedup_ratio"),
    )


def invert(changes: DataFrame) -> DataFrame:
    """The opposite delta: added and removed change places."""
    swapped = changes.withColumn("change", F.when(F.col("change") == "added", "removed").when(F.col("change") == "removed", "added").otherwise(F.col("change")))
    names = {c: ("new_" + c[4:] if c.startswith("old_") else "old_" + c[4:] if c.startswith("new_") else c) for c in changes.columns}
    return swapped.select(*[F.col(c).alias(names[c]) for c in changes.columns])


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def as_of(versions: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, deleted: Column) -> DataFrame:
    """The newest live version of every key among those with ``at`` true (delete markers are skipped)."""
    live = versions.where(at & ~deleted)
    row = F.struct(*[c for c in versions.columns if c not in keys])
    return live.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, fact_time: str, version_time: str, value: str, tie: str) -> DataFrame:
    """Each fact with the latest version at or before it, by one merged and ordered pass.

    Facts and versions are merged and sorted by key and time, and the last version is
    carried forward, so no pairs of the two are ever formed.
    """
    f = facts.select(F.col(key).alias("_k"), F.col(fact_time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_f"), F.lit(None).cast(versions.schema[value].dataType).alias("_v"), F.col(tie).cast("long").alias("_tie"))
    v = versions.select(F.col(key).alias("_k"), F.col(version_time).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(f.schema["_f"].dataType).alias("_f"), F.col(value).alias("_v"), F.lit(0).cast("long").alias("_tie"))
    w = Window.partitionBy("_k").orderBy("_t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    merged = f.unionByName(v).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return merged.where("_kind = 1").select("_f.*", F.col("_last").alias(f"asof_{value}"))


def with_neighbours(versions: DataFrame, keys: Sequence[str], order: Sequence[Column], version: str) -> DataFrame:
    """``is_latest`` and the previous version of every version; ``order`` is newest first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return versions.withColumn("is_latest", F.row_number().over(w) == 1).withColumn("previous", F.lead(version).over(w))


def prune(versions: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int, protected: Column | None = None) -> DataFrame:
    """Versions that pruning to the newest ``keep`` removes; protected ones stay and do not count."""
    mine = versions if protected is None else versions.where(~protected)
    return mine.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") > keep).drop("_rn")


def history(versions: DataFrame, version: str, parent: str, start: int) -> DataFrame:
    """The chain of parents from ``start``, by a recursive query: ``version, depth``."""
    return versions.sparkSession.sql(
        f"""WITH RECURSIVE chain(version, parent, depth) AS (
              SELECT {version}, {parent}, 0 FROM {{versions}} WHERE {version} = {int(start)}
              UNION ALL
              SELECT v.{version}, v.{parent}, c.depth + 1 FROM {{versions}} v JOIN chain c ON v.{version} = c.parent)
            SELECT version, depth FROM chain""",
        versions=versions,
    )


def latest_snapshot(snapshots: DataFrame, bucket: str, created: str, snapshot: str, active: Column) -> DataFrame:
    return snapshots.where(active).groupBy(bucket).agg(F.max_by(snapshot, F.struct(created, snapshot)).alias(snapshot))


def missing_numbers(received: DataFrame, keys: Sequence[str], number: str, total: str) -> DataFrame:
    """Numbers of ``0 .. total - 1`` that were not received."""
    wanted = received.groupBy(*keys).agg(F.max(total).alias("_total")).where("_total > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_total").cast("long") - 1)).alias(number))
    return wanted.join(received.select(*keys, F.col(number).cast("long").alias(number)).distinct(), [*keys, number], "left_anti")


def overlay(base: DataFrame, changes: DataFrame, key: str, value: str, tombstone: str) -> DataFrame:
    """A clone's content: its own writes over the base, without what it deleted."""
    c = changes.select(F.col(key).alias("_k"), F.col(value).alias("_value"), F.col(tombstone).alias("_gone"))
    both = base.select(key, value).join(c, F.col(key) == F.col("_k"), "full_outer")
    return both.where(~F.coalesce("_gone", F.lit(False))).select(F.coalesce(key, "_k").alias(key), F.when(F.col("_k").isNotNull(), F.col("_value")).otherwise(F.col(value)).alias(value))


def first_seen(items: DataFrame, item: str, order: Sequence[str]) -> DataFrame:
    """Items without repeats, in order of their first appearance."""
    first = items.groupBy(item).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(item, F.col("_first.*"))


def commit(log: DataFrame, manifest: DataFrame, chunk: str, message: str | None = None) -> DataFrame:
    """The version log with one more version: ``version, parent, n_chunks, root, message``.

    The root is a hash of the sorted distinct chunks' hash, so equal contents have equal roots.
    """
    summary = manifest.select(chunk).distinct().agg(F.count("*").alias("n_chunks"), F.sha2(F.concat_ws(",", F.sum(F.crc32(F.col(chunk).cast("string").cast("binary"))).cast("string"), F.bit_xor(F.xxhash64(chunk)).cast("string")).cast("binary"), 256).alias("root"))
    last = log.agg(F.max("version").alias("parent"))
    one = summary.withColumn("_one", F.lit(1)).join(last.withColumn("_one", F.lit(1)), "_one")
    new = one.select((F.coalesce("parent", F.lit(0)) + 1).cast("bigint").alias("version"), F.col("parent").cast("bigint").alias("parent"), "n_chunks", "root", F.lit(message).cast("string").alias("message"))
    return log.unionByName(new)


def required(manifests: DataFrame, version: str, wanted: int, chunk: str) -> DataFrame:
    """Distinct chunks of one version."""
    return manifests.where(F.col(version) == wanted).select(chunk).distinct()


def apply_locations(locations: DataFrame, added: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Locations after a batch of additions and one of removals, without repeats."""
    return locations.select(*keys).unionByName(added.select(*keys)).distinct().join(removed.select(*keys), list(keys), "left_anti")


def members(items: DataFrame, obj: str, member: str) -> DataFrame:
    """Sorted distinct members of every object."""
    return items.groupBy(obj).agg(F.array_sort(F.collect_set(member)).alias("members"))


def with_tag(models: DataFrame, tags: str, tag: str) -> DataFrame:
    return models.where(F.array_contains(F.col(tags), tag))
