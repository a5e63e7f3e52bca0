"""Sharding by a k-d tree over document metadata (DataFrame operations only).

The tree is grown level by level, all nodes of a level at once, and no node ever
leaves the executors: rows carry the node they are in.  Every dimension has at most
``BINS`` places, in the order of its values: powers of two in fine steps for sizes,
the rank of the value among its distinct values for the others.  At each level one
histogram of all dimensions gives every node its widest dimension (the range of the
places, relative to that of the root) and the place where its weighted median lies.
Rows at that place, a third of all if need be, are cut along a hash: ``PASSES``
further histograms, each over the hash values of the one cell that holds the cut,
find it to within ``2 ** -(STEP * PASSES)`` of the cell.  So a level takes a fixed
number of passes, whatever the values and however many nodes there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.llm.session import written
from lakeglass.operators.numbering import number_rows

BINS = 4096
#: Bits of the hash that one pass looks at, and passes; the last tells equal rows apart.
STEP, PASSES = 16, 2
#: Steps of the sizes' places per power of two.
FINE = 64
#: Distinct values numbered by one task, and broadcast; nodes whose cuts are broadcast.
FEW_VALUES, FEW_NODES = 100_000, 100_000
#: Rows numbered by one task when slots are dealt.
SLOT_ROWS = 100_000


def _ordinals(rows: DataFrame, column: str) -> DataFrame:
    """``column`` and ``place``: the rank of every distinct value, scaled to ``BINS`` places if there are more."""
    values = written(rows.select(column).distinct())
    n = values.count()
    if n <= FEW_VALUES:
        ranked = values.withColumn("_at", F.row_number().over(Window.orderBy(column)) - 1)
    else:
        ranked = number_rows(values, [column], "_at")
    place = ranked.select(F.col(column), (F.col("_at") if n <= BINS else F.expr(f"_at * {BINS} div {n}")).cast("int").alias("place"))
    return F.broadcast(place) if n <= FEW_VALUES else place


def coordinates(docs: DataFrame, id_col: str, text_col: str, dims: tuple[str, ...]) -> DataFrame:
    """Rows ``_id, size, text_crc32, _places, _hash``: places by dimension, and the hash that settles ties."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    known = [c for c in dims if c in docs.columns]
    fine = lambda x: F.floor(F.log2(x.cast("double")) * FINE).cast("int")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        fine(size).alias("_bytes"),
        fine(F.length(text) + 1).alias("_chars"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_v{i}") for i, c in enumerate(known)],
    )
    rows = written(rows.withColumn("_row", F.xxhash64(F.monotonically_increasing_id())))
    for i in range(len(known)):
        rows = rows.join(_ordinals(rows, f"_v{i}").withColumnRenamed("place", f"_p{i}"), f"_v{i}")
    bits = (1 << STEP) - 1
    tie = F.xxhash64("_id", "text_crc32", "size")
    steps = [F.shiftrightunsigned(tie if i < PASSES - 1 else F.col("_row"), 64 - STEP * (i + 1)).bitwiseAND(F.lit(bits)).cast("int") for i in range(PASSES)]
    return written(rows.select("_id", "size", "text_crc32", F.array("_bytes", "_chars", *[f"_p{i}" for i in range(len(known))]).alias("_places"), F.array(*steps).alias("_hash")))


def _crossing(cells: DataFrame, key: str, found: str) -> DataFrame:
    """Of every node's cells ``_node, key, _w, _before, _target`` the one where the sum reaches the target."""
    upto = Window.partitionBy("_node").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    whole = cells.withColumn("_sum", F.col("_before") + F.sum("_w").over(upto)).withColumn("_last", F.max(key).over(Window.partitionBy("_node")))
    at = whole.where((F.col("_sum") >= F.col("_target")) | (F.col(key) == F.col("_last")))
    return at.groupBy("_node").agg(F.min_by(F.struct(F.col(key).alias(found), (F.col("_sum") - F.col("_w")).alias("before"), F.col("_sum").alias("upto"), F.col("_target").alias("target")), key).alias("c")).select("_node", "c.*")


def grow(meta: DataFrame, n_shards: int) -> DataFrame:
    """``meta`` (columns ``size``, ``_places``, ``_hash``) with ``shard``."""
    rows = meta.withColumn("_node", F.lit(0)).withColumn("_k", F.lit(n_shards))
    n_dims = F.size("_places")
    each = F.explode(F.transform(F.sequence(F.lit(0), n_dims - 1), lambda d: F.struct(d.alias("dim"), F.get("_places", d).alias("place"))))
    span = None
    for level in range(math.ceil(math.log2(n_shards)) if n_shards > 1 else 0):
        few = F.broadcast if 1 << level <= FEW_NODES else (lambda df: df)
        mine = rows.where("_k > 1")
        bins = mine.select("_node", "_k", "size", each.alias("e")).groupBy("_node", "_k", "e.dim", "e.place").agg(F.sum("size").alias("_w")).repartition("_node")  # a node has BINS rows a dimension at most
        per = bins.groupBy("_node", "_k", "dim").agg((F.max("place") - F.min("place")).alias("range"), F.sum("_w").alias("_all"))
        if span is None:
            # One number for each dimension: the root's ranges.
            root = {r["dim"]: r["range"] for r in per.collect()}
            if not root:
                return rows.withColumn("shard", F.lit(0)).drop("_node", "_k")
            span = F.array(*[F.lit(float(max(1, root[d]))) for d in sorted(root)])
        width = F.struct(F.col("range") / F.get(span, F.col("dim")), (-F.col("dim")).alias("order"))
        widest = per.groupBy("_node", "_k").agg(F.max_by("dim", width).alias("dim"), F.max("_all").alias("_all"))
        target = F.col("_all") * F.floor(F.col("_k") / 2) / F.col("_k")
        cells = bins.join(few(widest.select("_node", "dim", target.alias("_target"))), ["_node", "dim"]).withColumn("_before", F.lit(0).cast("long"))
        # One row for each node; materialised, since what follows uses it more than once.
        cut = written(_crossing(cells, "place", "place").join(widest.select("_node", "dim"), "_node"))
        inside = mine.join(few(cut.select("_node", "dim", F.col("place").alias("_cut"), "before", "target")), "_node").where(F.get("_places", F.col("dim")) == F.col("_cut"))
        found = cut.select("_node", "dim", F.col("place").alias("_cut"))
        for i in range(PASSES):
            cells = inside.groupBy("_node", F.get("_hash", F.lit(i)).alias("h")).agg(F.sum("size").alias("_w"), F.max("before").alias("_before"), F.max("target").alias("_target"))
            here = _crossing(cells, "h", f"_h{i}")
            if i < PASSES - 1:
                here = written(here)
            found = found.join(here.select("_node", f"_h{i}", *(["before", "upto", "target"] if i == PASSES - 1 else [])), "_node")
            if i < PASSES - 1:
                narrow = here.select("_node", f"_h{i}", F.col("before").alias("_b"))
                inside = inside.join(few(narrow), "_node").where(F.get("_hash", F.lit(i)) == F.col(f"_h{i}")).withColumn("before", F.col("_b")).drop("_b", f"_h{i}")
        # The last cell goes to the side that it makes come out closer.
        takes = (F.col("target") - F.col("before") > F.col("upto") - F.col("target")).cast("int")
        found = found.select(F.col("_node").alias("_n"), "dim", "_cut", F.array(*[F.col(f"_h{i}") for i in range(PASSES - 1)], F.col(f"_h{PASSES - 1}") + takes).alias("_at"))
        place = F.get("_places", F.col("dim"))
        left = (place < F.col("_cut")) | ((place == F.col("_cut")) & (F.col("_hash") < F.col("_at")))
        half = F.floor(F.col("_k") / 2).cast("int")
        there = rows.join(few(found), F.col("_node") == F.col("_n"), "left").withColumn("_left", left)
        rows = written(
            there.select(
                *meta.columns,
                F.when((F.col("_k") == 1) | F.col("_left"), F.col("_node")).otherwise(F.col("_node") + half).alias("_node"),
                F.when(F.col("_k") == 1, F.col("_k")).when(F.col("_left"), half).otherwise(F.col("_k") - half).alias("_k"),
            )
        )
    return rows.withColumnRenamed("_node", "shard").drop("_k")


def kd_shard(docs: DataFrame, *, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Deal documents into shards of near equal bytes.

    Returns one row per input row: the id, ``size`` (UTF-8 bytes plus 8),
    ``text_crc32``, ``shard``, and ``slot`` (gapless from 0 within the shard, by id in
    shards of up to ``SLOT_ROWS`` rows, in chunks of a hash in larger ones).  Give
    ``n_shards`` or ``target_bytes`` of a leaf.

    The dimensions are the size in bytes, the number of characters, and each column
    of ``dims`` that the table has.  A null text counts as empty; a null id is an id
    like any other, null metadata sort first with the empty string.  Ties are cut along
    a hash of id, text and size; rows that agree in all three, however many, are told
    apart by their place in the table, so they neither hold up a cut nor fill a task.
    A very long text is one row of its size.  An empty table gives an empty result.
    Other columns are not looked at, whatever their names.
    """
    meta = coordinates(docs, id_col, text_col, dims)
    total = meta.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("w"), F.count("*").alias("n")).first()
    if n_shards is None:
        n_shards = max(1, math.ceil(total["w"] / target_bytes))
    dealt = grow(meta, n_shards)
    # Slots: rows are numbered within chunks of a shard, and chunks start where the one before ends.
    chunks = max(1, math.ceil(total["n"] / n_shards / SLOT_ROWS))
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("_hash"), F.lit(chunks)).cast("int"))
    counts = dealt.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_chunk").orderBy("_id", "text_crc32", "size")
    return (
        dealt.withColumn("_row", F.row_number().over(within) - 1)
        .join(starts, ["shard", "_chunk"])
        .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_start") + F.col("_row")).cast("long").alias("slot"))
    )
