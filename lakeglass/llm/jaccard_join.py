"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles (64-bit hashes).  Two
documents whose sets have a Jaccard similarity of at least ``t`` share at least
``ceil(t * n)`` shingles, ``n`` being the larger size.  With all shingles in one
global order, the first ``n - ceil(t * n) + l`` of each therefore share at least
``l``.  Each document chooses its own ``l``: a longer prefix costs more tokens but
asks for more matches before a pair is verified.  The choice weighs the tokens
sent against the candidates expected from how frequent its prefix tokens are.  A
pair is a candidate if it shares at least the smaller of the two ``l``, on tokens
that leave enough of both documents: the k-th shared token, at positions i and j of
the two orders, bounds the overlap by ``k - 1 + min(n - i, m - j)``, where k - 1 is
at most the number of earlier tokens of either that any other document has.

The global order puts frequent shingles last: those that repeat among the texts
that one task holds at a time are counted over all documents, and the most frequent
of them come last, by count; all others are ordered by hash.  Any order gives the
same links.

Copies (equal sets) are one node.  While the pairs that buckets hold are many, every
document proposes a link to one hub, that of most of its buckets; once links have
joined documents into components, only pairs across components are enumerated,
since others cannot change the result.

Before sets are fetched, a candidate must pass a bitmap test: a bit set for one
document and not for the other proves a shingle that is not shared, which bounds
the overlap from above.  Bitmaps have 2 to 4 bits per shingle, so they are small
enough to send along with pairs; the sets are only made for what passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.components import connected_components
from lakeglass.llm.session import materialise
from lakeglass.llm.textbatch import WHITE, Words, blocks, mix, run_hashes, tidy

SHINGLE = 5
#: Similarity at least PERCENT / 100.
PERCENT = 80
#: The longest prefix extension a document may choose.
MAX_MATCHES = 6
#: Shingles that a task holds for counting, and the repeats among them from which one is counted.
COUNTED_TOGETHER = 2_000_000
LOCAL_REPEATS = 3
#: The most frequent shingles that come last in the order; bounds the broadcast to 2 MB.
FREQUENT = 1 << 17
#: A token that at least so many documents hold is counted by parts, so no task meets all of its rows.
HOT, HOT_PARTS = 256, 64
#: Cost of verifying a candidate, in tokens sent, for a pair of one-token documents and per token.
VERIFY_BASE, VERIFY_TOKEN = 4.0, 0.05
#: Pairs per document that are enumerated without another round of hubs.
PAIRS_PER_NODE = 4
#: Buckets up to this size have no hub.
SMALL_BUCKET = 4
#: Rounds of hubs end when one leaves more than this share of the pairs, or after so many.
WORTHWHILE, MAX_HUB_ROUNDS = 0.7, 4
#: A set of document ids is broadcast only up to this many.
BROADCAST_IDS = 1_000_000

_INSIDE = ~WHITE


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer than ``n`` words has its whole sequence as its one shingle,
    one without words has none.
    """
    words = Words(texts, _INSIDE)
    h = words.hashes()
    runs = run_hashes(h, n)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(mix(run_hashes(h[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set, as signed numbers."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5_5A5A_C3C3_3C3C)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


class Order:
    """The global order: frequent shingles last, by count; the others by hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by_token = np.argsort(tokens, kind="stable")
        self.tokens, self.counts = tokens[by_token], counts[by_token]

    def frequency(self, s: np.ndarray) -> np.ndarray:
        """Documents that hold each shingle, as far as counted; else 0."""
        if not len(self.tokens) or not len(s):
            return np.zeros(len(s), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.counts[at], 0)

    def prefix(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, int, np.ndarray]:
        """(prefix of a sorted set, matches asked for, how frequent its tokens are) with the least estimated cost."""
        n = len(s)
        need = -(-percent * n // 100)
        frequency = self.frequency(s)
        if frequency.any():
            order = np.lexsort((s, frequency))
            s, frequency = s[order], frequency[order]
        base, most = n - need, min(MAX_MATCHES, need)
        # Partners met through a token: those counted, or a few percent of one for an uncounted token.
        met = np.cumsum(np.maximum(frequency[: base + most] - 1, 0.02))
        lengths = base + np.arange(1, most + 1)
        candidates = met[lengths - 1] / np.arange(1, most + 1)
        cost = lengths + met[lengths - 1] + (VERIFY_BASE + VERIFY_TOKEN * n) * candidates
        l = int(cost.argmin()) + 1
        return s[: base + l], l, frequency[: base + l]


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each shingle's hash, in a power of two of 2 to 4 bits per shingle (64 at least)."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(size, dtype=np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_overlap(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of bitmaps (rows of words) allow the similarity; the larger are folded onto the smaller first."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] | a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] | b[:, b.shape[1] // 2 :]
    only_a, only_b = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
    common = np.minimum(na - only_a, nb - only_b)
    return 100 * common >= percent * (na + nb - common)


def _describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document (id, n, f1, f2, bits), and rows with n = -1 of shingles that repeat."""
    names = ["id", "n", "f1", "f2", "bits", "tokens", "counts"]

    def repeats(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= LOCAL_REPEATS
        none, zero = pa.array([None], pa.int64()), pa.array([0], pa.int64())
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (tokens[often].view(np.int64), counts[often])]
        return pa.RecordBatch.from_arrays([none, pa.array([-1], pa.int64()), zero, zero, pa.array([None], pa.binary()), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0
        for batch in batches:
            for begin, texts in blocks(batch.column(1)):
                sets = shingle_sets(texts)
                prints = [fingerprint(s) for s in sets]
                empty = pa.nulls(len(texts), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([f for f, _ in prints], pa.int64()),
                        pa.array([f for _, f in prints], pa.int64()),
                        pa.array([bitmap(s) for s in sets], pa.binary()),
                        empty,
                        empty,
                    ],
                    names=names,
                )
                held += sets
                n_held += sum(map(len, sets))
                if n_held >= COUNTED_TOGETHER:
                    yield repeats(held)
                    held, n_held = [], 0
        if held:
            yield repeats(held)

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(tidy(run), "id bigint, n bigint, f1 bigint, f2 bigint, bits binary, tokens array<bigint>, counts array<bigint>")


def _prefixes(docs: DataFrame, id_col: str, text_col: str, order: Order, percent: int) -> DataFrame:
    """Rows ``token, part, id, n, l, p`` of every document's prefix; ``p`` is the token's position.

    ``part`` is 0, or for hot tokens one of ``HOT_PARTS`` by the document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)  # size: 16 bytes x FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, texts in blocks(batch.column(1)):
                parts, sizes, asked, owners, often = [], [], [], [], []
                for i, s in enumerate(shingle_sets(texts)):
                    if len(s):
                        p, l, frequency = shared.value.prefix(s, percent)
                        parts.append(p)
                        often.append(frequency)
                        sizes.append(len(s))
                        asked.append(l)
                        owners.append(ids[begin + i])
                if not parts:
                    continue
                many = [len(p) for p in parts]
                owner = np.repeat(np.array(owners, dtype=np.int64), many)
                part = np.where(np.concatenate(often) >= HOT, 1 + mix(owner.view(np.uint64)) % np.uint64(HOT_PARTS), 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(parts).view(np.int64)),
                        pa.array(part.astype(np.int8)),
                        pa.array(owner),
                        pa.array(np.repeat(np.array(sizes, dtype=np.int32), many)),
                        pa.array(np.repeat(np.array(asked, dtype=np.int8), many)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in many])),
                    ],
                    names=["token", "part", "id", "n", "l", "p"],
                )

    return docs.select(F.col(id_col).cast("bigint"), text_col).where(F.col(id_col).isNotNull()).mapInArrow(tidy(run), "token bigint, part tinyint, id bigint, n int, l tinyint, p int")


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(tidy(run), "id bigint, s array<bigint>")


def _within_reach(x: str, y: str, percent: int):
    """Whether a token shared by ``x`` and ``y`` (prefixes of columns n, l, p, q) can be among the first
    ones of a similar pair, as many as the smaller ``l``; similar pairs share ``percent / (100 + percent)``
    of their sizes' sum.  ``q`` counts the earlier tokens that some other document has too.
    """
    n, m = f"{x}n", f"{y}n"
    left = f"(least({n} - {x}p, {m} - {y}p) + least({x}l - 1, {y}l - 1, {x}q, {y}q))"
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and {left} * {100 + percent} >= {percent} * ({n} + {m})")


def _may_link(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            wide = [pc.binary_length(batch.column(i)).to_numpy().astype(np.int64) for i in (4, 5)]
            ok = np.zeros(len(na), dtype=bool)
            # Pairs with bitmaps of the same two sizes are compared together.
            order = np.lexsort(wide)
            edges = np.flatnonzero((np.diff(wide[0][order]) != 0) | (np.diff(wide[1][order]) != 0)) + 1
            for rows in np.split(order, edges) if len(order) else []:
                x, y = (np.frombuffer(b"".join(batch.column(i).take(pa.array(rows)).to_pylist()), dtype=np.uint64).reshape(len(rows), -1) for i in (4, 5))
                ok[rows] = may_overlap(x, y, na[rows], nb[rows], percent)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    both = pairs.join(bits.selectExpr("id as a", "n as na", "bits as xa"), "a").join(bits.selectExpr("id as b", "n as nb", "bits as xb"), "b")
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def _verify(pairs: DataFrame, docs: DataFrame, bits: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those pairs ``a, b`` whose sets are similar enough: by bitmaps first, then by the sets."""
    pairs = materialise(_may_link(pairs, bits, percent))
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    mine = docs.select(F.col(id_col).cast("bigint").alias("_i"), F.col(text_col).alias("_x"))
    sets = materialise(_sets(mine.join(few, mine["_i"] == few["id"], "left_semi"), "_i", "_x"))
    both = pairs.join(sets.selectExpr("id as a", "s as sa"), "a").join(sets.selectExpr("id as b", "s as sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return materialise(both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct())


def jaccard_components(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles`` and ``component_id``.

    Two documents link when their shingle sets have ``100 * common >= percent *
    union``; a component's id is the smallest document id reachable by links.
    Documents with null or empty texts, or of white space only, have 0 shingles and
    are their own component.  Rows with one id are one node of the graph, whatever
    their texts; a null id is its own (null) component.  A very long text is one set
    like any other: its prefix and bitmap grow with it, and the memory needed is in
    proportion to the longest text of a batch.  An empty table gives an
    empty result, and only the two named columns are read.
    """
    spark = docs.sparkSession
    described = materialise(_describe(docs, id_col, text_col))
    rows = described.where("n >= 0").select("id", "n", "f1", "f2")
    bits = described.where("n > 0 and id is not null").select("id", "n", "bits")
    frequent = (
        described.where("n = -1")
        .select(F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
        .groupBy(F.col("t.tokens").alias("token"))
        .agg(F.sum("t.counts").alias("c"))
        .orderBy(F.desc("c"), "token")
        .limit(FREQUENT)
        .toArrow()
    )
    order = Order(frequent.column(0).to_numpy().astype(np.int64).view(np.uint64), frequent.column(1).to_numpy().astype(np.int64))

    # Copies: documents with equal sets (128-bit fingerprints) are one node, the smallest id.
    nodes = rows.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("node"))
    copies = materialise(rows.where("n > 0 and id is not null").join(nodes, ["n", "f1", "f2"]).where("id <> node").select("id", "node").distinct())

    # Tokens that at least two nodes have in their prefix. Most tokens have one document and end here.
    # Hot tokens, which have many, are counted by parts and stay in any case.
    of_token = "count(*) over (partition by token, part)"
    met = _prefixes(docs, id_col, text_col, order, percent).selectExpr("*", f"{of_token} as k").where("k > 1 or part > 0").drop("k")
    kept = met.join(copies.select("id"), "id", "left_anti").distinct()
    buckets = kept.selectExpr("*", f"{of_token} as k").where("k > 1 or part > 0").drop("k", "part")
    buckets = materialise(buckets.selectExpr("*", "cast(row_number() over (partition by id, n order by p) - 1 as int) as q"))
    n_nodes = buckets.select("id").distinct().count()

    # Links so far: those of a star around each component's smallest node.
    links = spark.createDataFrame([], "a bigint, b bigint")
    left = buckets.withColumn("c", F.col("id"))
    tried, before = None, None
    for round_ in range(MAX_HUB_ROUNDS + 1):
        # Pairs across components that enumeration would still have to look at.
        per = left.groupBy("token", "c").agg(F.count("*").alias("m"))
        mixed = per.groupBy("token").agg(F.count("*").alias("parts"), F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("square")).where("parts > 1")
        mixed = materialise(mixed.select("token", "size", ((F.col("size") * F.col("size") - F.col("square")) / 2).alias("pairs")))
        left = materialise(left.join(mixed.select("token"), "token", "left_semi"))
        pairs_left = mixed.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("p")).first()["p"]
        if round_ == MAX_HUB_ROUNDS or pairs_left <= PAIRS_PER_NODE * n_nodes or (before is not None and pairs_left > WORTHWHILE * before):
            break
        before = pairs_left
        large = left.join(mixed.where(F.col("size") > SMALL_BUCKET).select("token"), "token", "left_semi")
        # The member with fewest tokens of its own is most like the others.
        hubs = large.groupBy("token").agg(F.min_by(F.struct("id", "n", "l", "p", "q", "c"), F.struct((F.col("p") - F.col("q")) / F.col("n"), F.xxhash64("id", F.lit(round_)))).alias("hub"))
        proposed = large.join(hubs, "token").where((F.col("c") != F.col("hub.c")) & _within_reach("", "hub.", percent))
        most = proposed.groupBy("id", F.col("hub.id").alias("hub")).agg(F.count("*").alias("m")).groupBy("id").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub"))
        pairs = most.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        component = materialise(connected_components(links.unionByName(_verify(pairs, docs, bits, percent, id_col, text_col))))
        links = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
        left = left.drop("c").join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")

    # The rest: every pair across components that shares enough prefix tokens.
    one = left.select("token", F.col("id").alias("a"), *[F.col(c).alias(f"x{c}") for c in "nlpqc"])
    two = left.select("token", F.col("id").alias("b"), *[F.col(c).alias(f"y{c}") for c in "nlpqc"])
    shared = (
        one.join(two, "token")
        .where((F.col("a") < F.col("b")) & (F.col("xc") != F.col("yc")) & _within_reach("x", "y", percent))
        .groupBy("a", "b")
        .agg(F.count("*").alias("met"), F.min(F.least("xl", "yl")).alias("asked"))
        .where("met >= asked")
        .select("a", "b")
    )
    if tried is not None:
        shared = shared.join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(_verify(materialise(shared), docs, bits, percent, id_col, text_col)).unionByName(copies.selectExpr("id as a", "node as b"))
    component = connected_components(links)
    return rows.join(component, rows["id"] == component["node"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def exact_components(texts: dict[int, str | None], percent: int = PERCENT) -> dict[int, int]:
    """Brute force over all pairs, for tests on a handful of documents."""
    ids = sorted(texts)
    sets = dict(zip(ids, map(set, (s.tolist() for s in shingle_sets([texts[i] for i in ids]))), strict=True))
    parent = {i: i for i in ids}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}

