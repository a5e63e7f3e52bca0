"""Approximate nearest neighbours by multi-index hashing.

Learned orthogonal rotations turn a vector into a binary code, one bit per rotated
coordinate.  Codes are cut into substrings and each substring gets an index from
its value to the rows that hold it.  If two codes differ in at most ``r`` bits then
some substring ``j`` differs in at most ``r_j`` bits wherever the ``r_j`` add up to
``r - m + 1`` (``m`` substrings), so probing every bucket within ``r_j`` of the
query's substring retrieves every code within radius ``r``.  Retrieved rows whose
whole code lies within the radius are reranked on the original floats.

Equal vectors are one entry that lists its smallest ids, so a vector that a third
of all rows share costs no more than any other.  Entries are dealt into shards of
bounded size and queries into blocks of bounded size; every shard meets every
block, and only each pair's best entries travel on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.llm.session import materialise

#: Bits of one substring.
SUBSTRING = 16
N_ROTATIONS = 4
#: Distinct vectors that the rotations and the radius are fitted on.
SAMPLE = 4096
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
#: Share of the sample's true neighbours that must lie within the radius.
COVER = 0.985


def _normalise(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def learn_rotations(sample: np.ndarray, n_rotations: int = N_ROTATIONS, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Iterative quantisation: rotations that bring the sample near the corners of a cube.

    Each starts from another random rotation, so together they give longer codes.
    Returns (dimension, n_rotations * dimension).
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    out = []
    for _ in range(n_rotations):
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(sample.T @ np.sign(sample @ q))
            q = u @ vt
        out.append(q)
    return np.hstack(out)


@dataclass
class Coder:
    """Rotations, the radius fitted on the sample, and the vectors' dimension."""

    rotations: np.ndarray
    radius: int

    @property
    def n_bits(self) -> int:
        return -(-self.rotations.shape[1] // SUBSTRING) * SUBSTRING

    def substrings(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, substrings) of 16-bit values; missing bits at the end are 0."""
        bits = np.zeros((len(vectors), self.n_bits), dtype=np.uint8)
        bits[:, : self.rotations.shape[1]] = vectors @ self.rotations > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the codes ``a`` (rows) to the code or codes ``b``."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def fit(sample: np.ndarray, k: int) -> Coder:
    """Learn rotations, and the radius that covers the sample's own nearest neighbours.

    In the whole table neighbours are nearer than in a sample, so the radius errs
    to the wide side.
    """
    unit = _normalise(sample)
    coder = Coder(learn_rotations(unit), 0)
    codes = coder.substrings(unit)
    queries = np.arange(min(len(unit), 256))
    near = unit[queries] @ unit.T
    near[queries, queries] = -np.inf
    n = min(k, len(unit) - 1)
    if n < 1:
        coder.radius = coder.n_bits
        return coder
    top = np.argpartition(-near, n - 1, axis=1)[:, :n]
    found = np.bitwise_count(codes[queries][:, None, :] ^ codes[top]).sum(axis=2, dtype=np.int64)
    coder.radius = int(np.quantile(found, COVER, method="higher"))
    return coder


_BALLS: dict[int, np.ndarray] = {}


def ball(radius: int) -> np.ndarray:
    """All 16-bit masks of at most ``radius`` bits."""
    if radius not in _BALLS:
        masks = np.arange(1 << SUBSTRING, dtype=np.uint16)
        _BALLS[radius] = masks[np.bitwise_count(masks) <= radius]
    return _BALLS[radius]


class SubstringIndex:
    """Buckets of one shard's codes by the value of one substring."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        self.keys, self.begin = np.unique(values[self.order], return_index=True)
        self.end = np.append(self.begin[1:], len(values))

    def probe(self, value: int, radius: int) -> np.ndarray:
        """Rows in buckets within ``radius`` of ``value``.

        Looks up the ball's values, or goes through the keys where those are fewer.
        """
        if radius < 0:
            return self.order[:0]
        masks = ball(min(radius, SUBSTRING))
        if len(masks) < len(self.keys):
            wanted = masks ^ np.uint16(value)
            at = np.searchsorted(self.keys, wanted)
            at = at[at < len(self.keys)] if len(self.keys) else at[:0]
            hit = np.unique(at[np.isin(self.keys[at], wanted)])
        else:
            hit = np.flatnonzero(np.bitwise_count(self.keys ^ np.uint16(value)) <= radius)
        begin, size = self.begin[hit], self.end[hit] - self.begin[hit]
        if not len(hit):
            return self.order[:0]
        first = np.cumsum(size) - size
        return self.order[np.repeat(begin - first, size) + np.arange(size.sum())]


class Shard:
    """A multi-index over the entries of one shard."""

    def __init__(self, coder: Coder, vectors: np.ndarray):
        self.coder, self.vectors = coder, vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        self.codes = coder.substrings(vectors / self.norms[:, None])
        self.indexes = [SubstringIndex(self.codes[:, j]) for j in range(self.codes.shape[1])]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that the probes for ``radius`` reach; all codes within it are among them."""
        m = len(self.indexes)
        spare = radius - m + 1  # what the substring radii add up to
        low, extra = divmod(spare, m) if spare >= 0 else (-1, m + spare)
        seen = np.zeros(len(self.codes), dtype=bool)
        for j, index in enumerate(self.indexes):
            seen[index.probe(int(code[j]), low + (j < extra))] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius``: pigeonhole probes, then whole codes."""
        rows = self.probed(code, radius)
        return rows[distances(self.codes[rows], code) <= radius]

    def nearest(self, query: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the best ``k`` entries retrieved (and those that tie with the last).

        The radius starts at the fitted one and widens until ``k`` entries, or all, are inside.
        """
        radius, want = self.coder.radius, min(k, len(self.codes))
        rows = self.within(code, radius)
        while len(rows) < want:
            radius = min(self.coder.n_bits, radius + max(4, self.coder.n_bits // 32))
            rows = self.within(code, radius)
        score = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * np.linalg.norm(query))
        if len(rows) > k:
            last = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= last], score[score >= last]
        return rows, score


def nearest_neighbours(vectors: DataFrame, is_query, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest other rows found for every row where ``is_query`` holds.

    Returns ``query_id, rank, vec_id, score``: rank from 1, the largest cosine in
    double precision first, ties to the smaller id.  A query gets fewer rows only
    where the table has fewer.  Vectors that are null, zero, of another length than
    most, or that hold nulls or numbers that are not finite take no part; nor do
    null ids.  A very long vector is one of its length.  Equal vectors under several ids are candidates for each other; rows
    that repeat an id with the same vector count once.  An empty table gives an
    empty result, and only the two named columns are read.
    """
    spark = vectors.sparkSession
    as_double = F.col(vector_col).cast("array<double>")
    usable = vectors.select(F.col(id_col).cast("bigint").alias("id"), as_double.alias("v"), is_query.alias("is_query")).where(
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    # One entry for each distinct vector: its smallest ids (a query drops itself, so one more than k).
    ids = F.collect_set("id")
    few = usable.select("v", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).groupBy("v", "salt").agg(F.slice(F.array_sort(ids), 1, k + 1).alias("ids"))
    entries = few.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = materialise(entries.select("v", "ids", F.xxhash64("v").alias("h")))
    dims = entries.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out_schema = "query_id bigint, rank int, vec_id bigint, score double"
    if dims is None:
        return spark.createDataFrame([], out_schema)
    dim, n = dims["d"], dims["count"]
    entries = entries.where(F.size("v") == dim)
    share = min(1.0, 1.5 * sample / n)
    picked = entries.where(F.shiftrightunsigned("h", 11) < int(share * 2**53)).orderBy("h").limit(sample).select("v").collect()
    coder = spark.sparkContext.broadcast(fit(np.array([r["v"] for r in picked]), k))  # size: dimension squared
    # Queries with equal vectors ask once; their ids are kept beside them.
    asked = usable.where("is_query and size(v) = " + str(dim)).select("id", "v").distinct()
    questions = materialise(asked.select("v", F.xxhash64("v").alias("h")).groupBy("v", "h").agg(F.lit(1).alias("one")))
    n_shards, n_blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(questions.count() / BLOCK_QUERIES))
    left = entries.select(F.pmod("h", F.lit(n_shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "h", "v", "ids")
    right = questions.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.pmod(F.shiftrightunsigned("h", 20), F.lit(n_blocks)).cast("int").alias("block"), "h", "v")

    def search(entry: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"q": [], "score": [], "ids": []}
        if len(entry) and len(query):
            shard = Shard(coder.value, np.stack(entry["v"].to_numpy()))
            ids = entry["ids"].to_numpy()
            asks = np.stack(query["v"].to_numpy())
            codes = coder.value.substrings(_normalise(asks))
            for name, vector, code in zip(query["v"], asks, codes, strict=True):
                # The query's own entry may hold nothing but itself, hence one more than k.
                rows, scores = shard.nearest(vector, code, k + 1)
                found["q"] += [name] * len(rows)
                found["score"] += scores.tolist()
                found["ids"] += ids[rows].tolist()
        return pd.DataFrame(found)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "q array<double>, score double, ids array<bigint>")
    pairs = found.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "q")
    pairs = pairs.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
