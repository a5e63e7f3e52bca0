"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are cut into word n-grams, and every n-gram of an item is a seed,
however many documents hold it, so that a leak cannot hide by being frequent.  A
document that holds a seed is aligned with the item around each group of hits on
neighbouring diagonals.  The alignment is local and scores words: a match counts
2, a mismatch or a gap -1.  The score is divided by that of a perfect copy of the
whole item, so insertions, deletions and substitutions lower it gradually.  Long
items are aligned piece by piece and the pieces' scores are added.

Items are cut into hashed pieces by the executors and travel to the documents in
blocks of bounded size, one after the other; texts never move.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.session import materialise
from lakeglass.llm.textbatch import LETTER, Words, blocks, run_hashes, tidy

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Normalised alignment score from which a document counts as contaminated.
THRESHOLD = 0.4
#: Words' worth of aligned text from which a part of a longer item is a leak by itself.
LONG_MATCH = 50
#: Pieces of items sent to the documents at a time; with ITEM_WORDS this bounds the broadcast to about 50 MB.
ITEM_BLOCK = 10_000
#: Longer items are aligned in pieces of nearly equal length, of at most this many words.
ITEM_WORDS = 256
#: Shorter items match only as a whole, word for word.
SHORT_WORDS = 8
#: Words are runs of letters and digits.
WORD = LETTER.copy()
WORD[48:58] = True
#: Windows aligned together, and their words.
ALIGN_BATCH = 512
ALIGN_WORDS = 500_000


def pieces(texts: list[str | None]) -> list[tuple[int, int, int, np.ndarray]]:
    """(text, piece, words of the whole text, word hashes) of the pieces of at most ITEM_WORDS words."""
    words = Words(texts, WORD)
    h = words.hashes()
    out = []
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        n = -(-(b - a) // ITEM_WORDS)
        out += [(i, k, int(b - a), h[a + (b - a) * k // n : a + (b - a) * (k + 1) // n]) for k in range(n)]
    return out


@dataclass
class Items:
    """Word hashes of some pieces of test items, and their n-grams.

    ``whole`` is the number of words of each piece's item; ``gram`` holds sorted
    n-gram hashes, one entry per occurrence in a piece.
    """

    words: list[np.ndarray]
    whole: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    position: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray], whole: list[int]) -> Items:
        grams, item, position = [], [], []
        for k, w in enumerate(words):
            g = run_hashes(w, min(SEED, len(w)))
            grams.append(g)
            item.append(np.full(len(g), k))
            position.append(np.arange(len(g)))
        if not grams:
            empty = np.empty(0, dtype=np.int64)
            return cls([], empty, empty.astype(np.uint64), empty, empty)
        gram, item, position = np.concatenate(grams), np.concatenate(item), np.concatenate(position)
        order = np.lexsort((position, item, gram))
        return cls(words, np.array(whole, dtype=np.int64), gram[order], item[order], position[order])

    @classmethod
    def of_texts(cls, texts: list[str | None]) -> Items:
        cut = pieces(texts)
        return cls.of([w for *_, w in cut], [n for _, _, n, _ in cut])


def _gram_runs(words: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, position of their first word) within texts."""
    runs = run_hashes(h, n)
    at = np.flatnonzero(words.doc[: len(runs)] == words.doc[n - 1 :]) if len(runs) else np.empty(0, dtype=np.int64)
    return runs[at], at


def _sizes(items: Items) -> list[int]:
    """Lengths of n-grams in use: items shorter than SEED words have shorter ones."""
    return sorted({min(SEED, len(w)) for w in items.words})


def hits(items: Items, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, item, position in the item) of every seed found in the texts."""
    out = [(np.empty(0, dtype=np.int64),) * 3]
    for n in _sizes(items):
        runs, at = _gram_runs(words, h, n)
        left, right = np.searchsorted(items.gram, runs, "left"), np.searchsorted(items.gram, runs, "right")
        found = np.flatnonzero(right > left)
        many = (right - left)[found]
        entry = np.repeat(left[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out.append((np.repeat(at[found], many), items.item[entry], items.position[entry]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def align(windows: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman score of each window against its target.

    All pairs advance together, one target word at a time.  Within a row, gaps
    along the window are a running maximum, since a gap costs the same per word.
    """
    n = len(windows)
    width, depth = max(map(len, windows)), max(map(len, targets))
    text = np.zeros((n, width), dtype=np.uint64)
    item = np.zeros((n, depth), dtype=np.uint64)
    real = np.zeros((n, width), dtype=bool)
    for i, (w, t) in enumerate(zip(windows, targets, strict=True)):
        text[i, : len(w)], real[i, : len(w)], item[i, : len(t)] = w, True, t
    lengths = np.array([len(t) for t in targets])
    ramp = np.arange(width, dtype=np.int32) * -GAP
    row = np.zeros((n, width + 1), dtype=np.int32)
    best = np.zeros(n, dtype=np.int32)
    for j in range(depth):
        same = (text == item[:, j, None]) & real
        here = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
        here = np.maximum(here, 0)
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp
        here = np.where(real & (j < lengths)[:, None], here, 0)
        row[:, 1:] = here
        np.maximum(best, here.max(axis=1), out=best)
    return best


def scan_block(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, piece, points, first word, last word) of the best window of every text and piece that share a seed."""
    words = Words(texts, WORD)
    if not len(words) or not items.words:
        return []
    h = words.hashes()
    word, item, position = hits(items, words, h)
    if not len(word):
        return []
    doc = words.doc[word]
    # Hits that belong together lie on neighbouring diagonals of one text and item.
    diagonal = word - position
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    size = np.array([len(w) for w in items.words])
    slack = np.maximum(3, size // 4)
    split = np.ones(len(doc), dtype=bool)
    split[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) > slack[item[1:]])
    begin = np.flatnonzero(split)
    end = np.append(begin[1:], len(doc))
    low, high = diagonal[begin], diagonal[end - 1]
    doc, item = doc[begin], item[begin]
    low = np.maximum(low - slack[item], words.first[doc])
    high = np.minimum(high + size[item] + slack[item], words.first[doc + 1])
    # An alignment with points spans at most three times the piece, since every gap costs one. Wide
    # windows are cut into overlapping ones that hold every such span.
    span = 3 * size[item] + 1
    n_cuts = np.maximum(1, -(-(high - low - span) // span))
    which = np.repeat(np.arange(len(low)), n_cuts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n_cuts) - n_cuts, n_cuts)
    low = low[which] + nth * span[which]
    high = np.minimum(low + 2 * span[which], high[which])
    doc, item = doc[which], item[which]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    by_width = np.argsort(high - low, kind="stable")
    at = 0
    while at < len(by_width):
        part = by_width[at : at + ALIGN_BATCH]
        part = part[: max(1, ALIGN_WORDS // int((high - low)[part[-1]]))]
        at += len(part)
        points = align([h[low[i] : high[i]] for i in part], [items.words[item[i]] for i in part])
        for i, s in zip(part, points, strict=True):
            if items.whole[item[i]] < SHORT_WORDS and s < MATCH * size[item[i]]:
                continue
            key, value = (int(doc[i]), int(item[i])), (int(s), -int(low[i]), int(high[i]))
            if value > best.get(key, (-1, 0, 0)):
                best[key] = value
    return [(d, k, s, -a - int(words.first[d]), b - 1 - int(words.first[d])) for (d, k), (s, a, b) in sorted(best.items())]


def _pieces_of(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``i, t, piece, whole, words`` of every piece of every item; ``t`` tells texts under one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch.column(2)):
                cut = pieces(texts)
                at = pa.array([begin + c[0] for c in cut], pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array([c[1] for c in cut], pa.int32()), pa.array([c[2] for c in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c[3].view(np.int64) for c in cut], pa.list_(pa.int64()))], names=["i", "t", "piece", "whole", "words"])

    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.xxhash64(item_text).alias("t"), F.col(item_text).alias("x")).where("i is not null and x is not null")
    return items.mapInArrow(tidy(run), "i bigint, t bigint, piece int, whole bigint, words array<bigint>").dropDuplicates(["i", "t", "piece"])


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Aligned pairs: the document id, ``item_id``, ``score``, ``matched``, and the words ``first_word`` to ``last_word``.

    One row for each document id and item that share a seed.  ``score`` adds up
    the pieces of an item and is relative to the whole item; ``matched`` is the
    best piece's score in words; the words are those that this piece was looked for
    in.  An item of fewer than ``SHORT_WORDS`` words counts only where a document
    holds all of it.  Documents and items without words, null texts and null ids of
    items match nothing; null ids of documents are an id like any other.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, text_col)
    schema = f"`{id_col}` {id_type}, i bigint, t bigint, piece int, whole bigint, points bigint, first_word bigint, last_word bigint"
    cut = materialise(_pieces_of(benchmark, item_id, item_text))
    out = spark.createDataFrame([], schema)
    n_blocks = max(1, -(-cut.count() // ITEM_BLOCK))
    for number in range(n_blocks):
        own = cut.where(F.pmod(F.xxhash64("i", "t", "piece"), F.lit(n_blocks)) == number).orderBy("i", "t", "piece").toArrow()  # about ITEM_BLOCK pieces
        words = [np.asarray(w.values).view(np.uint64) for w in own.column("words")]
        seeds = spark.sparkContext.broadcast((Items.of(words, own.column("whole").to_pylist()), own.select(["i", "t", "piece", "whole"])))

        def scan(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            items, named = seeds.value
            for batch in batches:
                for begin, texts in blocks(batch.column(1)):
                    found = scan_block(items, texts)
                    who = batch.column(0).take(pa.array([begin + f[0] for f in found], pa.int64()))
                    what = named.take(pa.array([f[1] for f in found], pa.int64())).combine_chunks()
                    names = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in what.columns]
                    numbers = [pa.array([f[j] for f in found], pa.int64()) for j in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([who, *names, *numbers], names=[id_col, "i", "t", "piece", "whole", "points", "first_word", "last_word"])

        found = materialise(source.mapInArrow(tidy(scan), schema))
        seeds.destroy()
        out = out.unionByName(found)
    # Repeated ids: the best of each piece. Then the pieces of a text, then the texts of an item.
    at = F.max_by(F.struct("first_word", "last_word"), F.struct("points", (-F.col("first_word")).alias("order")))
    piece = out.groupBy(id_col, "i", "t", "whole", "piece").agg(F.max("points").alias("points"), at.alias("at"))
    text = piece.groupBy(id_col, "i", "t", "whole").agg(
        (F.sum("points") / (MATCH * F.col("whole"))).alias("score"), (F.max("points") / MATCH).alias("matched"), F.max_by("at", F.struct("points", (-F.col("piece")).alias("order"))).alias("at")
    )
    best = F.max(F.struct("score", "matched", "at")).alias("b")
    return text.groupBy(id_col, F.col("i").alias("item_id")).agg(best).select(id_col, "item_id", "b.score", "b.matched", "b.at.first_word", "b.at.last_word")


def contaminated_ids(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """Every document id that meets a seed: ``best_score``, ``items`` (sorted), ``best`` (score and item) and ``contaminated``."""
    pairs = matches(docs, benchmark, id_col=id_col, text_col=text_col, **columns)
    hit = (F.col("score") >= threshold) | (F.col("matched") >= LONG_MATCH)
    per = pairs.groupBy(id_col).agg(
        F.max("score").alias("best_score"),
        F.array_sort(F.collect_set(F.when(hit, F.col("item_id")))).alias("items"),
        F.max(F.when(hit, F.struct("score", (-F.col("item_id")).alias("order")))).alias("best"),
    )
    return per.withColumn("contaminated", F.size("items") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """One row per document id: ``n_items``, ``items`` (sorted), ``best_item``, ``best_score``, ``contaminated``.

    ``items`` are the test items aligned with a score of at least ``threshold``, or
    with ``LONG_MATCH`` words of one piece; ``best_item`` is the best of them (ties to
    the smaller id), null without one, and ``best_score`` the best score of any item,
    0 where no seed was met.  Rows that repeat an id are judged together, and so are
    those whose id is null.  Null and empty texts are clean; an empty benchmark leaves
    every document clean; an empty table gives an empty result.  A very long text is
    searched whole; windows to align are bounded by the size of the items.  Only the
    named columns are read.
    """
    per = contaminated_ids(docs, benchmark, threshold=threshold, id_col=id_col, text_col=text_col, **columns)
    ids = docs.select(F.col(id_col).alias("_of")).distinct()
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return ids.join(per, F.col("_of").eqNullSafe(F.col(id_col)), "left").select(
        F.col("_of").alias(id_col),
        F.size(items).cast("bigint").alias("n_items"),
        items.alias("items"),
        (-F.col("best.order")).alias("best_item"),
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )
