"""Token counts by heap-and-linked-list byte-pair merging.

Symbols sit in a linked list; a heap holds every adjacent pair that the vocabulary
can merge, by rank and then position.  The lowest is popped and merged, its two
new neighbours are pushed, until the heap is empty.  The count is the number of
initial symbols minus the merges; no identifiers are made.

A text is first cut where no piece of the vocabulary can reach across, so merges
on the parts are merges on the whole, and counts of parts that recur are kept in
a bounded memo.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakeglass.llm.memo import Memo
from lakeglass.llm.textbatch import tidy

SPACE = "▁"
#: Space marks with the letters, or with the other characters, that follow them.
PART = regex.compile(rf"{SPACE}*(?:\p{{L}}+|[^{SPACE}\p{{L}}]+)|{SPACE}+")
MEMO_LIMIT = 150_000


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model with byte fallback does."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [
            (model.get_score(i), model.id_to_piece(i))
            for i in range(model.get_piece_size())
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
        ]
        order = {s: r for r, s in enumerate(sorted({s for s, _ in pieces}, reverse=True))}
        #: Rank of each piece; pieces of equal score share one and the leftmost pair goes first.
        self.rank = {p: order[s] for s, p in pieces}
        if wrong := next((p for p in self.rank if not PART.fullmatch(p)), None):
            raise ValueError(f"piece {wrong!r} reaches across parts; this vocabulary can't be counted part by part")
        for probe in ("a  b", " A\n", "Ａ é"):
            if self.count(probe) != len(model.encode(probe)):
                raise ValueError("only models without text normalisation, with a leading space mark, are supported")

    def merge(self, part: str) -> int:
        """Tokens of one part: initial symbols minus merges."""
        rank = self.rank
        symbols = list(part)
        n = len(symbols)
        # Characters outside the vocabulary stand for their bytes and never merge.
        count = n
        for c in symbols:
            if c not in rank:
                count += len(c.encode("utf-8", "surrogatepass")) - 1
        if n == 1:
            return count
        heap = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            r = rank.get(left + right)
            if r is not None:
                heap.append((r, i - 1))
            left = right
        if not heap:
            return count
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            r, i = heappop(heap)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n:
                continue
            pair = left + symbols[j]
            if rank.get(pair) != r:
                continue  # one of the two has merged since
            count -= 1
            symbols[i] = pair
            symbols[j] = None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                r = rank.get(pair + symbols[j])
                if r is not None:
                    heappush(heap, (r, i))
            k = before[i]
            if k >= 0:
                r = rank.get(symbols[k] + pair)
                if r is not None:
                    heappush(heap, (r, k))
        return count

    def count(self, text: str, memo: dict[str, int] | None = None) -> int:
        if not text:
            return 0
        parts = PART.findall(SPACE + text.replace(" ", SPACE))
        return sum(map(self.merge if memo is None else memo.__getitem__, parts))


@lru_cache(maxsize=2)
def _counter(path: str) -> tuple[PieceCounter, Memo]:
    counter = PieceCounter(path)
    return counter, Memo(counter.merge, MEMO_LIMIT)


def count_tokens(docs: DataFrame, model_path: str, *, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    A null text counts as empty: 0 bytes, 0 tokens.  Rows are independent, so
    repeated rows, ties and skewed keys have no effect; only the two named columns
    are read.  ``model_path`` must exist on every executor.
    """
    schema = docs.select(id_col).schema
    id_type = schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, memo = _counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_tokens = [counter.count(t, memo) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )
        memo.forget()  # the worker lives on, with other work

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
