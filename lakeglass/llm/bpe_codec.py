"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

The leaves of the tree are the ranks of adjacent symbol pairs; every inner node
holds the smaller of its children, the left one on ties.  The root is therefore
the leftmost lowest-rank merge.  A merge changes three leaves, each in a
logarithmic number of steps, until the root says that no pair can merge.

Short pieces, nearly all, are merged many at a time: one tree each, side by side in
one array, and every step is taken by all trees that can still merge.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakeglass.llm.memo import Memo
from lakeglass.llm.textbatch import blocks, kept, tidy

#: The public byte-level split, with the Unicode white-space property spelled out.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
MEMO_LIMIT = 20_000
#: Most bytes of a piece whose tree grows beside others, and pieces that are merged at a time.
WIDEST = 64
TOGETHER = 8192
#: Texts are cut into pieces in blocks of about this many characters.
BLOCK_CHARS = 500_000
_NONE = 1 << 62
_POS = 32


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies, to their bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or spec["normalizer"] or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only plain byte-level BPE files are supported")
        alphabet = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.of_byte = [0] * 256
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        #: (left id, right id) as one number -> (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.special_re = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes_by_name = {str(i): b for i, b in self.bytes_of.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        # The merges again as arrays, for many pieces at a time; the last key is no pair.
        keys = sorted(self.merges)
        self.keys = np.array([*keys, 1 << 62], dtype=np.int64)
        self.ranks = np.array([self.merges[k][0] for k in keys] + [0], dtype=np.int64)
        self.merged = np.array([self.merges[k][1] for k in keys] + [0], dtype=np.int64)
        self.byte_ids = np.array(self.of_byte, dtype=np.int64)
        pairs = (self.byte_ids[:, None] << 32 | self.byte_ids).ravel()
        self.byte_leaves = self.leaves(pairs, np.zeros(len(pairs), dtype=np.int64))

    def encode_piece(self, data: bytes) -> list[int]:
        """Identifiers of one piece of the split, merged through the segment tree."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        half = 1
        while half < n:
            half *= 2
        tree = [_NONE] * (2 * half)
        found = False
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            m = merges.get(left << 32 | right)
            if m is not None:
                tree[half + i - 1] = m[0] << _POS | (i - 1)
                found = True
            left = right
        if not found:
            return ids
        for i in range(half - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        mask = (1 << _POS) - 1
        while True:
            root = tree[1]
            if root == _NONE:
                break
            i = root & mask
            j = after[i]
            ids[i] = merged = merges[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            changes = [(j, _NONE)]
            if k < n:
                before[k] = i
                m = merges.get(merged << 32 | ids[k])
                changes.append((i, _NONE if m is None else m[0] << _POS | i))
            else:
                changes.append((i, _NONE))
            h = before[i]
            if h >= 0:
                m = merges.get(ids[h] << 32 | merged)
                changes.append((h, _NONE if m is None else m[0] << _POS | h))
            for at, value in changes:
                at += half
                if tree[at] == value:
                    continue
                tree[at] = value
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    if b < a:
                        a = b
                    if tree[at] == a:
                        break
                    tree[at] = a
                    at >>= 1
        return [x for x in ids if x >= 0]

    def leaves(self, pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of pairs (left id, right id as one number) at positions: rank and position, or none."""
        found = np.searchsorted(self.keys, pairs)
        return np.where(self.keys[found] == pairs, self.ranks[found] << _POS | at, _NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Identifiers of pieces of 1 to ``WIDEST`` bytes each, merged side by side."""
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out: list[list[int]] = [[]] * len(pieces)
        half = 1
        while half < (int(size.max()) if len(size) else 0):
            half *= 2
        for width in (w for w in (4, 8, 16, 32, 64) if w < 2 * max(half, 4)):
            which = np.flatnonzero((size <= width) & ((size > width // 2) | (width == 4)))
            if not len(which):
                continue
            ids = self._merge(b"".join([pieces[i] for i in which]), size[which], width)
            kept = ids >= 0
            flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
            begin = 0
            for i, end in zip(which.tolist(), ends, strict=True):
                out[i] = flat[begin:end]
                begin = end
        return out

    def _merge(self, data: bytes, size: np.ndarray, width: int) -> np.ndarray:
        """One row of identifiers a piece, -1 where there is none any more; all arrays are flat, with a row's begin added."""
        n, place = len(size), np.arange(width)
        inside = place < size[:, None]
        codes = np.zeros((n, width), dtype=np.int64)
        codes[inside] = np.frombuffer(data, dtype=np.uint8)
        ids = np.where(inside, self.byte_ids[codes], -1).ravel()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        leaves = self.byte_leaves[codes[:, :-1] << 8 | codes[:, 1:]]
        tree[:, width:-1] = np.where(inside[:, 1:] & (leaves != _NONE), leaves | place[:-1], _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.ravel()
        after = np.where(place + 1 < size[:, None], place + 1, width).ravel()
        before = np.tile(place - 1, n)
        mask = (1 << _POS) - 1
        rows = np.arange(n)
        while True:
            root = tree[rows * 2 * width + 1]
            rows, root = rows[root != _NONE], root[root != _NONE]
            if not len(rows):
                return ids.reshape(n, width)
            base, top, i = rows * width, rows * 2 * width, root & mask
            j = after[base + i]
            pair = ids[base + i] << 32 | ids[base + j]
            merged = self.merged[np.searchsorted(self.keys, pair)]
            ids[base + i], ids[base + j] = merged, -1
            k, h = after[base + j], before[base + i]
            after[base + i] = k
            more, less = k < width, h >= 0
            before[(base + k)[more]] = i[more]
            tree[top + width + j] = _NONE
            leaf = np.full(len(rows), _NONE, dtype=np.int64)
            leaf[more] = self.leaves(merged[more] << 32 | ids[(base + k)[more]], i[more])
            tree[top + width + i] = leaf
            tree[(top + width + h)[less]] = self.leaves(ids[(base + h)[less]] << 32 | merged[less], h[less])
            paths = np.stack([j, i, np.where(less, h, i)]) + width  # upwards, all three a level at a time
            level = width
            while level > 1:
                tree[top + paths // 2] = np.minimum(tree[top + paths], tree[top + (paths ^ 1)])
                paths //= 2
                level //= 2

    def named_all(self, pieces: list[str]) -> list[str]:
        """Like ``named``, of many pieces."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [i for i, d in enumerate(data) if len(d) <= WIDEST]
        out = [""] * len(data)
        for i, ids in zip(short, self.encode_pieces([data[i] for i in short]), strict=True):
            out[i] = ",".join([self.names[x] for x in ids])
        for i, d in enumerate(data):
            if len(d) > WIDEST:
                out[i] = ",".join(map(str, self.encode_piece(d)))
        return out

    def named(self, piece: str) -> str:
        """Identifiers of a piece as decimal numbers joined by commas."""
        return ",".join(map(str, self.encode_piece(piece.encode("utf-8", "surrogatepass"))))

    def encode_joined(self, texts: list[str], memo: Memo) -> Iterator[str]:
        """Identifiers of each text, joined by commas; empty for an empty text."""
        cut = [self.cut(t) for t in texts]
        named = memo.values_of({p for pieces in cut for p in pieces} - self.special.keys(), self.named_all, TOGETHER)
        for t, i in self.special.items():
            named[t] = str(i)
        for pieces in cut:
            yield ",".join(map(named.__getitem__, pieces))

    def cut(self, text: str) -> list[str]:
        """Pieces of a text; no piece of the split equals a special token, since those are cut out first."""
        if self.special_re is None or not any(s in text for s in self.special):
            return SPLIT.findall(text)
        out = []
        for part in self.special_re.split(text):
            out += [part] if part in self.special else SPLIT.findall(part)
        return out

    def encode(self, text: str) -> list[int]:
        joined = next(self.encode_joined([text], Memo(self.named, 10_000)))
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """Text of identifiers, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def decode_joined(self, joined: str) -> str:
        if not joined:
            return ""
        return b"".join(map(self.bytes_by_name.__getitem__, joined.split(","))).decode("utf-8", "replace")


def _codec(path: str) -> tuple[ByteBpe, Memo]:
    codec = ByteBpe(path)
    return codec, Memo(codec.named, MEMO_LIMIT)


def encode_decode(docs: DataFrame, tokenizer_path: str, *, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode it again: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``with_ids`` adds ``ids array<int>`` and ``decoded string``.  A null text
    counts as empty (no tokens; the digests of nothing).  Rows are independent:
    repeated rows, ties and skew have no effect; only the two named columns are
    read.  ``tokenizer_path`` must exist on every executor.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = kept(("byte-level BPE", tokenizer_path), lambda: _codec(tokenizer_path))
        for batch in batches:
            counts, digests, back, ids, decoded = [], [], [], [], []
            for _, texts in blocks(batch.column(1), BLOCK_CHARS):
                for joined in codec.encode_joined([t or "" for t in texts], memo):
                    text = codec.decode_joined(joined)
                    counts.append(joined.count(",") + 1 if joined else 0)
                    digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        ids.append([int(i) for i in joined.split(",")] if joined else [])
                        decoded.append(text)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        memo.forget()  # the worker lives on, with other work

    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(id_col, text_col).mapInArrow(tidy(run, ("byte-level BPE", tokenizer_path)), schema)
