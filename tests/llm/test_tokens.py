import hashlib

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeglass.llm import bpe_codec, token_counts
from lakeglass.llm.memo import Memo

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=["Cs"]), st.sampled_from(" \n\t▁aeinrst'.,")), max_size=200)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER = Tokenizer.from_file(BYTES)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_like_the_library(text):
    counter, memo = token_counts._counter(PIECES)
    assert counter.count(text, memo) == counter.count(text) == len(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encodes_like_the_library(text):
    codec, _ = bpe_codec._codec(BYTES)
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == TOKENIZER.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=bpe_codec.WIDEST), max_size=20))
def test_trees_side_by_side_merge_like_single_ones(pieces):
    codec, _ = bpe_codec._codec(BYTES)
    assert codec.encode_pieces(pieces) == [codec.encode_piece(p) for p in pieces]


def test_pieces_of_a_block_are_merged_together_and_once():
    codec = bpe_codec.ByteBpe(BYTES)
    words = [f" word{i:x}ing" for i in range(3000)]
    texts = ["".join(words), "", "".join(words[::-1]) + "<|endoftext|>" + "é" * 70, " a"]
    given_singly, together = [], []
    single, many = codec.encode_piece, codec.encode_pieces
    codec.encode_piece = lambda d: given_singly.append(d) or single(d)
    codec.encode_pieces = lambda ds: together.extend(ds) or many(ds)
    got = list(codec.encode_joined(texts, Memo(codec.named, 100)))
    assert got == [",".join(map(str, TOKENIZER.encode(t, add_special_tokens=False).ids)) for t in texts]
    assert given_singly == ["é".encode() * 70] and len(together) == len(set(together)) > 1000


def test_long_words():
    counter, _ = token_counts._counter(PIECES)
    codec, _ = bpe_codec._codec(BYTES)
    for text in ("ab" * 20_000, " " * 999 + "x", "é" * 5000, "<|endoftext|>" * 3):
        assert counter.count(text) == len(LIBRARY.encode(text))
        assert codec.encode(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_broken_bytes_decode_like_the_library():
    codec, _ = bpe_codec._codec(BYTES)
    ids = TOKENIZER.encode("漢字é", add_special_tokens=False).ids
    assert codec.decode(ids[1:]) == TOKENIZER.decode(ids[1:], skip_special_tokens=False)


def test_frames(odd_docs, no_docs):
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    got = sorted(map(tuple, token_counts.count_tokens(odd_docs, PIECES, limit=100).collect()))
    assert got == sorted((i, len(t.encode()), n := len(LIBRARY.encode(t)), n > 100) for i, t in texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, bpe_codec.encode_decode(odd_docs, BYTES).collect()))
    ids = [(i, TOKENIZER.encode(t, add_special_tokens=False).ids, t) for i, t in texts]
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(t)) for i, x, t in ids)
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe_codec.encode_decode(odd_docs, BYTES, with_ids=True).collect()} == {i: (x, t) for i, x, t in ids}
    assert token_counts.count_tokens(no_docs, PIECES, limit=1).count() == bpe_codec.encode_decode(no_docs, BYTES).count() == 0


def test_memo_is_bounded():
    memo = Memo(lambda k: k * 2, 10)
    assert [memo[i % 37] for i in range(1000)] == [i % 37 * 2 for i in range(1000)]
    assert len(memo) + len(memo.old) <= 20


def test_memo_keeps_no_long_texts():
    memo = Memo(len, 10)
    assert [memo["x" * n] for n in (1, 64, 65, 100_000)] == [1, 64, 65, 100_000]
    assert sorted(map(len, memo)) == [1, 64]
    memo.forget()
    assert not memo and not memo.old and memo["x"] == 1
