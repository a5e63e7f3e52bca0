import random

import numpy as np
import pytest

from lakeglass.llm import decontamination as dec

RND = random.Random(4)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randrange(2, 7))) for _ in range(400)] + ["the", "of", "and"] * 20


def words(n, rnd):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def smith_waterman(a, b):
    """The textbook table, cell by cell."""
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a)):
        for j in range(len(b)):
            s = dec.MATCH if a[i] == b[j] else dec.MISMATCH
            h[i + 1, j + 1] = max(0, h[i, j] + s, h[i, j + 1] + dec.GAP, h[i + 1, j] + dec.GAP)
    return int(h.max())


def test_alignment_like_the_textbook():
    rng = np.random.default_rng(6)
    windows = [rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    targets = [rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(60)]
    assert dec.align(windows, targets).tolist() == [smith_waterman(w, t) for w, t in zip(windows, targets, strict=True)]


@pytest.fixture(scope="module")
def leaked(spark):
    rnd = random.Random(5)
    items = [words(rnd.randrange(15, 60), rnd) for _ in range(30)] + [words(700, rnd)]
    docs, truth = [], {}
    for i in range(240):
        doc = words(rnd.randrange(20, 500), rnd)
        if i % 4 == 0:
            k = rnd.randrange(len(items))
            passage = list(items[k])
            for _ in range(len(passage) // 6 if i % 8 else 0):  # substitutions, deletions and insertions
                at = rnd.randrange(len(passage))
                edit = rnd.randrange(3)
                if edit == 0:
                    passage[at] = rnd.choice(VOCABULARY)
                elif edit == 1:
                    del passage[at]
                else:
                    passage.insert(at, rnd.choice(VOCABULARY))
            at = rnd.randrange(len(doc))
            doc[at:at] = passage
            truth[i] = k
        docs.append((i, " ".join(doc).capitalize() + "."))
    # One item leaked into very many documents.
    docs += [(1000 + i, " ".join([*words(30, rnd), *items[0], *words(30, rnd)])) for i in range(200)]
    truth |= {1000 + i: 0 for i in range(200)}
    docs += [(2000, None), (2001, ""), (2002, "one"), (2003, "word " * 5000)]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (None, "a b c"), (92, "!!!")]
    a = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id bigint, text string, item_id string, score double").repartition(4)
    return a, spark.createDataFrame(bench, "item_id bigint, text string"), truth


def test_leaks_are_found_and_clean_texts_left_alone(leaked):
    docs, bench, truth = leaked
    rows = {r["doc_id"]: r for r in dec.contamination(docs, bench).collect()}
    assert len(rows) == 444
    assert {i for i, r in rows.items() if r["contaminated"]} == set(truth)
    assert all(truth[i] in rows[i]["items"] for i in truth)
    assert all(r["best_item"] in r["items"] if r["items"] else r["best_item"] is None for r in rows.values())


def test_blocks_of_items_change_nothing(leaked, monkeypatch):
    docs, bench, _ = leaked
    whole = {tuple(map(str, r)) for r in dec.contamination(docs, bench).collect()}
    monkeypatch.setattr(dec, "ITEM_BLOCK", 9)
    assert {tuple(map(str, r)) for r in dec.contamination(docs, bench).collect()} == whole


def test_empty_tables(spark, odd_docs, no_docs, leaked):
    _, bench, _ = leaked
    assert dec.contamination(no_docs, bench).count() == 0
    rows = dec.contamination(odd_docs, bench.where("false")).collect()
    assert len(rows) == 11 and not any(r["contaminated"] for r in rows)


def test_frequent_parts_of_an_item_are_found(spark):
    rnd = random.Random(8)
    item = [f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i, w in enumerate(words(60, rnd))]
    other = [f"{w}{chr(97 + i % 26)}x{chr(97 + i // 26)}" for i, w in enumerate(words(60, rnd))]
    # Many documents hold the first half of one item; of the other, whole copies and some back halves.
    docs = [(i, [*words(20, rnd), *item[:30], *words(20, rnd)]) for i in range(30)]
    docs += [(100 + i, [*words(20, rnd), *other, *words(20, rnd)]) for i in range(30)] + [(200 + i, [*words(20, rnd), *other[30:], *words(20, rnd)]) for i in range(5)]
    docs += [(1000 + i, words(60, rnd)) for i in range(400)]
    a = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string").repartition(4)
    rows = dec.contamination(a, spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id bigint, text string")).collect()
    assert {r["doc_id"]: r["best_item"] for r in rows if r["contaminated"]} == {i: 1 if i < 100 else 2 for i, _ in docs if i < 1000}


def test_short_items_and_pieces_need_a_whole_copy(spark):
    rnd = random.Random(9)
    long = [f"q{w}" for w in words(256, rnd)] + ["house"]
    bench = [(1, " ".join(long)), (2, "What is 3 + 5?"), (3, "name the longest river")]
    docs = [(1, "the house by the sea"), (2, "what is a house"), (3, "so what is 3 + 5 then"), (4, "name the longest road"), (5, "name the longest river"), (6, " ".join(long[100:])), (7, "what is 3 + 6")]
    a = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = dec.contamination(a, spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    assert {r["doc_id"]: r["items"] for r in rows if r["contaminated"]} == {3: [2], 5: [3], 6: [1]}
    assert {len(w) for w in dec.Items.of_texts([" ".join(["a"] * 600)]).words} == {200}


@pytest.mark.parametrize("n", [255, 256, 257, 512, 513])
def test_scores_are_relative_to_the_whole_item(spark, n):
    item = [f"w{i}x" for i in range(n - 1)] + ["the"]
    docs = [(1, "a calm house by the river"), (2, " ".join(item)), (3, " ".join(item[: n // 2])), (4, " ".join(item[:40])), (5, " ".join(item[-52:]))]
    a = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in dec.contamination(a, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()}
    assert rows[2]["best_score"] == 1.0 and rows[3]["best_score"] == pytest.approx(n // 2 / n, abs=0.01)
    assert {i for i, r in rows.items() if r["contaminated"]} == {2, 3, 5}


def test_null_and_repeated_ids(spark):
    item = " ".join(f"w{i}x" for i in range(30))
    a = spark.createDataFrame([(None, item), (None, "a calm house"), (1, "a calm house"), (1, item), (2, "a calm house"), (2, "a calm house")], "doc_id bigint, text string")
    rows = dec.contamination(a, spark.createDataFrame([(1, item), (1, item)], "item_id bigint, text string")).collect()
    assert sorted(((r["doc_id"], r["contaminated"]) for r in rows), key=str) == sorted([(None, True), (1, True), (2, False)], key=str)


def test_a_long_text_full_of_hits(spark):
    item = ["one", "word", "and", "another", "word", "and", "so", "on"] * 6
    rnd = random.Random(3)
    a = spark.createDataFrame([(1, "one word and another word and so on " * 4000), (2, " ".join(rnd.choice(["one", "word", "and", "on"]) for _ in range(20_000)))], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in dec.contamination(a, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()}
    assert rows[1]["best_score"] == 1.0 and 0 < rows[2]["best_score"] < 1


def test_whole_operator_like_brute_force(spark):
    """Every document against every item, cell by cell, over the whole texts."""
    rnd = random.Random(12)
    items = [[f"{w}{k}" if rnd.random() < 0.5 else w for w in words(rnd.randrange(8, 40), rnd)] for k in range(12)]
    docs = []
    for i in range(60):
        doc = words(rnd.randrange(10, 120), rnd)
        if i % 2:
            passage = [w for w in items[i % 12] if rnd.random() < 0.9]
            doc[5:5] = passage[: rnd.randrange(4, len(passage) + 1)]
        docs.append(doc)
    want = {}
    for i, d in enumerate(docs):
        for k, item in enumerate(items):
            grams = {tuple(item[j : j + dec.SEED]) for j in range(len(item) - dec.SEED + 1)}
            if any(tuple(d[j : j + dec.SEED]) in grams for j in range(len(d))):
                want[i, k] = smith_waterman(d, item) / (2 * len(item))
    a = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in dec.matches(a, bench).collect()}
    assert got.keys() == want.keys()
    # A window looks at neighbouring diagonals only, so a score may fall short where an alignment wanders far, never exceed.
    assert all(got[p] <= want[p] + 1e-9 for p in want)
    flagged = {p for p, s in want.items() if s >= dec.THRESHOLD}
    assert flagged and {p for p, s in got.items() if s >= dec.THRESHOLD} == flagged
    hits = {r["doc_id"]: r["items"] for r in dec.contamination(a, bench).collect()}
    assert {(i, k) for i, ks in hits.items() for k in ks} == flagged
