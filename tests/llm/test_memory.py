"""What workers hold: bounds on traced memory, and what stays between tasks."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from lakeglass.llm import jaccard_join, textbatch, toxicity
from lakeglass.llm.session import BATCH_ROWS, materialise

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _texts(n, words=300, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(3, 11, 20_000)]
    return [" ".join(vocabulary[i] for i in rng.zipf(1.3, words) % len(vocabulary)) for _ in range(n)]


def _peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_training_does_not_hold_the_ngrams_of_the_sample():
    texts = _texts(1000)
    labels = np.arange(len(texts), dtype=np.float64) % 2
    peak = _peak_mb(lambda: toxicity.vocabulary([b for b, _ in toxicity._blocks_of(texts, labels, np.arange(len(texts)))]))
    print(f"{peak:.0f} MB for {sum(map(len, texts)) / 1e6:.1f} MB")
    assert peak < 72


def test_vocabulary_counts_documents(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_SHARE", 0)
    texts = _texts(60, words=40)
    labels = np.zeros(len(texts))
    one = toxicity.vocabulary([toxicity.prepare(texts)])
    monkeypatch.setattr(toxicity, "BATCH_CHARS", 200)
    many = toxicity.vocabulary([b for b, _ in toxicity._blocks_of(texts, labels, np.arange(len(texts)))])
    assert all(len(a) and (a == b).all() for a, b in zip(one, many, strict=True))


def test_blocks_bound_the_memory_of_kernels():
    column = pa.array(_texts(1500))
    net = toxicity.train(_texts(30, words=60), [0, 1] * 15, epochs=1)
    scoring = _peak_mb(lambda: [net.score(t) for _, t in textbatch.blocks(column, toxicity.SCORE_CHARS)])
    shingling = _peak_mb(lambda: [len(jaccard_join.shingle_sets(t)) for _, t in textbatch.blocks(column)])
    print(f"{scoring:.0f} and {shingling:.0f} MB for {column.nbytes / 1e6:.1f} MB")
    assert scoring < 18 and shingling < 25


def test_other_work_drops_what_a_worker_keeps():
    path = public_tokenizers.path("byte_bpe_50k.json")
    key = ("test", path)
    made = []
    make = lambda: made.append(1) or len(made)
    assert [textbatch.kept(key, make) for _ in range(2)] == [1, 1]
    assert list(textbatch.tidy(lambda batches: batches, key)(iter([1, 2]))) == [1, 2]
    assert textbatch.kept(key, make) == 1
    assert list(textbatch.tidy(lambda batches: batches)(iter([3]))) == [3]
    assert textbatch.kept(key, make) == 2
    textbatch.keep_only(None)


def test_materialised_results_travel_in_small_batches(spark):
    before = spark.conf.get(NAME)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = materialise(spark.range(0, 3 * BATCH_ROWS + 1, numPartitions=1).mapInArrow(sizes, "n bigint")).collect()
    assert sum(r["n"] for r in rows) == 3 * BATCH_ROWS + 1 and max(r["n"] for r in rows) <= BATCH_ROWS
    assert spark.conf.get(NAME) == before
