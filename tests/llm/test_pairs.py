import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeglass.llm import components, jaccard_join, vector_search


def reference_shingles(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def reference_components(texts):
    sets = {i: reference_shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n_groups=40):
    """Copies, chains of edits, a hot passage and unrelated texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 7)))
    hot = [word() for _ in range(60)]
    out = []
    for _ in range(n_groups):
        base = [word() for _ in range(rnd.choice([3, 8, 30, 120, 300]))]
        if rnd.random() < 0.5:
            at = rnd.randrange(len(base))
            base[at:at] = hot
        for _ in range(rnd.choice([1, 1, 2, 5])):
            out.append(" ".join(base))
            for _ in range(rnd.choice([0, 1, 2, 4])):
                base[rnd.randrange(len(base))] = word()
    rnd.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_like_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_NODE", 0 if seed == 2 else 4)
    monkeypatch.setattr(jaccard_join, "LOCAL_REPEATS", 2)
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == reference_components(texts)


def test_odd_documents(odd_docs, no_docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(odd_docs).collect()}
    by = {d: (n, c) for d, n, c in got}
    assert by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4)
    assert by[6] == by[1] and by[1][1] == 1
    assert by[5] == (1, 5) and by[10] == (1, 5)
    assert jaccard_join.jaccard_components(odd_docs).count() == odd_docs.count()
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_prefixes_share_enough():
    """Any two similar sets share at least the smaller number of matches they ask for."""
    rng = np.random.default_rng(3)
    universe = np.unique(rng.integers(0, 2**62, 4000, dtype=np.uint64))
    order = jaccard_join.Order(universe[:500], rng.integers(1, 1000, 500))
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.sort(rng.choice(universe, n, replace=False))
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(n * rng.uniform(0.8, 1))), replace=False), rng.choice(universe, int(n * rng.uniform(0, 0.2)))]))
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common):
            continue
        (px, lx, _), (py, ly, _) = order.prefix(x, 80), order.prefix(y, 80)
        assert len(np.intersect1d(px, py)) >= min(lx, ly)
        bits = [np.frombuffer(jaccard_join.bitmap(s), dtype=np.uint64)[None] for s in (x, y)]
        assert jaccard_join.may_overlap(*bits, np.array([len(x)]), np.array([len(y)]), 80)[0]


def test_connected_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def test_components_that_have_not_converged_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(components, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="converged"):
        components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint"))


def brute_force(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=np.float64)
    norm = np.linalg.norm(m, axis=1)
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = np.round(m @ m[at] / (norm * norm[at]), 12)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [int(ids[i]) for i in order]
    return out


def search(df, k=5):
    out = vector_search.nearest_neighbours(df, F.col("vec_id") % 50 == 0, k=k)
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    return found


def test_recall(spark, tables):
    df = spark.read.parquet(f"{tables}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    found, truth = search(df), brute_force(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert found.keys() == truth.keys() and all(len(v) == 5 for v in found.values())
    assert np.mean([len(set(found[q]) & set(truth[q])) / 5 for q in truth]) >= 0.9


def share_and_recall(vectors, k=5):
    """(share of the rows that probes reach, recall) over every 50th row, in one shard."""
    coder = vector_search.fit(vectors[: vector_search.SAMPLE], k)
    shard = vector_search.Shard(coder, vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    asks = np.arange(0, len(vectors), 50)
    reached, found = [], []
    for q, code in zip(asks, coder.substrings(unit[asks]), strict=True):
        reached.append(len(shard.probed(code, coder.radius)) / len(vectors))
        rows, score = shard.nearest(vectors[q], code, k + 1)
        best = [r for r in rows[np.argsort(-score, kind="stable")] if r != q][:k]
        near = unit @ unit[q]
        near[q] = -np.inf
        found.append(len(set(np.argsort(-near)[:k]) & set(best)) / k)
    return float(np.mean(reached)), float(np.mean(found))


def test_share_probed(spark, tables):
    """The table's vectors have no near neighbours, so probes reach most rows; where there are some, few."""
    table = np.array([r["embedding"] for r in spark.read.parquet(f"{tables.replace('sf0.01', 'sf0.1')}/embeddings.parquet").collect()], dtype=np.float64)
    share, recall = share_and_recall(table)
    print(f"table: probes reach {share:.3f} of the rows, recall {recall:.3f}")
    assert recall >= 0.9
    rng = np.random.default_rng(2)
    near = rng.standard_normal((400, 64))[rng.integers(0, 400, 4000)] + 0.15 * rng.standard_normal((4000, 64))
    share, recall = share_and_recall(near)
    print(f"clusters: probes reach {share:.3f} of the rows, recall {recall:.3f}")
    assert recall >= 0.9 and share < 0.2


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    hot = rng.standard_normal(16).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(16).tolist(), "x") for i in range(300)]
    rows += [(1000, None, "x"), (1050, [0.0] * 16, "x"), (1100, [float("nan")] * 16, "x"), (1150, [None] * 16, "x"), (1200, [float("inf")] + [1.0] * 15, "x"), (1250, [1.0], "x"), (None, hot, "x"), (0, hot, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, h string").repartition(3)
    found = search(df)
    assert sorted(found) == [0, 50, 100, 150, 200, 250]
    assert found[0] == [3, 6, 9, 12, 15] and found[150] == [0, 3, 6, 9, 12]
    truth = brute_force([(i, v) for i, v, _ in rows[:300]], [50, 100], 5)
    assert np.mean([len(set(found[q]) & set(truth[q])) / 5 for q in truth]) >= 0.9
    few = search(df.where("vec_id in (0, 1, 2)"))
    assert {q: sorted(v) for q, v in few.items()} == {0: [1, 2]}
    assert search(df.where("false")) == {} and search(df.where("vec_id = 1000")) == {}


def test_pigeonhole_finds_every_code_in_the_radius():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((500, 32))
    coder = vector_search.fit(v, 5)
    shard = vector_search.Shard(coder, v)
    for q in range(20):
        for radius in (3, 10, 25, 60, coder.n_bits):
            d = vector_search.distances(shard.codes, shard.codes[q])
            assert shard.within(shard.codes[q], radius).tolist() == np.flatnonzero(d <= radius).tolist()
