import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lakeglass.llm import language_id, toxicity
from lakeglass.llm.textbatch import blocks

EN, FR, RU = "the house and river of tree with was".split(), "la maison et une rivière des arbres avec était".split(), "дом и река над лесом был зелёный".split()


def text(words, n, rnd):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    pairs = [(text(w, 60, rnd), lang) for lang, w in (("en", EN), ("fr", FR), ("ru", RU)) for _ in range(30)]
    return language_id.fit([t for t, _ in pairs], [x for _, x in pairs])


def test_languages(model):
    rnd = random.Random(2)
    found, scores = model.predict([text(EN, 30, rnd), text(FR, 30, rnd), text(RU, 30, rnd), None, "", "12 !!", "—“”", text(EN, 30_000, rnd)])
    assert found == ["en", "fr", "ru", "und", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for s in scores) and scores[3:7] == [0.0] * 4 and min(scores[:3]) > 0.9


def test_spans_of_mixed_text(model):
    rnd = random.Random(3)
    words = language_id.Words([text(EN, 40, rnd) + " " + text(FR, 40, rnd)], language_id.LETTER)
    labels, _ = model.spans(words)
    names = [model.languages[k] for k in labels]
    assert names[:38] == ["en"] * 38 and names[42:] == ["fr"] * 38
    assert sum(a != b for a, b in zip(names, names[1:], strict=False)) == 1


def test_viterbi_like_brute_force():
    import itertools

    rng = np.random.default_rng(5)
    lengths = [0, 1, 4, 6, 0, 3]
    first = np.concatenate(([0], np.cumsum(lengths)))
    scores = rng.standard_normal((int(first[-1]), 3)).astype(np.float32) * 3
    got = language_id.viterbi(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        def value(path, a=a):
            return sum(scores[a + i, p] for i, p in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))

        best = max((value(p) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
        assert value(got[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def test_predictions_like_a_plain_loop(model):
    """Scripts, scores word by word from the table, the best labelling by plain dynamic programming, and the score."""
    rnd = random.Random(11)
    texts = [text(EN, 5, rnd), text(FR, 7, rnd) + " " + text(EN, 9, rnd), "дом " + text(EN, 3, rnd), "été", "x", text(RU, 4, rnd) + " 12 " + text(FR, 6, rnd)]
    n_buckets = len(model.table) - 1
    for t, lang, score in zip(texts, *model.predict(texts), strict=True):
        words = language_id.Words([t], language_id.LETTER)
        rows = []
        for i in range(len(words)):
            begin, grams = language_id.gram_buckets(words, np.array([i]), language_id.GRAMS, n_buckets)
            s = sum(model.table[g].sum(axis=0) for g in grams) / len(language_id.GRAMS)
            kind = language_id.word_scripts(words, np.array([i]))[0]
            allowed = model.allowed[kind] if model.allowed[kind].any() else np.ones(len(s), bool)
            s = np.where(allowed, s, s.max() + language_id.EXCLUDED)
            rows.append(np.zeros(len(s)) if kind == 1 else s - s.max())
        best, back = rows[0].astype(float), []
        for r in rows[1:]:
            jump = best.max() - language_id.SWITCH
            back.append([j if best[j] >= jump else int(best.argmax()) for j in range(len(r))])
            best = np.maximum(best, jump) + r
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(b[path[-1]])
        path.reverse()
        letters = np.zeros(len(model.languages))
        for i, j in enumerate(path):
            letters[j] += words.end[i] - words.start[i]
        top, sums = int(letters.argmax()), np.sum(rows, axis=0)
        margin = sums[top] - np.delete(sums, top).max()
        assert lang == model.languages[top]
        assert score == pytest.approx(letters[top] / letters.sum() / (1 + np.exp(-np.clip(margin, -30, 30))), abs=1e-3)


def test_no_languages():
    assert language_id.fit([], []).predict(["abc", None]) == (["und", "und"], [0.0, 0.0])


def test_language_frames(spark, odd_docs, no_docs):
    model = language_id.learn(odd_docs)
    rows = {r["doc_id"]: r for r in language_id.identify(odd_docs, model).collect()}
    assert len(rows) == 11 and rows[2]["lang_pred"] == rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[7]["lang_pred"] == "und"
    assert rows[1]["lang_pred"] in ("en", "fr")
    assert language_id.identify(no_docs, language_id.learn(no_docs)).count() == 0


def test_held_out_language_accuracy(spark, tables):
    from pyspark.sql import functions as F

    from lakeglass.llm import queries

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = queries.op9_language_id(spark, tables).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_windows_cover_every_word():
    first = np.array([0, 0, 1, 64, 130, 500])
    start, owner = toxicity.window_starts(first)
    for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own = start[owner == d]
        seen = {w for s in own for w in range(s, min(s + toxicity.WINDOW, b))}
        assert seen == set(range(a, b))


def odd_network(seed=3):
    texts = ["a bc def gh idiot foo bar " * 14, "one two three", "a def idiot", "one bar foo", "two gh bc"]
    block = toxicity.prepare(texts)
    words, grams = np.unique(block.word)[::2], np.unique(np.concatenate(block.grams))
    net = toxicity.Network(words, grams[(grams != toxicity.GRAM_HASHES) & (grams % 3 > 0)], seed)
    return net, texts, block


def test_gradients():
    net, _, block = odd_network()
    net.p = {k: v.astype(np.float64) * 2 for k, v in net.p.items()}
    look = net.look_up(block)
    windows, y, w = np.arange(4), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1.5, 1])
    _, grads = net.gradients(block, look, windows, y, w)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = net.p[name][at], 1e-3
        net.p[name][at] = kept + step
        up, _ = net.gradients(block, look, windows, y, w)
        net.p[name][at] = kept - step
        down, _ = net.gradients(block, look, windows, y, w)
        net.p[name][at] = kept
        assert (up - down) / 2 / step == pytest.approx(g[at], rel=0.02, abs=1e-4), name


def test_scores_like_a_plain_loop():
    """The whole score, word by word and window by window, from the network's parameters."""
    net, texts, block = odd_network(5)
    net.p = {k: v * 2 for k, v in net.p.items()}
    h, look = toxicity.HIDDEN, net.look_up(block)

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def vector(word):
        chars = [net.p["char"][r] for r, w in zip(look.gram, look.gram_owner, strict=True) if w == word]
        return np.concatenate([net.p["word"][look.word[word]], np.mean(chars, axis=0) if chars else np.zeros(toxicity.CHAR_DIM)])

    def states(words, d):
        state, out = np.zeros(h), {}
        for i in range(len(words)) if d == "f" else reversed(range(len(words))):
            x, u = vector(words[i]) @ net.p[f"W{d}"] + net.p[f"c{d}"], net.p[f"U{d}"]
            z, r = sigmoid(x[:h] + state @ u[:, :h]), sigmoid(x[h : 2 * h] + state @ u[:, h : 2 * h])
            n = np.tanh(x[2 * h :] + r * (state @ u[:, 2 * h :]))
            out[i] = state = (1 - z) * n + z * state
        return out

    for k, got in enumerate(net.score(texts)):
        own = block.number[block.words.first[k] : block.words.first[k + 1]]
        best = -np.inf
        for at in range(0, max(1, len(own) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            words = own[at : at + toxicity.WINDOW]
            both = [np.concatenate([f, b]) for f, b in ((states(words, "f")[i], states(words, "b")[i]) for i in range(len(words)))]
            energy = np.array([s @ net.p["attend"] for s in both])
            weight = np.exp(energy - energy.max())
            best = max(best, float((weight / weight.sum()) @ np.array([s @ net.p["out"] for s in both])) + float(net.p["bias"][0]))
        assert got == pytest.approx(sigmoid(best), abs=1e-4)


def test_held_out_toxicity(spark, tables):
    """Held-out quality on the larger table: ranking, recall, and clean documents left alone."""
    from pyspark.sql import functions as F

    from lakeglass.llm import queries

    big = tables.replace("sf0.01", "sf0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    rows = queries.op1_toxicity(spark, big).where("held_out").join(labels, "doc_id").toPandas()
    rank, toxic = rows["score"].rank(), rows["y"] == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.9
    assert rows.loc[toxic, "predicted"].mean() > 0.7 and rows.loc[~toxic, "predicted"].mean() < 0.05


def test_sample_takes_long_texts_and_equal_rows_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_remotely", lambda rows, fit: seen.extend(rows.collect()))
    docs = spark.createDataFrame([(1, "x" * 200_000), *[(2, "again")] * 50, (3, "clean"), (4, ""), (None, "null")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 0), (4, 0), (None, 1), (9, 1), (3, 7)], "doc_id bigint, toxic int")
    toxicity.learn(docs, labels)
    assert sorted((r["y"], len(r["text"])) for r in seen) == [(0, 5), (0, 5), (1, 200_000)]


def test_language_sample_leaves_no_language_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit_remotely", lambda rows, fit: seen.extend(rows.collect()))
    rows = [(i, f"text {i} of k", f"l{i % 200}") for i in range(4000)] + [(5000, "long " * 100_000, "rare"), (None, "no id", "none"), (5001, None, "en"), (5002, "x", None)]
    language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_docs=100)
    assert {r["lang"] for r in seen} == {f"l{i}" for i in range(200)} | {"rare", "none"}
    assert len(seen) <= 4 * 200 + 2


def test_many_languages():
    rng = np.random.default_rng(4)
    scores = np.full((40, 200), -5.0, dtype=np.float32)
    best = np.repeat(rng.integers(128, 200, 4), 10)
    scores[np.arange(40), best] = 5.0
    assert language_id.viterbi(scores, np.array([0, 40]), 1.0).tolist() == best.tolist()
    names = [f"l{k:03d}" for k in range(300)]
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in names]
    model = language_id.fit([f"{w} {w} {w}" for w in words], names)
    assert model.predict([f"{w} {w}" for w in words])[0] == names


@pytest.fixture(scope="module")
def net():
    rnd = random.Random(7)
    syllables = ["ka", "lo", "mi", "tu", "re", "san", "dor", "wen"]
    clean = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for i in range(300):
        words = [rnd.choice(clean) for _ in range(rnd.randrange(20, 200))]
        if i % 3 == 0:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["idiot", "moron", "scum"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return toxicity.train(texts, labels, epochs=6), clean


def test_toxic_passage_in_a_long_text(net):
    net, clean = net
    rnd = random.Random(9)
    calm = [rnd.choice(clean) for _ in range(5000)]
    rude = list(calm)
    rude[4000:4003] = ["idiot", "scum", "moron"]
    scores = net.score([" ".join(calm), " ".join(rude), None, "", "!!! 123"])
    assert scores[1] >= 0.3 > scores[0] and scores[2:].tolist() == [0.0] * 3


def test_one_label_only():
    assert toxicity.train(["a b"], [0]).score(["a b", None])[0] < 0.1
    assert toxicity.train(["a b"], [1]).score(["a b"])[0] > 0.9
    assert toxicity.train([], []).score(["a b"])[0] < 0.1


def test_toxicity_frames(spark, odd_docs, no_docs, net):
    rows = toxicity.score_documents(odd_docs, net[0]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    labels = spark.createDataFrame([(1, 1, 0), (6, None, None), (5, 0, 1), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score_documents(no_docs, toxicity.learn(odd_docs, labels)).count() == 0
    assert toxicity.learn(no_docs, labels).score(["a"])[0] < 0.1


def test_labelling_a_long_batch_takes_bounded_memory():
    words = [f"{a}{b}{c}" for a in ("der", "die", "un", "la") for b in "abcdefghijklmnop" for c in ("keit", "ung", "cion", "aje")]
    texts = [" ".join(words[(7 * i + j) % len(words)] for j in range(200)) for i in range(3000)]
    model = language_id.fit(texts[:20], ["de", "es"] * 10)
    tracemalloc.start()
    for _, block in blocks(pa.array(texts), language_id.PREDICT_CHARS):
        model.predict(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75_000_000
