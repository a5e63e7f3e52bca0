"""Toxicity scores from a bidirectional gated recurrent network, in numpy.

A text is cut into overlapping windows of words.  Each word enters as a learned
word vector and the mean of the learned vectors of its character n-grams.  Words
and n-grams that few documents of the training sample hold have no vector of their
own: such words share one, and such n-grams are left out.  A gated recurrent
network reads a window in both directions, attention pools its states, and a
logistic unit scores it.  A text's score is that of its worst window, so one bad
passage in a long text counts.

Training is multiple-instance: the worst window of each document of the sample is
pushed towards the document's label.  Documents of few windows come first, since
their label says most about a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.session import bounded_sample, fit_remotely
from lakeglass.llm.textbatch import LETTER, Words, blocks, tidy
from lakeglass.llm.wordgrams import distinct, gram_buckets

WINDOW, STRIDE = 64, 56
HIDDEN = 8
WORD_DIM, CHAR_DIM = 6, 6
GRAMS = (4, 5, 6)
#: N-grams are told apart by this many hash values.
GRAM_HASHES = 1 << 40
#: Words and n-grams with vectors: the most frequent ones of those in so many documents, and in that share, of the sample.
MAX_WORDS, MAX_GRAMS, LEAST_DOCS, LEAST_SHARE = 1 << 14, 1 << 15, 3, 0.004
EPOCHS = 16
#: Small samples get more epochs, up to this many steps, and MAX_EPOCHS.
LEAST_STEPS, MAX_EPOCHS = 240, 40
#: Speed of the vectors, which follow plain gradients with momentum, and their decay.
VECTOR_RATE, VECTOR_DECAY = 800.0, 0.04
#: One document in so many is kept back to choose the epoch and to calibrate the scores.
KEPT_BACK = 5
#: Share of the words that training hides behind the shared vector.
HIDDEN_WORDS = 0.3
#: The worst window of a document is looked for in one epoch of so many.
LOOK_EVERY = 3
#: Windows of a document that is trained on in the first epochs.
SHORT_WINDOWS, SHORT_EPOCHS = 2, 2
#: Characters of one training step; small samples are cut into so many steps at least.
BATCH_CHARS, LEAST_BATCHES = 120_000, 12
#: Documents of each label that the network is fitted on, and their bytes in all.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 800, 1200, 8_000_000
#: Characters scored together.
SCORE_CHARS = 300_000

_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


@dataclass
class Block:
    """The words of some texts, their windows, and one occurrence and the hash of each distinct word."""

    words: Words
    number: np.ndarray
    which: np.ndarray
    word: np.ndarray
    windows: np.ndarray = field(init=False)
    owner: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.windows, self.owner = window_starts(self.words.first)

    def gram_hashes(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where each distinct word begins, and n-gram hashes by size and position, ``GRAM_HASHES`` for none.

        Made when asked for: they take many times the memory of the texts.
        """
        return gram_buckets(self.words, self.which, GRAMS, GRAM_HASHES)

    @property
    def grams(self) -> list[np.ndarray]:
        return self.gram_hashes()[1]


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every window; a text of n words has windows at 0, STRIDE, ... until covered."""
    lengths = np.diff(first)
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][owner] + nth * STRIDE, owner


def prepare(texts: list[str | None]) -> Block | None:
    words = Words([t.lower() if t else t for t in texts], LETTER)
    if not len(words):
        return None
    hashes = words.hashes()
    which, number = distinct(words, hashes)
    return Block(words, number, which, hashes[which])


def _counted(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of some parts (values, counts), and their counts in all."""
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(values) else counts


def _frequent(found: list[tuple[np.ndarray, np.ndarray]], most: int, least: float) -> np.ndarray:
    """Sorted values that at least ``least`` documents hold, the ``most`` frequent of them."""
    values, counts = _counted(found)
    order = np.argsort(-counts, kind="stable")[:most]
    return np.sort(values[order[counts[order] >= least]])


def vocabulary(blocks_: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the n-grams that get vectors."""
    words, grams = [], []
    least = max(LEAST_DOCS, LEAST_SHARE * sum(b.words.n_texts for b in blocks_))
    for block in blocks_:
        begin, hashed = block.gram_hashes()
        size = np.diff(np.append(begin, len(hashed[0])))
        held = np.unique(block.words.doc.astype(np.int64) * len(block.word) + block.number)
        doc, word = held // len(block.word), held % len(block.word)
        words.append(np.unique(block.word[word], return_counts=True))
        spot = np.repeat(begin[word] - (np.cumsum(size[word]) - size[word]), size[word]) + np.arange(size[word].sum())
        who = np.repeat(doc, size[word])
        for g in hashed:
            # An n-gram counts once for each document.
            own = g[spot]
            order = np.lexsort((own, who))
            own, at = own[order], who[order]
            once = np.ones(len(own), dtype=bool)
            once[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1])
            grams.append(np.unique(own[once & (own != GRAM_HASHES)], return_counts=True))
        if len(grams) >= 8 * len(GRAMS):
            grams = [_counted(grams)]
    return _frequent(words, MAX_WORDS, least), _frequent(grams, MAX_GRAMS, least)


def _rank(vocab: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted vocabulary, ``len(vocab)`` for others."""
    if not len(vocab):
        return np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(vocab, values), len(vocab) - 1)
    return np.where(vocab[at] == values, at, len(vocab))


@dataclass
class Inputs:
    """Rows of the word vectors by distinct word, and rows of the n-gram vectors with the word each belongs to."""

    word: np.ndarray
    gram: np.ndarray
    gram_owner: np.ndarray


def _pack(at: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same in a quarter of the memory: 16-bit rows (MAX_GRAMS bounds them), and n-grams by word as counts."""
    return at.word, at.gram.astype(np.uint16), np.bincount(at.gram_owner, minlength=len(at.word)).astype(np.int32)


def _unpack(word: np.ndarray, gram: np.ndarray, counts: np.ndarray) -> Inputs:
    return Inputs(word, gram.astype(np.int32), np.repeat(np.arange(len(word), dtype=np.int32), counts))


class Network:
    """Parameters, forward pass, and gradients of the window scorer."""

    INPUT = WORD_DIM + CHAR_DIM

    def __init__(self, words: np.ndarray, grams: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)

        def init(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(_F)

        h = HIDDEN
        self.words, self.grams = words, grams
        self.p = {
            "word": init(len(words) + 1, WORD_DIM, scale=0.05),
            "char": init(len(grams), CHAR_DIM, scale=0.05),
            "attend": init(2 * h, scale=0.3),
            "out": init(2 * h, scale=0.3),
            "bias": np.full(1, -1.0, _F),
        }
        for d in ("f", "b"):
            self.p |= {f"W{d}": init(self.INPUT, 3 * h, scale=0.3), f"U{d}": init(h, 3 * h, scale=0.3), f"c{d}": np.zeros(3 * h, _F)}

    # Inputs -------------------------------------------------------------------

    def look_up(self, block: Block) -> Inputs:
        """Which vectors the distinct words of a block use."""
        begin, hashed = block.gram_hashes()
        size = np.diff(np.append(begin, len(hashed[0])))
        owner = np.repeat(np.arange(len(block.word)), size)
        rows = [_rank(self.grams, g) for g in hashed]
        known = [r < len(self.grams) for r in rows]
        row, word = np.concatenate([r[k] for r, k in zip(rows, known, strict=True)]), np.concatenate([owner[k] for k in known])
        order = np.argsort(word, kind="stable")
        return Inputs(_rank(self.words, block.word).astype(np.int32), row[order].astype(np.int32), word[order].astype(np.int32))

    def inputs(self, at: Inputs) -> np.ndarray:
        """Input vector of each distinct word."""
        n = len(at.word)
        mean = _sum_by(at.gram_owner, self.p["char"][at.gram], n) / np.maximum(np.bincount(at.gram_owner, minlength=n), 1).astype(_F)[:, None]
        return np.concatenate([self.p["word"][at.word], mean], axis=1)

    # Forward ------------------------------------------------------------------

    def _direction(self, d: str, x: np.ndarray, at: np.ndarray, keep: list | None) -> list[np.ndarray]:
        """States of one direction after each step.

        The padding row closes the update gate, which leaves the state as it is.
        """
        h, u = HIDDEN, self.p[f"U{d}"]
        gates = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        update, reset, new = (np.ascontiguousarray(gates[:, i * h : (i + 1) * h]) for i in range(3))
        update = np.vstack([update, np.full((1, h), 60, _F)])
        reset, new = (np.vstack([g, np.zeros((1, h), _F)]) for g in (reset, new))
        uz, ur, un = (np.ascontiguousarray(u[:, i * h : (i + 1) * h]) for i in range(3))
        state = np.zeros((at.shape[1], h), _F)
        states: list[np.ndarray] = [state] * len(at)
        for t in range(len(at)) if d == "f" else range(len(at) - 1, -1, -1):
            row = at[t]
            z = state @ uz
            z += update.take(row, axis=0)
            z = _sigmoid(z)
            r = state @ ur
            r += reset.take(row, axis=0)
            r = _sigmoid(r)
            s = state @ un
            n = r * s
            n += new.take(row, axis=0)
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, state, z, r, s, n))
            state = states[t] = n + z * (state - n)
        return states

    def forward(self, x: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; ``at`` (steps, windows) holds input rows, ``len(x)`` for padding."""
        sides = []
        for d in ("f", "b"):
            trace: list | None = None if keep is None else []
            sides.append(self._direction(d, x, at, trace))
            if keep is not None:
                keep[d] = trace
        h = HIDDEN
        pool = np.stack([self.p["attend"], self.p["out"]], axis=1)
        heads = np.stack([f @ pool[:h] + b @ pool[h:] for f, b in zip(*sides, strict=True)])
        energy = np.where(at < len(x), heads[:, :, 0], _F(-1e9))
        value = heads[:, :, 1]
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        if keep is not None:
            keep |= {"sides": sides, "weight": weight, "value": value}
        return (weight * value).sum(axis=0) + self.p["bias"][0]

    @staticmethod
    def steps(block: Block, windows: np.ndarray) -> np.ndarray:
        """Input rows of the windows ``windows`` of a block, step by step."""
        start, owner = block.windows[windows], block.owner[windows]
        index = start[None, :] + np.arange(WINDOW)[:, None]
        inside = index < block.words.first[owner + 1][None, :]
        return np.where(inside, block.number[np.where(inside, index, 0)], len(block.word))

    def logits(self, block: Block, x: np.ndarray | None = None, chunk: int = 4096) -> np.ndarray:
        """Logit of every window of a block."""
        x = self.inputs(self.look_up(block)) if x is None else x
        out = np.empty(len(block.windows), _F)
        for i in range(0, len(out), chunk):
            rows = np.arange(i, min(i + chunk, len(out)))
            out[rows] = self.forward(x, self.steps(block, rows))
        return out

    # Backward -----------------------------------------------------------------

    def gradients(self, block: Block, look: Inputs, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean cross-entropy of some windows and its gradient by every parameter."""
        x = self.inputs(look)
        at = self.steps(block, windows)
        k: dict = {}
        logit = self.forward(x, at, k)
        norm = _F(weight.sum())
        loss = float((weight * (np.logaddexp(0, logit) - target * logit)).sum() / norm)
        d_logit = (weight * (_sigmoid(logit) - target) / norm).astype(_F)
        g = {n: np.zeros_like(v) for n, v in self.p.items()}
        h = HIDDEN
        g["bias"][0] = d_logit.sum()
        d_value = k["weight"] * d_logit
        pooled = (k["weight"] * k["value"]).sum(axis=0)
        d_energy = k["weight"] * (k["value"] - pooled) * d_logit
        d_x = np.zeros_like(x)
        a, o = self.p["attend"], self.p["out"]
        for d, part, states in (("f", slice(0, h), k["sides"][0]), ("b", slice(h, 2 * h), k["sides"][1])):
            u = self.p[f"U{d}"]
            rows, d_rows = [], []
            d_state = np.zeros((at.shape[1], h), _F)
            for t, old, z, r, s, n in reversed(k[d]):
                g["out"][part] += states[t].T @ d_value[t]
                g["attend"][part] += states[t].T @ d_energy[t]
                d_new = d_state + d_value[t][:, None] * o[part] + d_energy[t][:, None] * a[part]
                # state = n + z * (old - n);  n = tanh(x + r * s);  s = old @ U
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (old - n) * z * (1 - z)
                d_r = d_n * s * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_state = d_new * z + d_u @ u.T
                g[f"U{d}"] += old.T @ d_u
                rows.append(at[t])
                d_rows.append(np.concatenate([d_z, d_r, d_n], axis=1))
            d_gates = _sum_by(np.concatenate(rows), np.concatenate(d_rows), len(x) + 1)[: len(x)]
            g[f"W{d}"] += x.T @ d_gates
            g[f"c{d}"] += d_gates.sum(axis=0)
            d_x += d_gates @ self.p[f"W{d}"].T
        g["word"] += _sum_by(look.word, d_x[:, :WORD_DIM], len(self.words) + 1)
        each = d_x[:, WORD_DIM:] / np.maximum(np.bincount(look.gram_owner, minlength=len(x)), 1)[:, None]
        g["char"] += _sum_by(look.gram, each[look.gram_owner], len(self.grams))
        return loss, g

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text: that of its worst window, or of no evidence for a text without words."""
        out = np.full(len(texts), -np.inf)
        block = prepare(texts)
        if block is not None:
            np.maximum.at(out, block.owner, self.logits(block).astype(np.float64))
        # Without words nothing speaks for label 1.
        return np.where(np.isfinite(out), 1 / (1 + np.exp(-np.clip(out, -30, 30))), 0.0)


def _sum_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that share a number below ``n``."""
    return np.stack([np.bincount(rows, weights=values[:, j], minlength=n) for j in range(values.shape[1])], axis=1).astype(_F)


def calibrate(logit: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """(slope, shift, loss) of the logistic fit of ``y`` on ``logit`` where label 1 has the weight ``share``.

    By Newton steps on two weak priors (slope 1, shift 0), so a handful of labels, or
    labels that separate, give finite values.
    """
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    prior, center, theta = np.array([1.0, 0.1]), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + prior * (theta - center)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(prior)
        theta = theta - np.linalg.solve(bend, slope)
        theta[0] = max(theta[0], 0.05)
    z = x @ theta
    return float(theta[0]), float(theta[1]), float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())


def _blocks_of(texts: list[str], labels: np.ndarray, which: np.ndarray) -> list[tuple[Block, np.ndarray]]:
    out = []
    size = min(BATCH_CHARS, sum(len(texts[i]) for i in which) // LEAST_BATCHES + 1)
    for begin, part in blocks(pa.array([texts[i] for i in which], pa.string()), size):
        if (block := prepare(part)) is not None:
            out.append((block, labels[which[begin : begin + len(part)]]))
    return out


def _worst(block: Block, logit: np.ndarray) -> np.ndarray:
    """The window with the highest logit of each text that has any."""
    order = np.lexsort((-logit, block.owner))
    return order[np.concatenate(([True], block.owner[order][1:] != block.owner[order][:-1]))]


def train(texts: list[str], toxic: list[int], *, share: float | None = None, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit a network; with one label only, or none, scores stay near that label.

    ``share`` is the share of label 1 among all labels, that of the sample if not given.

    The recurrent part follows Adam.  The vectors follow plain gradients with
    momentum and decay, so a vector moves as far as its gradients agree: words that
    only few documents hold stay where they are instead of being learned by heart.
    The documents kept back choose the epoch and calibrate the scores.
    """
    labels = np.array(toxic, dtype=np.float64)
    n_toxic, n_clean = int(labels.sum()), int((1 - labels).sum())
    share = (n_toxic / len(labels) if len(labels) else 0.0) if share is None else share
    share = min(max(share, 0.001), 0.999)
    rng = np.random.default_rng(seed)
    kept = np.zeros(len(labels), dtype=bool)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        kept[own[KEPT_BACK - 1 :: KEPT_BACK]] = True
    dealt = rng.permutation(np.flatnonzero(~kept))
    batches, checks = _blocks_of(texts, labels, dealt), _blocks_of(texts, labels, np.flatnonzero(kept))
    net = Network(*vocabulary([b for b, _ in batches]), seed)
    if not n_toxic or not n_clean or not batches:
        net.p["out"][:] = 0
        net.p["bias"][0] = 4.0 if n_toxic else -4.0
        return net
    looked, looked_checks = [_pack(net.look_up(b)) for b, _ in batches], [_pack(net.look_up(b)) for b, _ in checks]
    for block, _ in batches + checks:
        block.words.buf = np.empty(0, dtype=np.uint8)  # looked up for good
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    weight_toxic = _F(min(n_clean / n_toxic, 3.0))
    epochs = max(epochs, min(MAX_EPOCHS, -(-LEAST_STEPS // len(batches))))
    best: tuple[float, dict[str, np.ndarray]] | None = None
    chosen: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(batches)
    for epoch in range(epochs):
        rate = 0.03 * (1 - epoch / epochs) + 0.002
        for i in rng.permutation(len(batches)):
            block, y = batches[i]
            whole = look = _unpack(*looked[i])
            hidden = rng.random(len(look.word)) < HIDDEN_WORDS
            seen = ~hidden[look.gram_owner]
            look = Inputs(np.where(hidden, len(net.words), look.word), look.gram[seen], look.gram_owner[seen])
            if epoch < SHORT_EPOCHS:
                short = np.bincount(block.owner, minlength=len(y))[block.owner] <= SHORT_WINDOWS
                worst = np.flatnonzero(short)
                if not len(worst):
                    continue
            else:
                if (epoch - SHORT_EPOCHS) % LOOK_EVERY == 0:
                    chosen[i] = _worst(block, net.logits(block, net.inputs(whole)))
                worst = chosen[i]
            target = y[block.owner[worst]].astype(_F)
            _, grads = net.gradients(block, look, worst, target, np.where(target > 0, weight_toxic, _F(1)))
            step += 1
            for name, g in grads.items():
                if name in ("word", "char"):
                    first[name] = _F(0.9) * first[name] + g
                    net.p[name] = net.p[name] * _F(1 - VECTOR_DECAY) - _F(rate * VECTOR_RATE) * first[name]
                    continue
                first[name] = _F(0.9) * first[name] + _F(0.1) * g
                second[name] = _F(0.99) * second[name] + _F(0.01) * g * g
                net.p[name] = net.p[name] - _F(rate) * (first[name] / _F(1 - 0.9**step)) / (np.sqrt(second[name] / _F(1 - 0.99**step)) + _F(1e-5))
        if 2 * epoch >= epochs - 1 and (epochs - 1 - epoch) % 2 == 0:
            found = [(net.logits(b, net.inputs(_unpack(*look))), b, y) for (b, y), look in zip(checks, looked_checks, strict=True)]
            logit = np.concatenate([v[_worst(b, v)] for v, b, _ in found] or [np.empty(0)]).astype(np.float64)
            y = np.concatenate([y[b.owner[_worst(b, v)]] for v, b, y in found] or [np.empty(0)])
            if not len(y) or y.min() == y.max():
                # Too few labels to calibrate on: the weights overstate label 1, so shift the odds to its share.
                slope, shift, loss = 1.0, float(np.log(share / (1 - share)) - np.log(weight_toxic * n_toxic / n_clean)), -float(epoch)
            else:
                slope, shift, loss = calibrate(logit, y, share)
            if best is None or loss < best[0]:
                best = loss, {k: v.copy() for k, v in net.p.items()} | {"out": net.p["out"] * _F(slope), "bias": net.p["bias"] * _F(slope) + _F(shift)}
    net.p = best[1]
    return net


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Fit on a bounded sample of labelled documents, in one task of an executor.

    At most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents are taken, by a hash of
    the id, so the sample is the same however the rows are dealt; of each label they
    hold ``SAMPLE_BYTES`` bytes and one document at most, and no length is left out.
    Equal rows count once.  A document with several label rows has the highest;
    labels other than 0 and 1, null labels, null ids and empty texts teach nothing.
    """
    judged = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    text = F.col(text_col)
    rows = docs.where(F.length(text) > 0).select(F.col(id_col).alias("_id"), text.alias("text"), F.xxhash64(text).alias("k"))
    sizes = {r["y"]: r["n"] for r in judged.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bound = {0: SAMPLE_CLEAN, 1: SAMPLE_TOXIC}
    h = F.shiftrightunsigned(F.xxhash64("_id", F.lit("toxicity sample")), 11)
    wanted = F.lit(False)
    for y, n in sizes.items():
        # Twice the number wanted, since a labelled document may be missing.
        wanted = wanted | ((F.col("y") == y) & (h < int(min(1.0, 2.0 * bound[y] / n) * 2**53)))
    chosen = judged.where(wanted).select("_id", "y", h.alias("h"))
    sample = bounded_sample(rows.join(F.broadcast(chosen), "_id"), "y", {y: (n, SAMPLE_BYTES) for y, n in bound.items()}, rows, ["_id", "k"])
    n_all = sum(sizes.values())
    share = sizes.get(1, 0) / n_all if n_all else None

    def fit(table: pa.Table) -> Network:
        at = np.lexsort((table.column("k").to_numpy(), table.column("h").to_numpy()))
        table = table.take(pa.array(at))
        return train(table.column("text").to_pylist(), table.column("y").to_pylist(), share=share)

    return fit_remotely(sample.select("text", "y", "h", "k"), fit)


def score_documents(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every row's id, ``score`` (0 to 1, its worst window) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts, and texts without a letter, score 0.  Rows are
    independent: repeated rows, ties, null ids and skew have no effect, and an empty
    table gives an empty result.  A very long text is scored in windows like any
    other; the memory needed is in proportion to the longest text of a batch.
    Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # size: fixed by MAX_WORDS and MAX_GRAMS, about 1.5 MB

    def scores(column: pa.Array) -> np.ndarray:
        out = [shared.value.score(texts) for _, texts in blocks(column, SCORE_CHARS)]
        return np.concatenate(out) if out else np.empty(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = scores(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(flat, pa.float64()), pa.array((flat >= threshold).astype(np.int32), pa.int32())], names=[id_col, "score", "predicted"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {id_type}, score double, predicted int")
