"""Language identification of whole texts, mixed ones included.

Every word gets a log-likelihood for each learned language from hashed character
n-grams (byte n-grams with word edges).  Its script, read off fixed code-point
ranges, first narrows the languages it may belong to.  A Viterbi pass over the
words of a text, with a penalty for every change of language, then labels spans;
the text's language is the one that holds most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.session import bounded_sample, fit_remotely
from lakeglass.llm.textbatch import LETTER, Words, blocks, tidy
from lakeglass.llm.wordgrams import distinct, gram_buckets

UNKNOWN = "und"
GRAMS = (1, 2, 3, 4)
#: Hash values of n-grams: fewer where there are so many languages that a model would exceed MODEL_BYTES.
N_BUCKETS, LEAST_BUCKETS = 1 << 16, 1 << 10
MODEL_BYTES = 64_000_000
#: More languages than this are an error.
MAX_LANGUAGES = 8192
#: Nats that a change of language costs.
SWITCH = 12.0
#: Score of a language that is not written in a word's script.
EXCLUDED = -40.0
#: Documents that the model is fitted on, spread evenly over the languages (at least LEAST_DOCS of each), and their bytes.
SAMPLE_DOCS, LEAST_DOCS = 2400, 4
SAMPLE_BYTES = 16_000_000
#: Characters labelled together; longer blocks share the steps of the Viterbi pass.
PREDICT_CHARS = 400_000

# First code point of a range, and its script. Latin until the first, neutral for symbols.
SCRIPTS = (
    (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "neutral"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = ["Latin", "neutral", *sorted({n for _, n in SCRIPTS} - {"Latin", "neutral"})]
_CODE = np.array([0, *(_NAMES.index(n) for _, n in SCRIPTS)])
_NEUTRAL = 1


def word_scripts(words: Words, which: np.ndarray) -> np.ndarray:
    """Script number of each word: that of its first character beyond Latin, else Latin."""
    out = np.zeros(len(which), dtype=np.int64)
    high = np.flatnonzero(words.buf >= 0xCD)
    if not len(high):
        return out
    at = np.searchsorted(high, words.start[which])
    has = at < len(high)
    has[has] = high[at[has]] < words.end[which][has]
    pos = high[at[has]]
    b = words.buf.astype(np.int64)
    last = len(b) - 1
    b0, b1, b2 = b[pos], b[np.minimum(pos + 1, last)] & 63, b[np.minimum(pos + 2, last)] & 63
    point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, 0x20000))
    code = _CODE[np.searchsorted(_STARTS, point, side="right")]
    out[has] = np.where(point >= 0x20000, _NAMES.index("Han"), code)
    return out


@dataclass
class Model:
    """Languages, log-probabilities by bucket (one zero row at the end), and languages by script.    """

    languages: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Log-likelihoods, relative to the best language, of the words ``which``."""
        begin, grams = gram_buckets(words, which, GRAMS, len(self.table) - 1)
        total = self.table[grams[0]]
        for g in grams[1:]:
            total = total + self.table[g]
        s = np.add.reduceat(total, begin, axis=0) / np.float32(len(GRAMS))
        scripts = word_scripts(words, which)
        allowed = self.allowed[scripts]
        allowed[~allowed.any(axis=1)] = True
        s = np.where(allowed, s, s.max(axis=1, keepdims=True) + np.float32(EXCLUDED))
        s -= s.max(axis=1, keepdims=True)
        s[scripts == _NEUTRAL] = 0
        return s.astype(np.float32)

    def spans(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(language number of every word, the words' scores)."""
        which, number = distinct(words, words.hashes())
        scores = self.word_scores(words, which)[number]
        return viterbi(scores, words.first, SWITCH), scores

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 for a text without letters."""
        words = Words(texts, LETTER)
        n = len(texts)
        if not self.languages or not len(words):
            return [UNKNOWN] * n, [0.0] * n
        labels, scores = self.spans(words)
        letters = (words.end - words.start).astype(np.float64)
        k = len(self.languages)
        held = np.bincount(words.doc * k + labels, weights=letters, minlength=n * k).reshape(n, k)
        sums = np.stack([np.bincount(words.doc, weights=scores[:, j], minlength=n) for j in range(k)], axis=1)
        best = held.argmax(axis=1)
        rows = np.arange(n)
        share = held[rows, best] / np.maximum(held.sum(axis=1), 1)
        if len(self.languages) > 1:
            others = sums.copy()
            others[rows, best] = -np.inf
            margin = sums[rows, best] - others.max(axis=1)
        else:
            margin = np.full(n, 30.0)
        score = share / (1 + np.exp(-np.clip(margin, -30, 30)))
        # A text may hold only characters beyond ASCII, which need not be letters.
        ascii_letter = np.zeros(n, dtype=bool)
        ascii_letter[words.doc[words.buf[words.start] < 128]] = True
        for i in np.flatnonzero(~ascii_letter):
            if not any(c.isalpha() for c in texts[i] or ""):
                score[i], best[i] = 0.0, -1
        return [UNKNOWN if b < 0 else self.languages[b] for b in best], [float(s) for s in score]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every row where changing the label within a text costs ``penalty``.

    Text ``d`` has the rows ``first[d]`` to ``first[d + 1]``.  All texts advance
    together, the longest first, so each step is a few operations on the texts that
    still have words.  Ties stay with the label at hand, then the smaller label.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    if not len(scores):
        return np.empty(0, dtype=np.int64)
    steps = int(lengths[order[0]])
    alive = np.searchsorted(-lengths[order], -np.arange(steps), side="left")  # texts longer than each step
    offset = np.cumsum(alive) - alive
    # Rows laid out step by step, within a step the longest text first.
    step = np.arange(len(scores)) - np.repeat(first[:-1], lengths)
    row = offset[step] + np.repeat(place, lengths)
    laid = np.empty_like(scores)
    laid[row] = scores
    n_labels = scores.shape[1]
    kind = np.int8 if n_labels <= 127 else np.int16
    own = np.arange(n_labels, dtype=kind)
    came = np.empty(scores.shape, dtype=kind)
    last = np.empty(alive[0], dtype=np.int64)
    value = laid[: alive[0]].copy()
    for t in range(1, steps):
        n = alive[t]
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        here = slice(offset[t], offset[t] + n)
        top = value.argmax(axis=1)
        jump = value[np.arange(n), top][:, None] - penalty
        came[here] = np.where(value >= jump, own, top[:, None])
        value = np.maximum(value, jump)
        value += laid[here]
    last[: len(value)] = value.argmax(axis=1)
    found = np.empty(len(scores), dtype=np.int64)
    state = last.copy()
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        found[offset[t] : offset[t] + n] = state[:n]
        if t:
            state[:n] = came[offset[t] : offset[t] + n][np.arange(n), state[:n]]
    return found[row]


def fit(texts: list[str], languages: list[str]) -> Model:
    """Fit the n-gram table on labelled texts; no texts give a model without languages."""
    names = sorted(set(languages))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; {MAX_LANGUAGES} is the most")
    n_buckets = N_BUCKETS
    while n_buckets > LEAST_BUCKETS and 4 * n_buckets * len(names) > MODEL_BYTES:
        n_buckets //= 2
    table = np.zeros((n_buckets + 1, len(names)), dtype=np.float32)
    allowed = np.zeros((len(_NAMES), len(names)), dtype=bool)
    by_name: dict[str, list[str]] = {}
    for t, x in zip(texts, languages, strict=True):
        by_name.setdefault(x, []).append(t)
    for k, name in enumerate(names):
        counts = np.full(n_buckets + 1, 0.0)
        scripts = np.zeros(len(_NAMES))
        for _, block in blocks(pa.array(by_name[name], pa.string())):
            words = Words(block, LETTER)
            if not len(words):
                continue
            which, number = distinct(words, words.hashes())
            # Damped counts: a word that one document repeats should not rule.
            often = np.sqrt(np.bincount(number))
            begin, grams = gram_buckets(words, which, GRAMS, n_buckets)
            weight = np.repeat(often, np.diff(np.append(begin, len(grams[0]))))
            for g in grams:
                counts += np.bincount(g, weights=weight, minlength=n_buckets + 1)
            scripts += np.bincount(word_scripts(words, which), weights=often, minlength=len(_NAMES))
        counts = counts[:n_buckets]
        table[:n_buckets, k] = np.log((counts + 0.05) / (counts.sum() + 0.05 * n_buckets))
        allowed[:, k] = scripts >= 0.01 * max(scripts.sum(), 1)
    return Model(names, table, allowed)


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a bounded sample, in one task of an executor.

    The sample takes the same number of documents from every language (``sample_docs``
    in all, at least ``LEAST_DOCS`` of each), chosen by a hash of the id, so it is the
    same however the rows are dealt; of each language they hold its part of
    ``SAMPLE_BYTES`` and one document at most, and no length is left out.  Equal rows
    count once.  Null languages and null or empty texts teach nothing; no language is
    ever left out.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("k")
    )
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = sizes.count()
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"{n_langs} languages; {MAX_LANGUAGES} is the most")
    each = max(LEAST_DOCS, sample_docs // max(n_langs, 1))
    # A language's first rows by hash: three times the number wanted, on average, so that none is missed.
    h = F.shiftrightunsigned(F.xxhash64("_id", "k", F.lit("language sample")), 11)
    thin = usable.withColumn("h", h).join(F.broadcast(sizes), "lang").where(F.col("h") <= F.least(F.lit(1.0), F.lit(3.0 * each + 20) / F.col("n")) * F.lit(float(2**53)))
    sample = bounded_sample(thin, "lang", (each, SAMPLE_BYTES // max(n_langs, 1)), usable.drop("lang"), ["_id", "k"])

    def fit_table(table: pa.Table) -> Model:
        at = np.lexsort((table.column("k").to_numpy(), table.column("h").to_numpy()))
        table = table.take(pa.array(at))
        return fit(table.column("text").to_pylist(), table.column("lang").to_pylist())

    return fit_remotely(sample.select("text", "lang", "h", "k"), fit_table)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its ``id_col``, ``lang_pred`` and ``score`` (0 to 1).

    A null or empty text, or one without letters, is ``und`` with score 0, and so
    is every text where nothing could be learned.  The score is the share of the
    letters in spans of the language, times the odds of it against the next best
    over the whole text.  Rows are independent of each other, so ties, repeated rows
    and null ids have no effect, and an empty table gives an empty result.  A very
    long text is labelled as a whole; the memory needed is in proportion to the
    longest text of a batch times the languages.  Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size: MODEL_BYTES at most

    def predict(column: pa.Array) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        most = max(100_000, PREDICT_CHARS * 4 // max(4, len(shared.value.languages)))
        for _, texts in blocks(column, most):
            a, b = shared.value.predict(texts)
            langs += a
            scores += b
        return langs, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {id_type}, lang_pred string, score double")
