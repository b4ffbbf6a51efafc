"""Reading level of each document (P8).

Method: every sentence's level is classified with a regularised softmax model over words and the character n-grams of
words; the sentence distributions are averaged by words and a second, small softmax model calibrates the document's
band. The calibrator is trained on distributions that a model gave to sentences it had not seen (two halves).

Both models are linear, so a word's part in a sentence's scores is a constant: a Python worker keeps one row of
scores per known word, and a batch of documents costs a table lookup and two segment sums. Letter case and
punctuation are not features, sentences without marks are cut by their number of words, and layout is not read.

Training takes a bounded sample of labelled documents (``most``); the broadcast models have a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import slices
from corpusloom.llm.language import language_scores

BANDS = 4
#: Hash buckets of the features, words of a sentence part, and labelled documents used for training.
BUCKETS, PART, MOST = 1 << 15, 12, 1500
LEAST_WORDS = 30
_OUTER = " .,;:!?\"'“”‘’«»()[]{}*-–—•=#_/\\<>|।…"
_LANGUAGES = ("en", "fr", "de", "es", "it", "pt", "nl", "si", "ta", "other")


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams of 3 to 5."""
    w = f"<{word}>"
    grams = {f"={word}"} | {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in grams]


class Words:
    """A table of raw tokens: normal form, whether it is a word, whether it ends a sentence, its language evidence."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = weights
        self.of: dict[str, int] = {}
        self.form: list[str] = []
        self.rows = [np.zeros((1 << 12, k), np.float32) for k in (BANDS, len(_LANGUAGES) + 2)]

    def add(self, new: list[str]) -> None:
        for raw in new:
            i = self.of[raw] = len(self.form)
            core = raw.strip(_OUTER).lower()
            word = "0" if any(c.isdigit() for c in core) else core
            self.form.append(word)
            if i == len(self.rows[0]):
                self.rows = [np.concatenate([r, np.zeros_like(r)]) for r in self.rows]
            if word and self.weights is not None:
                self.rows[0][i] = self.weights[word_features(word)].mean(0)
            other = self.rows[1][i]
            if word:
                for k, v in language_scores(core).items():
                    other[_LANGUAGES.index(k)] = v
            other[-2] = bool(core)
            other[-1] = raw.rstrip("\"'”’)]").endswith((".", "!", "?")) or not core

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words one after another: place in the table, sentence part, document; and words per document."""
        if len(self.form) > 400_000:
            self.__init__(self.weights)
        rows = [t.split() for t in texts]
        flat = [w for r in rows for w in r]
        if new := list({w: None for w in flat if w not in self.of}):
            self.add(new)
        at = np.fromiter(map(self.of.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)))
        marks = self.rows[1][at][:, -2:] > 0
        new_sentence = np.ones(len(at), bool)
        new_sentence[1:] = marks[:-1, 1] | (doc[1:] != doc[:-1])
        sentence = np.cumsum(new_sentence) - 1
        at, doc, sentence = (x[marks[:, 0]] for x in (at, doc, sentence))
        n_words = np.bincount(doc, minlength=len(rows))
        if not len(at):
            return at, sentence, doc, n_words
        _, sentence, size = np.unique(sentence, return_inverse=True, return_counts=True)
        place = np.arange(len(at)) - (np.cumsum(size) - size)[sentence]
        parts = np.maximum(1, size // PART)[sentence]
        part = place * parts // size[sentence]
        step = np.ones(len(at), bool)
        step[1:] = (sentence[1:] != sentence[:-1]) | (part[1:] != part[:-1])
        return at, np.cumsum(step) - 1, doc, n_words


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _segment_sum(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], 1)


def fit_softmax(x, xt, y: np.ndarray, weight: np.ndarray, size: int, penalty: float, rounds: int, rate: float) -> np.ndarray:
    """Softmax regression by Adam on whole gradients; x maps weights to scores, xt score gradients to weight gradients."""
    w = np.zeros((size, y.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = xt((_softmax(x(w)) - y) * weight[:, None]) / weight.sum() + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit_sentences(table: Words, at: np.ndarray, part: np.ndarray, doc: np.ndarray, y: np.ndarray, penalty: float = 1e-6, rounds: int = 80) -> np.ndarray:
    """Bucket weights of the sentence model; y: one distribution over bands per document, passed on to its sentence parts."""
    used, col = np.unique(at, return_inverse=True)
    parts, row = np.unique(part, return_inverse=True)
    feats = [word_features(table.form[i]) for i in used]
    f_row, f_col = np.repeat(np.arange(len(used)), [len(f) for f in feats]), np.concatenate(feats)
    f_val = np.repeat([1 / len(f) for f in feats], [len(f) for f in feats])
    n = np.bincount(row)
    val = 1 / np.sqrt(n[row])
    target = np.zeros((len(parts), BANDS))
    target[row] = y[doc]

    def x(w: np.ndarray) -> np.ndarray:
        by_word = _segment_sum(w[f_col] * f_val[:, None], f_row, len(used))
        return _segment_sum(by_word[col] * val[:, None], row, len(parts))

    def xt(r: np.ndarray) -> np.ndarray:
        by_word = _segment_sum(r[row] * val[:, None], col, len(used))
        return _segment_sum(by_word[f_row] * f_val[:, None], f_col, BUCKETS)

    return fit_softmax(x, xt, target, n.astype(float), BUCKETS, penalty, rounds, 0.5)


def document_features(scores: np.ndarray, part: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, weighted by words: mean distribution of its sentence parts, share of each band, a constant."""
    if not len(part):
        return np.zeros((n_docs, 2 * BANDS + 1))
    n = np.bincount(part)
    p = _softmax(_segment_sum(scores, part, len(n)) / np.sqrt(n)[:, None])
    of = np.zeros(len(n), np.int64)
    of[part] = doc
    hard = np.eye(BANDS)[p.argmax(1)]
    total = np.maximum(np.bincount(of, n, n_docs), 1)[:, None]
    return np.concatenate([_segment_sum(np.concatenate([p, hard], 1) * n[:, None], of, n_docs) / total, np.ones((n_docs, 1))], 1)


class Model:
    """Bucket weights of the sentence model and weights of the calibrator."""

    def __init__(self, texts: list[str], y: np.ndarray, rounds: int = 80) -> None:
        table = Words()
        at, part, doc, _ = table.read(texts)
        half = np.random.default_rng(0).permutation(len(texts)) % 2
        features = np.zeros((len(texts), 2 * BANDS + 1))
        for h in (0, 1):
            learn = half[doc] == h
            if learn.any() and not learn.all():
                w = fit_sentences(table, at[learn], part[learn], doc[learn], y, rounds=rounds)
                scores = self._scores(table, w, at)
                features[half != h] = document_features(scores, part, doc, len(texts))[half != h]
        self.weights = fit_sentences(table, at, part, doc, y, rounds=rounds).astype(np.float32)
        self.calibrator = fit_softmax(lambda w: features @ w, lambda r: features.T @ r, y, np.ones(len(y)), features.shape[1], 1e-3, 800, 0.1)

    @staticmethod
    def _scores(table: Words, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        used, back = np.unique(at, return_inverse=True)
        return np.stack([weights[word_features(table.form[i])].mean(0) for i in used])[back]


def bands(model: tuple[np.ndarray, np.ndarray], table: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, probabilities, words) of each text; 0 words where the text is not English."""
    at, part, doc, n_words = table.read(texts)
    spoken = _segment_sum(table.rows[1][at][:, : len(_LANGUAGES)], doc, len(texts)) if len(at) else np.zeros((len(texts), len(_LANGUAGES)))
    english = (spoken[:, 0] > 1) & (spoken[:, 0] >= spoken.max(1)) & (spoken[:, 0] * 25 >= n_words)
    p = _softmax(document_features(table.rows[0][at], part, doc, len(texts)) @ model[1])
    return p.argmax(1) + 1, p, np.where(english, n_words, 0)


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST) -> tuple[list[str], np.ndarray]:
    """At most ``most`` labelled English documents and their labels as distributions: those with the smallest hashes of doc_id."""
    votes = labels.filter(F.col("band").between(1, BANDS)).select("doc_id", "rater_id", "band").distinct().groupBy("doc_id").agg(F.collect_list("band").alias("votes"))
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").filter("text <> ''").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    y = np.array([[v.tolist().count(b) / len(v) if hasattr(v, "tolist") else list(v).count(b) / len(v) for b in range(1, BANDS + 1)] for v in rows.votes]).reshape(-1, BANDS)
    return rows.text.tolist(), y


def reading_levels(docs: DataFrame, labels: DataFrame, most: int = MOST, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, band, p1..p4, n_words) of every English document of at least ``least_words`` words.

    Null, empty and other texts give no rows; whether a text is English is read from its words, not from ``lang``.
    Labels may repeat or differ: a document's label is the distribution of its raters' bands. Without labels every
    band gets the same probability and the lowest is given. Repeated rows of ``docs`` come out repeated. An empty table gives an empty
    result. Other columns are not read.
    """
    texts, y = labelled(docs, labels, most)
    model = Model(texts, y) if texts else None
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.calibrator.astype(np.float32)) if model else (np.zeros((BUCKETS, BANDS), np.float32), np.zeros((2 * BANDS + 1, BANDS), np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words(shared.value[0])
        for whole in batches:
            for b in slices(whole):
                band, p, n = bands(shared.value, table, b.column("text").to_pylist())
                keep = n >= least_words
                yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(keep)), pa.array(band[keep], pa.int32()), *[pa.array(p[keep, k].round(6)) for k in range(BANDS)], pa.array(n[keep], pa.int32())], ["doc_id", "band", *[f"p{k + 1}" for k in range(BANDS)], "n_words"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").filter("text <> ''").mapInArrow(run, f"doc_id {kind}, band int, p1 double, p2 double, p3 double, p4 double, n_words int")
