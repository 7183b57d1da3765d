"""Toxicity by class-conditional Kneser-Ney models and length-normalised log-likelihoods.

Two bigram models, one of toxic and one of ordinary texts, share what they back
off to:

    P_c(w | v) = max(n_c(v w) - D2, 0) / n_c(v)  +  rest_c(v) P_c(w)
    P_c(w)     = max(k_c(w) - D1, 0) / K_c       +  rest_c P(w)
    P(w)       = max(k(w) - D, 0) / K            +  rest / (V + 1)

``rest`` is what the discounts leave, so each sums to one. Counts are of
dispersion, as Kneser and Ney count contexts: ``n_c`` counts the texts of a class
that hold a bigram, ``k_c`` those that hold a word, ``k`` those of either class.
An expression of at most ``D`` texts has no mass of its own class left, only the
shared one, so rare expressions say nothing about the class. A text of
``n`` words has

    mean    of log P_toxic(w | v) - log P_ordinary(w | v) over its words
    excess  sum of what exceeds 1 in them, over the square root of n
    peak    the largest of them

and a logistic function of these three, weighted to the classes' shares, gives the
score. It is fitted to texts that were not counted: each of ``FOLDS`` parts of the sample gets
its features from the counts of the others, and ``D1`` and ``D2`` are those of the lowest log loss.
With a single text of a class its features come from all counts.

Sample. Only the fit is bounded: for each class, the distinct texts of lowest hash
whose characters and number stay within ``sample_chars`` and ``sample_texts``.
The cut is found by counting all labelled rows; equal texts count once, and a text
with both labels counts for both. Scoring reads every whole text, in slices.

Rows: a NULL, empty or word-less text scores the share of toxic among the labelled
texts; without any label that is 0, and with one class only, all texts score its
share (0 or 1). Repeated rows score alike. A NULL id has no label but is scored.
Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stored

SAMPLE_CHARS = 6_000_000
SAMPLE_TEXTS = 20_000
FOLDS = 5
WORD_DISCOUNTS = (0.75, 2.0, 4.0, 8.0, 16.0)
PAIR_DISCOUNTS = (16.0, 64.0, 256.0)
SHARED_DISCOUNT = 0.7
RIDGE = 1.0
SLICE = 1 << 20
#: Places of the cut's histogram in each class; the cut lies below twice the expected share.
PLACES = 256
_START = 0
_words = re.compile(r"[^\W_]+").findall


def slices(text: str, size: int = SLICE):
    """The lower-cased words of ``text``, in lists; a list ends at white space."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= size else text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield _words(text[at:end].lower())
        at = end


@dataclass
class Model:
    """``share`` alone stands for texts without words, or where there are no two classes."""

    share: float = 0.0
    words: dict[str, int] = field(default_factory=dict)
    pairs: np.ndarray | None = None
    #: For ordinary and toxic: P(w) by word, with the unknown word last; rest(v) likewise; P(w | v) without backoff by pair.
    single: list[np.ndarray] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)
    joint: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None

    def encode(self, words: list[str], before: int) -> np.ndarray:
        out = np.fromiter(map(self.words.get, words, [-1] * len(words)), np.int64, len(words))
        return np.concatenate([[before], out])

    def ratios(self, ids: np.ndarray) -> np.ndarray:
        """log P_toxic - log P_ordinary of every id but the first, which is only a context."""
        v, w = ids[:-1], ids[1:]
        return log_ratio(self.single, self.rest, self.joint, v, w, *find_pairs(self.pairs, len(self.rest[0]), v, w))

    def features(self, text: str | None) -> np.ndarray | None:
        """Mean, excess and peak; None without words."""
        n, total, excess, peak, before = 0, 0.0, 0.0, -np.inf, _START
        for words in slices(text or ""):
            if words:
                ids = self.encode(words, before)
                r = self.ratios(ids)
                n, total, before = n + len(r), total + r.sum(), ids[-1]
                excess, peak = excess + np.maximum(r - 1, 0).sum(), max(peak, r.max())
        return np.array([total / n, excess / np.sqrt(n), peak]) if n else None

    def score(self, text: str | None) -> float:
        x = None if self.weights is None else self.features(text)
        return self.share if x is None else float(_sigmoid(np.append(x, 1.0) @ self.weights))


def find_pairs(pairs: np.ndarray, size: int, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of (v, w) in the sorted ``pairs``, and whether they are there."""
    pair = np.where((v >= 0) & (w >= 0), v * size + w, -1)
    at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
    return at, pairs[at] == pair


def log_ratio(single, rest, joint, v, w, at, seen) -> np.ndarray:
    ordinary, toxic = (np.where(seen, joint[c][at], 0) + rest[c][v] * single[c][w] for c in (0, 1))
    return np.log(toxic) - np.log(ordinary)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def encode(texts: list[str], words: dict[str, int]) -> list[np.ndarray]:
    """Ids of each text, with the start mark first; new words get the next id."""
    out = []
    for text in texts:
        ids = [_START]
        for found in slices(text):
            ids += [words.setdefault(w, len(words) + 1) for w in found]
        out.append(np.array(ids, np.int64))
    return out


class Counts:
    """Dispersion counts of both classes, from which models of any discounts are made.

    ``size`` ids are known in all; those that no counted text holds are as unknown as any other word.
    """

    def __init__(self, ids: tuple[list[np.ndarray], list[np.ndarray]], size: int):
        self.size, none = size, [np.zeros(0, np.int64)]
        pairs = [np.concatenate([np.unique(a[:-1] * size + a[1:]) for a in of] or none) for of in ids]
        self.texts_of = [np.bincount(np.concatenate([np.unique(a[1:]) for a in of] or none), minlength=size) for of in ids]
        self.pairs = np.unique(np.concatenate(pairs))
        self.uses = [np.bincount(np.searchsorted(self.pairs, p), minlength=len(self.pairs)) for p in pairs]

    def shared(self) -> np.ndarray:
        """P(w), the unknown word last."""
        k = self.texts_of[0] + self.texts_of[1]
        rest = SHARED_DISCOUNT * (k > 0).sum() / k.sum()
        even = rest / ((k > 0).sum() + 1)
        return np.append(np.maximum(k - SHARED_DISCOUNT, 0) / k.sum() + even, even)

    def single(self, c: int, discount: float) -> np.ndarray:
        k, shared = self.texts_of[c], self.shared()
        return (np.append(np.maximum(k - discount, 0), 0) + np.minimum(k, discount).sum() * shared) / k.sum()

    def pair(self, c: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """rest(v), the unknown word last, and what a pair keeps."""
        n, v = self.uses[c], self.pairs // self.size
        total = np.bincount(v, n, minlength=self.size)
        left = np.bincount(v, np.minimum(n, discount), minlength=self.size)
        rest = np.where(total > 0, left / np.maximum(total, 1), 1.0)
        return np.append(rest, 1.0), np.maximum(n - discount, 0) / np.maximum(total, 1)[v]

    def model(self, words: dict[str, int], share: float, word_discount: float, pair_discount: float) -> Model:
        pairs = [self.pair(c, pair_discount) for c in (0, 1)]
        # A pair that no class keeps falls back like one that was never seen.
        kept = (pairs[0][1] > 0) | (pairs[1][1] > 0)
        kept[:1] = True
        v, w = self.pairs[kept] // self.size, self.pairs[kept] % self.size
        return Model(
            share, words, v * (self.size + 1) + w, [self.single(c, word_discount) for c in (0, 1)],
            [rest for rest, _ in pairs], [joint[kept] for _, joint in pairs],
        )

    def features(self, ids: list[np.ndarray]) -> dict[tuple[float, float], np.ndarray]:
        """Mean, excess and peak of texts by every pair of discounts."""
        v, w = np.concatenate([a[:-1] for a in ids]), np.concatenate([a[1:] for a in ids])
        at, seen = find_pairs(self.pairs, self.size, v, w)
        n = np.array([len(a) - 1 for a in ids])
        starts = np.cumsum(n) - n
        singles = {d: [self.single(c, d) for c in (0, 1)] for d in WORD_DISCOUNTS}
        out = {}
        for e in PAIR_DISCOUNTS:
            rest, joint = zip(*(self.pair(c, e) for c in (0, 1)))
            for d, single in singles.items():
                r = log_ratio(single, rest, joint, v, w, at, seen)
                excess = np.add.reduceat(np.maximum(r - 1, 0), starts) / np.sqrt(n)
                out[d, e] = np.column_stack([np.add.reduceat(r, starts) / n, excess, np.maximum.reduceat(r, starts)])
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps with a ridge on standardised columns; the weights and the log loss."""
    scale = np.append(x.std(axis=0) + 1e-9, 1.0)
    z = np.column_stack([x, np.ones(len(x))]) / scale
    weight = weight / weight.mean()
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = _sigmoid(z @ w)
        slope = z.T @ (weight * (p - y)) + RIDGE * w
        bend = (z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + RIDGE * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    p = _sigmoid(z @ w)
    return w / scale, float(-(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).mean())


def fit(sample: list[tuple[int, int, str]], sizes: tuple[int, int]) -> Model:
    """From ``(hash, class, text)`` in order of hash; ``sizes`` are the numbers of labelled texts of each class."""
    share, words = sizes[1] / max(1, sum(sizes)), {}
    ids = encode([t for _, _, t in sample], words)
    classes = [[a for a, (_, k, _) in zip(ids, sample) if k == c and len(a) > 1] for c in (0, 1)]
    if not all(classes):
        return Model(share)
    size = len(words) + 1
    folds = range(FOLDS) if min(map(len, classes)) > 1 else [None]
    x, y = {}, []
    for f in folds:
        others = [[a for i, a in enumerate(of) if f is None or i % FOLDS != f] for of in classes]
        own = [[a for i, a in enumerate(of) if f is None or i % FOLDS == f] for of in classes]
        if own[0] or own[1]:
            y += [c for c in (0, 1) for _ in own[c]]
            for d, features in Counts(others, size).features(own[0] + own[1]).items():
                x.setdefault(d, []).append(features)
    y = np.array(y)
    weight = (np.array(sizes) / np.array([len(of) for of in classes]))[y]
    fitted = {d: fit_logistic(np.concatenate(rows), y, weight) for d, rows in x.items()}
    best = min(fitted, key=lambda d: fitted[d][1])
    model = Counts(classes, size).model(words, share, *best)
    model.weights = fitted[best][0]
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str) -> DataFrame:
    """Distinct ``(hash, class, chars)`` of the labelled texts that may be learnt from."""
    marks = labels.where(F.col(label).isNotNull()).select(key, (F.col(label) > 0).cast("int").alias("_class")).distinct()
    texts = docs.where(learn & (F.length(text) > 0)).select(
        key, F.xxhash64(text).alias("_hash"), F.length(text).cast("bigint").alias("_chars")
    )
    return texts.join(marks, key).select("_hash", "_class", "_chars").distinct()


def _cuts(found: DataFrame, most_chars: int, most_texts: int) -> tuple[tuple[int, int], dict[int, float]]:
    """The classes' sizes, and up to which place in [0, 1) of its hash a text is in the sample."""
    u = F.shiftrightunsigned("_hash", 11) / float(1 << 53)
    totals = found.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_chars").alias("chars")).collect()
    sizes, share = [0, 0], {}
    for r in totals:
        sizes[r["_class"]] = r["n"]
        share[r["_class"]] = min(1.0, 2 * most_chars / max(1, r["chars"]), 2 * most_texts / r["n"])
    if not share:
        return (0, 0), {}
    width = F.when(F.col("_class") == 0, share.get(0, 1.0)).otherwise(share.get(1, 1.0)) / PLACES
    place = F.floor(u / width)
    counted = (
        found.withColumn("_place", place).where(F.col("_place") < PLACES)
        .groupBy("_class", "_place").agg(F.count(F.lit(1)).alias("n"), F.sum("_chars").alias("chars")).collect()
    )
    cuts = {}
    for c, s in share.items():
        held, texts, end = 0, 0, PLACES
        for r in sorted((r for r in counted if r["_class"] == c), key=lambda r: r["_place"]):
            held, texts = held + r["chars"], texts + r["n"]
            if held > most_chars or texts > most_texts:
                end = r["_place"]
                break
        cuts[c] = s * end / PLACES
    return (sizes[0], sizes[1]), cuts


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_chars: int = SAMPLE_CHARS, sample_texts: int = SAMPLE_TEXTS,
) -> Model:
    """Fit on the rows of ``docs`` for which ``learn`` holds and that ``labels`` marks."""
    found = stored(labelled_texts(docs, labels, learn, key, text, label), "toxicity")
    sizes, cuts = _cuts(found, sample_chars, sample_texts)
    u = F.shiftrightunsigned("_hash", 11) / float(1 << 53)
    chosen = found.where(u < F.when(F.col("_class") == 0, cuts.get(0, 0.0)).otherwise(cuts.get(1, 0.0)))
    texts = docs.select(F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).join(
        F.broadcast(chosen.select("_hash", "_class")), "_hash"  # at most sample_texts rows a class
    )
    rows = texts.groupBy("_hash", "_class").agg(F.min("_text").alias("_text")).collect()
    return fit(sorted((r["_hash"] % (1 << 64), r["_class"], r["_text"]) for r in rows), sizes)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` key and ``score``; row-local."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [sent.value.score(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(scores, pa.float64())], names=["_key", "score"]
            )

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"`{key}` {kind}, score double"
    )
