"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

- Features are counts of the 1- to 3-grams of the lower-cased text, every run of
  non-letters being one space, hashed to ``DIMENSIONS``.
- Document frequencies are counted over all training rows.
- Weights are fitted by follow-the-regularised-leader with an elastic net on a
  bounded sample: at most ``per_language`` rows of each language and ``most_rows``
  in all, in equal shares, chosen by the hash of id and text. Rows that repeat both are one.
  The choice is made by Spark, and only what it chose reaches the driver.
  A fifth of the sample is kept back to fit the temperature.
- Whole texts are used everywhere; long ones go through in slices.

Rows: a NULL text, or one without a letter, is ``und`` with score 0, and so is
everything when no row can be learned from. Rows with NULL language are never
learned from. Repeated rows are scored alike and counted as often as they occur.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 1 << 15
SLICE = 1 << 20
PER_LANGUAGE = 1000
MOST_ROWS = 8000
MAX_LANGUAGES = 400
EPOCHS = 4

_OTHER = re.compile(r"[\W\d_]+")


def features(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams, or None without a letter."""
    clean = _OTHER.sub(" ", (text or "").lower()).strip()
    if not clean:
        return None
    codes = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.zeros(DIMENSIONS, np.int64)
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    for at in range(0, len(codes), SLICE):
        part = codes[at : at + SLICE + 2].astype(np.uint64)
        gram = part * np.uint64(0x9E3779B97F4A7C15)
        for n in (1, 2, 3):
            if n > 1:
                if len(part) < n:
                    break
                gram = (gram[:-1] ^ (part[n - 1 :] + np.uint64(n << 32))) * np.uint64(0xC2B2AE3D27D4EB4F)
            counts += np.bincount((gram[:SLICE] >> shift).astype(np.int64), minlength=DIMENSIONS)
    return counts


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIMENSIONS + 1, languages), the last row is the bias
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = (1 + np.log(counts[at])) * self.idf[at]
        return np.append(at, DIMENSIONS), np.append(x / np.sqrt(x @ x), 1.0)

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        at, x = self.vector(counts)
        p = _softmax(x @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, alpha: float = 0.5,
    beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7,
) -> np.ndarray:
    """Weights by FTRL-proximal steps over rows of (places, values, class)."""
    z, n = (np.zeros((DIMENSIONS + 1, classes)) for _ in range(2))

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, label = rows[r]
            zs, ns = z[at], n[at]
            w = weight(zs, ns)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            n[at] = ns + g * g
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
    return weight(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the lowest log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()
    low, high, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = features(text)
                if counts is not None:
                    seen += counts > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], names=["at", "n"]
        )

    summed = rows.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in summed:
        out[r["at"]] = r["n"]  # place -1 is the last: the number of documents
    return out[:-1], int(out[-1])


def _sparse(rows: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Label, order and counts of the sampled rows, on the driver."""

    def run(batches):
        for batch in batches:
            out = []
            for lang, order, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = features(text)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((lang, order, at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
            if out:
                types = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["lang", "h", "at", "n"]
                )

    found = rows.mapInArrow(run, "lang string, h bigint, at binary, n binary").toArrow()
    return [
        (r["lang"], r["h"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4"))
        for b in found.to_batches(max_chunksize=500)
        for r in b.to_pylist()
    ]


def _sample(rows: DataFrame, sizes: dict[str, int], per_language: int) -> DataFrame:
    """Up to ``per_language`` different rows of each language, those of the least hash.

    Only hashes below a bound that four times as many rows should keep are looked at, so
    however many copies a row has, few rows move and no task gets a whole language.
    """
    share = F.lit(None).cast("double")
    for name, size in sizes.items():
        share = F.when(F.col("_lang") == name, min(1.0, 4 * per_language / size)).otherwise(share)
    u = F.pmod("_h", F.lit(1 << 30)) / float(1 << 30)
    near = rows.where((u < share) & F.col("_text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h"))
    picked = near.select("_lang", "_h").distinct().withColumn("_rank", rank).where(F.col("_rank") <= per_language)
    mine = near.join(F.broadcast(picked.drop("_rank")), ["_lang", "_h"], "left_semi")
    return mine.dropDuplicates(["_lang", "_h"]).select("_lang", "_h", "_text")


def train(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS,
) -> Model | None:
    """Fit on the rows of ``docs`` for which ``learn`` holds."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.xxhash64(F.col(key), F.xxhash64(text)).alias("_h")
    )
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} language labels")
    per_language = max(1, min(per_language, most_rows // max(1, len(sizes))))
    df, n = _document_frequencies(rows.select("_text"))
    if not n:
        return None
    found = _sparse(_sample(rows, sizes, per_language))
    found.sort(key=lambda r: (r[0], r[1] % (1 << 30), r[1], r[2].tobytes(), r[3].tobytes()))
    if not found:
        return None
    languages = sorted({r[0] for r in found})
    model = Model(languages, np.log((1 + n) / (1 + df)) + 1, np.zeros((DIMENSIONS + 1, len(languages))))
    vectors = []
    for name, _, at, counts in found:
        dense = np.zeros(DIMENSIONS, np.int64)
        dense[at] = counts
        vectors.append((*model.vector(dense), languages.index(name)))
    fitted = [v for k, v in enumerate(vectors) if k % 5 or len(vectors) < 50]
    back = [v for k, v in enumerate(vectors) if k % 5 == 0 and len(vectors) >= 50]
    model.weights = fit_ftrl(fitted, len(languages))
    logits = np.array([x @ model.weights[at] for at, x, _ in back]).reshape(len(back), len(languages))
    model.temperature = fit_temperature(logits, np.array([y for _, _, y in back], int))
    return model


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` key with ``lang_pred`` and ``score``; row-local."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column("_text").to_pylist():
                counts = features(t)
                out.append(("und", 0.0) if counts is None or sent.value is None else sent.value.predict(counts))
            names, scores = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["_key", "lang_pred", "score"],
            )

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"`{key}` {kind}, lang_pred string, score double"
    )
