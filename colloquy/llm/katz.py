"""Katz backoff bigrams: Good-Turing discounts, exactly normalised backoff weights.

Model over the words seen in training, one end token per text and one unknown word:

    P(w | v) = d_c c(v w) / den(v)      where c(v w) >= min_count
             = alpha(v) P(w)            elsewhere
    P(w)     = d_c c(w) / N, or what is left for the unknown word

``d_c`` is Katz's discount for counts up to ``k``, by smoothed counts of counts, and 1 above. ``alpha(v)`` makes
the sum over all words one; ``den(v)`` is the count of ``v``, plus one where the
discounts leave nothing to back off to. A text's first word follows a start mark.
The order is two: counting trigrams as well would not fit the disk that the
check tool allows (see the README).

How it runs. Words and bigrams are counted by exchanging one request per chunk
of text and bucket: a chunk names every distinct word or bigram once, the bucket
adds up what all chunks counted, stores its part of the table and answers in the
order asked. So what moves is distinct n-grams per chunk, packed, and no word or
bigram, however frequent, has more than one entry per chunk. Chunks, buckets and
answers are bounded by parameters; their number grows with the corpus.

Words are known by 64-bit hashes: among 10**8 distinct words a collision has
probability 0.0003.

Rows: a NULL text is empty (one end token); a NULL id or repeated rows are
documents like any other; without training rows every token is unknown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stored

CHUNK_TOKENS = 1 << 21
BUCKET_WORDS = 1 << 19
DISCOUNTED = 5
MIN_COUNT = 2
#: Slope of the counts of counts where one alone is known.
ZIPF = -2.0
END = b"\n"  # white space, so no word
START = -2
UNKNOWN = -1
_ANSWER = "p bigint, kind int, bucket bigint, first binary, second binary"
_ANSWER_NAMES = ["p", "kind", "bucket", "first", "second"]


def _zip(a: np.ndarray) -> bytes:
    """Compressed by byte planes, as the high bytes of ids and counts are alike."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _rows(rows, types, names):
    columns = zip(*rows) if rows else [()] * len(names)
    return [pa.array(c, t) for c, t in zip(columns, types)], names


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def chunks(docs: DataFrame, learn: Column, key: str, text: str, chunk_tokens: int) -> DataFrame:
    """One row per chunk: its documents, their tokens as local word numbers, and its words' hashes.

    ``counts`` are the words' uses in training texts of the chunk.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, keys, learns, tokens, held = _Ids(), [], [], [], 0
        key_type = None

        def close():
            lengths = np.array([len(t) for t in tokens], np.int64)
            flat = np.concatenate(tokens)
            train = np.repeat(np.array(learns), lengths)
            counts = np.bincount(flat[train], minlength=len(ids)).astype(np.int64)
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in ids], np.uint64)
            row = ((part << 32) + number, keys, learns, lengths.tolist(), _zip(flat), _zip(hashes), _zip(counts))
            types = [pa.int64(), pa.list_(key_type), pa.list_(pa.bool_()), pa.list_(pa.int64())] + [pa.binary()] * 3
            names = ["p", "keys", "learns", "lengths", "tokens", "hashes", "counts"]
            arrays, names = _rows([row], types, names)
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, data, use in zip(*(c.to_pylist() for c in batch.columns)):
                words = data.lower().split()
                words.append(END)
                keys.append(k)
                learns.append(use)
                tokens.append(np.array([ids[w] for w in words], np.uint32))
                held += len(words)
                if held >= chunk_tokens:
                    yield close()
                    number += 1
                    ids, keys, learns, tokens, held = _Ids(), [], [], [], 0
        if keys:
            yield close()

    rows = docs.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"),
        F.coalesce(learn, F.lit(False)).alias("_learn"),
    )
    return rows.mapInArrow(
        run,
        f"p bigint, keys array<{kind}>, learns array<boolean>, lengths array<bigint>, tokens binary, "
        "hashes binary, counts binary",
    )


def _split(bucket: np.ndarray, order: np.ndarray):
    """``(bucket, places)`` runs of ``order``, which sorts by bucket."""
    sorted_buckets = bucket[order]
    starts = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]]) if len(order) else []
    for a, b in zip(starts, np.r_[starts[1:], len(order)] if len(order) else []):
        yield int(sorted_buckets[a]), order[a:b]


def _word_order(hashes: np.ndarray, buckets: int):
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    return bucket, np.lexsort((hashes, bucket))


def _word_requests(table: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for p, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("p", "hashes", "counts"))):
                hashes, counts = _unzip(hashes, np.uint64), _unzip(counts, np.int64)
                bucket, order = _word_order(hashes, buckets)
                out = [(p, b, hashes[at].tobytes(), _zip(counts[at])) for b, at in _split(bucket, order)]
                arrays, names = _rows(out, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["p", "bucket", "h", "n"])
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return table.select("p", "hashes", "counts").mapInArrow(run, "p bigint, bucket bigint, h binary, n binary")


def _count_words(requests: DataFrame) -> DataFrame:
    """Answers of kind 1 (word ids, counts) for chunks, and of kind 0 with ``p`` NULL: the bucket's table."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("p").to_pylist()
        hashes = [np.frombuffer(r["h"], np.uint64) for r in rows]
        counts = np.concatenate([_unzip(r["n"], np.int64) for r in rows])
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, counts, len(words)).astype(np.int64)
        known = total > 0
        bucket = rows[0]["bucket"]
        gid = np.where(known, (bucket << 32) + np.cumsum(known) - 1, UNKNOWN)
        out, at = [(None, 0, bucket, _zip(gid[known]), _zip(total[known]))], 0
        for r, h in zip(rows, hashes):
            asked = place[at : at + len(h)]
            at += len(h)
            out.append((r["p"], 1, bucket, _zip(gid[asked]), _zip(total[asked])))
        return _answer_table(out)

    return requests.groupBy("bucket").applyInArrow(run, _ANSWER)


def _answer_table(rows) -> pa.Table:
    arrays, names = _rows(rows, [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], _ANSWER_NAMES)
    return pa.Table.from_arrays(arrays, names=names)


def _word_table(answers: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, second in zip(*(batch.column(c).to_pylist() for c in ("first", "second"))):
                arrays = [pa.array(_unzip(first, np.int64)), pa.array(_unzip(second, np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "uses"])

    return answers.where("kind = 0").select("first", "second").mapInArrow(run, "word bigint, uses bigint")


class _Chunk:
    """A chunk's tokens with the answers it got."""

    def __init__(self, row: dict, answers: list[dict], word_buckets: int):
        self.row = row
        self.hashes = _unzip(row["hashes"], np.uint64)
        self.tokens = _unzip(row["tokens"], np.uint32).astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.order = _word_order(self.hashes, word_buckets)[1]
        self.gid = self.in_order(answers, 1, "first", np.int64, UNKNOWN)
        self.uses = self.in_order(answers, 1, "second", np.int64, 0)
        starts = np.cumsum(self.lengths) - self.lengths
        before = np.r_[-1, self.tokens[:-1]]
        before[starts] = -1
        self.before, self.starts = before, starts
        self.train = np.repeat(np.array(row["learns"]), self.lengths)

    def in_order(self, answers, kind, column, dtype, default):
        """The answers to the word requests, by local word number."""
        got = sorted((a for a in answers if a["kind"] == kind), key=lambda a: a["bucket"])
        out = np.full(len(self.hashes), default, dtype)
        if got:
            out[self.order] = np.concatenate([_unzip(a[column], dtype) for a in got])
        return out

    def bigrams(self, buckets: int):
        """Distinct bigrams of known words: left and right ids, training counts, order by bucket, inverse, and uses of the right word."""
        left = np.where(self.before < 0, START, self.gid[self.before])
        known = (left != UNKNOWN) & (self.gid[self.tokens] != UNKNOWN)
        local = (self.before[known] + 1) << 32 | self.tokens[known]
        pairs, inverse = np.unique(local, return_inverse=True)
        counts = np.bincount(inverse[self.train[known]], minlength=len(pairs)).astype(np.int64)
        first = (pairs >> 32) - 1
        left = np.where(first < 0, START, self.gid[first])
        last = pairs & 0xFFFFFFFF
        right = self.gid[last]
        mixed = (left * np.int64(-7046029254386353131) + right) * np.int64(-4417276706812531889)
        bucket = ((mixed.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        return left, right, counts, bucket, np.lexsort((right, left, bucket)), known, inverse, first, self.uses[last]


def _bigram_requests(table: DataFrame, answers: DataFrame, word_buckets: int, buckets: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            chunk = _Chunk(row, right.to_pylist(), word_buckets)
            v, w, n, bucket, order, *_, u = chunk.bigrams(buckets)
            for b, at in _split(bucket, order):
                shift = np.diff(v[at], prepend=0)
                out.append((row["p"], b, _zip(shift), _zip(w[at]), _zip(n[at].astype(np.uint32)), _zip(u[at])))
        names = ["p", "bucket", "v", "w", "n", "u"]
        arrays, names = _rows(out, [pa.int64(), pa.int64()] + [pa.binary()] * 4, names)
        return pa.Table.from_arrays(arrays, names=names)

    asked = answers.where("kind = 1")
    return (
        table.groupBy("p")
        .cogroup(asked.groupBy("p"))
        .applyInArrow(run, "p bigint, bucket bigint, v binary, w binary, n binary, u binary")
    )


def _count_bigrams(requests: DataFrame, min_count: int, k: int) -> DataFrame:
    """Kind 2: kept bigrams of a request by place, and counts. ``p`` NULL: 4 left and right ids,
    5 counts and uses of the right word, 6 counts of counts.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("p").to_pylist()
        v = np.concatenate([np.cumsum(_unzip(r["v"], np.int64)) for r in rows])
        w = [_unzip(r["w"], np.int64) for r in rows]
        sizes = [len(x) for x in w]
        w = np.concatenate(w)
        n = np.concatenate([_unzip(r["n"], np.uint32) for r in rows]).astype(np.int64)
        u = np.concatenate([_unzip(r["u"], np.int64) for r in rows])
        order = np.lexsort((w, v))
        new = np.r_[True, (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        total = np.bincount(place, n).astype(np.int64)
        first = order[new]
        kept = total >= min_count
        low = np.bincount(total[total <= k + 1], minlength=k + 2)
        bucket = rows[0]["bucket"]
        out = [
            (None, 4, bucket, _zip(v[first][kept]), _zip(w[first][kept])),
            (None, 5, bucket, _zip(total[kept]), _zip(u[first][kept])),
            (None, 6, bucket, _zip(low.astype(np.int64)), b""),
        ]
        at = 0
        for r, size in zip(rows, sizes):
            mine = place[at : at + size]
            at += size
            hit = np.flatnonzero(kept[mine])
            if len(hit):
                out.append((r["p"], 2, bucket, _zip(np.diff(hit, prepend=0).astype(np.int64)), _zip(total[mine[hit]])))
        return _answer_table(out)

    return requests.groupBy("bucket").applyInArrow(run, _ANSWER)


def _bigram_table(answers: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        by = {r["kind"]: r for r in table.to_pylist()}
        v, w = _unzip(by[4]["first"], np.int64), _unzip(by[4]["second"], np.int64)
        return pa.table({"left": v, "right": w, "uses": _unzip(by[5]["first"], np.int64)})

    return answers.where("kind in (4, 5)").groupBy("bucket").applyInArrow(run, "left bigint, right bigint, uses bigint")


def discounts(n: dict[int, int], k: int) -> list[float]:
    """Katz's ``d_1 .. d_k`` from counts of counts, smoothed by a line through their logarithms.

    The line is that of simple Good-Turing, fitted to what ``n`` has for ``1 .. k + 1``: a
    count without n-grams is left out, and its neighbours stand for the gap. On a line Katz's
    formula gives ``0 < d_1 < .. < d_k < 1`` whatever its slope. One count of counts
    has no slope and takes ``ZIPF``. All 1 without any, and for ``k`` below 2.
    """
    seen = [r for r in range(1, k + 2) if n.get(r, 0)]
    if not seen or k < 2:
        return [1.0] * k
    slope = ZIPF
    if len(seen) > 1:
        gaps = [t - q for q, t in zip([0, *seen], [*seen[1:], 2 * seen[-1] - seen[-2]])]
        x, y = np.log(seen), np.log([2 * n[r] / gap for r, gap in zip(seen, gaps)])
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    # On the line r* / r is (1 + 1/r) ** (slope + 1), and the tail is (k + 1) ** (slope + 1).
    e = slope + 1
    if abs(e) < 1e-9:
        return [1 - math.log1p(1 / r) / math.log(k + 1) for r in range(1, k + 1)]
    tail = math.expm1(e * math.log(k + 1))
    return [1 - math.expm1(e * math.log1p(1 / r)) / tail for r in range(1, k + 1)]


@dataclass
class Katz:
    """``words (word, uses)``, ``bigrams (left, right, uses)``, ``backoff (left, alpha, den)``; ids are internal."""

    words: DataFrame
    bigrams: DataFrame
    backoff: DataFrame
    tokens: int
    vocabulary: int
    word_discounts: list[float]
    bigram_discounts: list[float]
    seen_mass: float  # of all training words
    scale: float

    @property
    def unknown(self) -> float:
        return 1 - self.seen_mass * self.scale


def _discounted(uses: np.ndarray, d: list[float]) -> np.ndarray:
    out = uses.astype(float)
    for r, x in enumerate(d, 1):
        out[uses == r] *= x
    return out


def _weights(model: Katz, counted: DataFrame, texts: int) -> DataFrame:
    """``(left, alpha, den)`` of every context with a kept bigram.

    A bucket adds up its bigrams by context before anything moves.
    """
    d, d2, share = model.word_discounts, model.bigram_discounts, model.scale / max(model.tokens, 1)

    def run(table: pa.Table) -> pa.Table:
        by = {r["kind"]: r for r in table.to_pylist()}
        v, place = np.unique(_unzip(by[4]["first"], np.int64), return_inverse=True)
        low = _discounted(_unzip(by[5]["second"], np.int64), d) * share
        mass = _discounted(_unzip(by[5]["first"], np.int64), d2)
        sums = [np.bincount(place, x, len(v)) for x in (low, mass)]
        return pa.table({"left": v, "low": sums[0], "mass": sums[1]})

    parts = counted.where("kind in (4, 5)").groupBy("bucket").applyInArrow(run, "left bigint, low double, mass double")
    sums = parts.groupBy("left").agg(F.sum("low").alias("low"), F.sum("mass").alias("mass"))
    start = model.words.sparkSession.range(1).select(F.lit(START).cast("bigint").alias("left"), F.lit(texts).cast("bigint").alias("n"))
    contexts = model.words.select(F.col("word").alias("left"), F.col("uses").alias("n")).unionByName(start)
    den = F.when(F.col("n") - F.col("mass") > 1e-9 * F.col("n"), F.col("n")).otherwise(F.col("n") + 1).cast("double")
    return (
        sums.join(contexts, "left")
        .withColumn("den", den)
        .select("left", ((1 - F.col("mass") / F.col("den")) / (1 - F.col("low"))).alias("alpha"), "den")
    )


def _weight_answers(backoff: DataFrame, answers: DataFrame) -> DataFrame:
    """Kind 3: ``alpha`` and ``den`` in the order of a word request."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("left").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        alpha, den = (left.column(c).to_numpy()[order] for c in ("alpha", "den"))
        out = []
        for r in right.to_pylist():
            gid = _unzip(r["first"], np.int64)
            a, d = np.ones(len(gid)), np.zeros(len(gid))
            if len(ids):
                at = np.minimum(np.searchsorted(ids, gid), len(ids) - 1)
                hit = ids[at] == gid
                a[hit], d[hit] = alpha[at[hit]], den[at[hit]]
            out.append((r["p"], 3, r["bucket"], _zip(a), _zip(d)))
        return _answer_table(out)

    by_bucket = backoff.where(F.col("left") >= 0).withColumn("bucket", F.shiftright("left", 32))
    asked = answers.where("kind = 1").select("p", "bucket", "first")
    return by_bucket.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, _ANSWER)


def katz_scores(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT,
    k: int = DISCOUNTED, chunk_tokens: int = CHUNK_TOKENS, bucket_words: int = BUCKET_WORDS,
) -> tuple[DataFrame, Katz]:
    """Scores of all ``docs`` by a model of those for which ``learn`` holds, and the model.

    Scores: ``key, learned, n_tokens, n_known, train_tokens, base_score, score``;
    ``base_score`` is the add-half unigram score, ``score`` the model's log10 probability.
    """
    kind = docs.schema[key].dataType.simpleString()
    table = stored(chunks(docs, learn, key, text, chunk_tokens), "katz-chunks")
    sizes = table.select(
        F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"),
        F.size(F.filter("learns", lambda x: x)).alias("texts"),
    ).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0)))
    tokens, texts = sizes.first()
    # A chunk names a word once, so words are far fewer than tokens; bigrams nearly as many.
    word_buckets = max(1, -(-tokens // (8 * bucket_words)))
    buckets = max(1, -(-tokens // bucket_words))

    answers = stored(_count_words(_word_requests(table, word_buckets)), "katz-words")
    words = stored(_word_table(answers), "katz-word-table")
    total, vocabulary = words.agg(F.coalesce(F.sum("uses"), F.lit(0)), F.count(F.lit(1))).first()
    low = {r["uses"]: r["n"] for r in words.where(F.col("uses") <= k + 1).groupBy("uses").agg(F.count(F.lit(1)).alias("n")).collect()}
    d = discounts(low, k)
    mass = 1 - sum(n * r * (1 - d[r - 1]) for r, n in low.items() if r <= k) / max(total, 1) if total else 0.0
    # An unknown word always has some probability, also where nothing was discounted.
    scale = 1.0 if mass < 1 - 1e-12 else total / (total + 1)

    counted = stored(_count_bigrams(_bigram_requests(table, answers, word_buckets, buckets), min_count, k), "katz-bigrams")
    bigrams = _bigram_table(counted)
    low2 = np.zeros(k + 2, np.int64)
    for (blob,) in counted.where("kind = 6").select("first").toLocalIterator():
        low2 += _unzip(bytes(blob), np.int64)
    model = Katz(
        words, bigrams, words, total, vocabulary, d, discounts(dict(enumerate(low2.tolist())), k), mass, scale
    )
    model.backoff = stored(_weights(model, counted, texts), "katz-backoff")
    start = model.backoff.where(F.col("left") == START).first()
    alpha_start, den_start = (start["alpha"], start["den"]) if start else (1.0, 0.0)
    weights = _weight_answers(model.backoff, answers)
    unknown, d2 = model.unknown, model.bigram_discounts

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = right.to_pylist()
        for row in left.to_pylist():
            chunk = _Chunk(row, replies, word_buckets)
            alpha = chunk.in_order(replies, 3, "first", float, 1.0)
            den = chunk.in_order(replies, 3, "second", float, 0.0)
            p = _discounted(chunk.uses, d) / max(total, 1) * scale
            p[chunk.uses == 0] = unknown
            log_p, log_alpha = np.log10(p), np.log10(alpha)
            scores = log_p[chunk.tokens] + np.where(chunk.before < 0, np.log10(alpha_start), log_alpha[chunk.before])
            _, _, counts, bucket, order, known, inverse, first, _ = chunk.bigrams(buckets)
            kept = np.zeros(len(counts), np.int64)
            found = [a for a in replies if a["kind"] == 2]
            starts = np.searchsorted(bucket[order], [a["bucket"] for a in found])
            for a, start in zip(found, starts):
                kept[order[start + np.cumsum(_unzip(a["first"], np.int64))]] = _unzip(a["second"], np.int64)
            hit = kept > 0
            gain = np.zeros(len(kept))
            below = np.where(first < 0, den_start, den[first])
            gain[hit] = np.log10(_discounted(kept[hit], d2) / below[hit])
            at = np.flatnonzero(known)[hit[inverse]]
            scores[at] = gain[inverse[hit[inverse]]]
            base = np.log10((chunk.uses + 0.5) / (total + 0.5 * (vocabulary + 1)))[chunk.tokens]
            sums = [np.add.reduceat(x, chunk.starts) for x in ((chunk.uses > 0).astype(np.int64)[chunk.tokens], base, scores)]
            out += zip(row["keys"], row["learns"], row["lengths"], *sums)
        types = [left.schema.field("keys").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [key, "learned", "n_tokens", "n_known", "base_score", "score"]
        arrays, names = _rows(out, types, names)
        return pa.Table.from_arrays(arrays, names=names)

    replies = answers.where("kind = 1").unionByName(counted.where("kind = 2")).unionByName(weights)
    scored = table.groupBy("p").cogroup(replies.groupBy("p")).applyInArrow(
        run, f"`{key}` {kind}, learned boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(
        key, "learned", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score"
    ), model
