"""Katz scores against a brute-force model, and exact normalisation."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import katz as K
from colloquy.llm import queries

SF = "/root/testdata/sf0.001"


def words(text):
    return [*(text or "").encode().lower().split(), K.END]


def brute(rows, learn, min_count=2, k=5):
    train = [words(t) for d, t in rows if learn(d)]
    uses = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([None, *t], t))
    contexts = Counter(v for t in train for v in [None, *t[:-1]])
    n = sum(uses.values())

    def table(counts):
        return K.discounts({r: c for r, c in Counter(counts.values()).items() if r <= k + 1}, k)

    d1, d2 = table(uses), table(pairs)
    disc = lambda c, d: c * d[c - 1] if c <= k else c
    p1 = {w: disc(c, d1) / n for w, c in uses.items()}
    scale = 1.0 if sum(p1.values()) < 1 - 1e-12 else n / (n + 1)
    p1 = {w: p * scale for w, p in p1.items()}
    unknown = 1 - sum(p1.values())
    kept = {}
    for (v, w), c in pairs.items():
        if c >= min_count:
            kept.setdefault(v, {})[w] = c

    def p(w, v):
        low = p1.get(w, unknown)
        if v not in kept:
            return low
        mass = sum(disc(c, d2) for c in kept[v].values())
        den = contexts[v] if contexts[v] - mass > 1e-9 * contexts[v] else contexts[v] + 1
        if w in kept[v]:
            return disc(kept[v][w], d2) / den
        return low * (1 - mass / den) / (1 - sum(p1[x] for x in kept[v]))

    for v in [*list(kept)[:50], b"never seen"]:
        assert math.isclose(sum(p(w, v) for w in p1) + p(None, v), 1, rel_tol=1e-9)
    out = []
    for d, t in rows:
        toks = words(t)
        base = sum(math.log10((uses[w] + 0.5) / (n + 0.5 * (len(uses) + 1))) for w in toks)
        score = sum(math.log10(p(w, v)) for v, w in zip([None, *toks], toks))
        out.append((d, bool(learn(d)), len(toks), sum(w in uses for w in toks), n, base, score))
    return out


def check(spark, rows, learn, column, **options):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, p int, key string")
    got, _ = K.katz_scores(df.repartition(3), column, **options)
    order = lambda r: (r[0] is None, r[0], r[2], r[6])
    want = sorted(brute(rows, learn), key=order)
    got = sorted((tuple(r) for r in got.collect()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def fold(d):
    return d is None or zlib.crc32(str(d).encode()) % 5 != 1


def fold_column():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_given_documents_in_small_chunks(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900_001, None), (900_002, ""), (None, "The of AND"), (None, None), rows[0], (900_003, "zzz yyy \x85 zzz yyy " * 4000)]
    check(spark, rows, fold, fold_column(), chunk_tokens=3000, bucket_words=2000)


def test_query_scores_bigrams_seen_once(spark, tmp_path):
    seen = [(i, f"a{i} b{i} a{i} c a{i} b{i + 1}") for i in range(40)]
    rows = [*seen, *((100 + i, f"a{i} b{i + 1} c") for i in range(40)), (900, "a1 c a1"), (901, "b1 b2 new")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.score) for r in queries.op7_katz(spark, str(tmp_path)).collect())
    want = sorted((r[0], r[6]) for r in brute(rows, fold, min_count=1))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)
    assert want != sorted((r[0], r[6]) for r in brute(rows, fold))  # the cut would show


def test_few_rows(spark):
    check(spark, [(1, "a b a b c"), (2, "a b a b a b d"), (3, "e")], lambda d: d < 3, F.col("doc_id") < 3)
    check(spark, [(1, "a a a a"), (2, None)], lambda d: True, F.lit(True))


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got, _ = K.katz_scores(df, F.lit(False))
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.score) for r in got.collect()) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
    got, _ = K.katz_scores(df.limit(0), F.lit(True))
    assert got.collect() == []


def good_turing(n, k):
    """Katz's formula on counts of counts that a fitted power law gives; no gaps in ``n``."""
    slope, level = np.polyfit(np.log(range(1, k + 2)), np.log([n[r] for r in range(1, k + 2)]), 1)
    s = {r: math.exp(level) * r**slope for r in n}
    tail = (k + 1) * s[k + 1] / s[1]
    return [((r + 1) * s[r + 1] / s[r] / r - tail) / (1 - tail) for r in range(1, k + 1)]


@pytest.mark.parametrize(
    "n",
    [
        [15748, 3158, 906, 461, 318, 181],  # plain
        [200420, 57120, 23804, 13644, 12859, 6775],  # more words used five times than four times would give
        [1000, 400, 200, 80, 150, 60],  # n_4 < n_5
        [10, 20, 40, 80, 160, 320],  # rising
    ],
)
def test_discounts_hold_at_any_counts_of_counts(n):
    n = dict(enumerate(n, 1))
    d = K.discounts(n, 5)
    assert d == pytest.approx(good_turing(n, 5), rel=1e-9)
    assert all(0 < x < 1 for x in d) and d == sorted(d)


def test_discounts_with_gaps_and_little_to_go_by():
    full, doubled = K.discounts({1: 900, 2: 300, 3: 100}, 5), K.discounts({2: 900, 4: 300, 6: 100}, 5)
    for d in (full, doubled, K.discounts({3: 7}, 5), K.discounts({1: 6, 2: 3, 3: 2}, 2), K.discounts({1: 60, 2: 30, 3: 20}, 2)):
        assert all(0 < x < 1 for x in d) and d == sorted(d)
    assert K.discounts({1: 60, 2: 30, 3: 20}, 2) == pytest.approx([1 - math.log(2) / math.log(3), 1 - math.log(1.5) / math.log(3)])
    assert K.discounts({}, 5) == K.discounts({9: 4}, 5) == [1.0] * 5
