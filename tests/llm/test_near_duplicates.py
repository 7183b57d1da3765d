"""Near-duplicate classes against all pairs on full sets."""

import os
import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm import hyperminhash as H

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, key string, n int, root string"


def shingles(text, words):
    w = (text or "").encode().lower().split()
    n = min(words, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows, words, percent=80):
    """``{(doc_id, text): (n, component)}`` by union-find over every pair."""
    items = sorted(set(rows), key=repr)
    sets = [shingles(t, words) for _, t in items]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {x: (len(s), least.get(find(i)) if s else x[0]) for i, (x, s) in enumerate(zip(items, sets))}


def compare(spark, rows, words):
    df = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA)
    got = H.near_duplicates(df, words).collect()
    want = brute(rows, words)
    key = lambda x: tuple((v is not None, v) for v in x)
    expected = sorted(((d, *want[d, t], d == want[d, t][1]) for d, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == expected


def edited(r, words, share):
    return " ".join(w if r.random() > share else r.choice(words) for w in words)


@pytest.mark.parametrize("words", [2, 5])
def test_edge_rows_and_copies(spark, words, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_MEMBERS", 4)  # so that keys are split into blocks
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  TWO"), (8, "É é"), (9, "é é")]
    rows += [(None, "null id text here"), (None, "null id text here"), (None, "another null id"), (10, "null id text here")]
    rows += [(11, "same id"), (11, "same id"), (11, "same id but other text")]
    for k in range(12):  # groups of edited copies around the threshold, long and short
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 5, 6, 20, 90, 250, 330, 700]))]
        for _ in range(r.randint(2, 14)):
            rows.append((r.randrange(10**6), edited(r, base, r.choice([0, 0.01, 0.03, 0.05, 0.08]))))
    chain = [r.choice(vocabulary) for _ in range(60)]
    for k in range(20):  # every copy is near the next only
        chain[3 * k] = f"new{k}"
        rows.append((2_000_000 - k, " ".join(chain)))
    rows.append((3_000_000, " ".join(r.choice(vocabulary) for _ in range(60_000))))
    compare(spark, rows, words)


def test_empty_table(spark):
    assert H.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, rows, 2)


def test_estimate_is_corrected(spark):
    r = random.Random(5)
    a = [r.getrandbits(40) for _ in range(3000)]
    import numpy as np

    sets = [H._mix(np.array(x, np.uint64)) for x in (a, a[:2600] + [r.getrandbits(40) for _ in range(400)], [r.getrandbits(40) for _ in range(3000)])]
    regs = [H.registers(np.unique(s)) for s in sets]
    per = np.array([3000 / H.BUCKETS])
    assert abs(H.estimate(regs[0][None], regs[1][None], per, per)[0] - 2600 / 3400) < 0.15
    assert H.estimate(regs[0][None], regs[2][None], per, per)[0] < 0.05


def test_links_of_a_large_star_and_a_path(spark):
    star = spark.range(1, 3000).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    path = spark.range(5000, 5200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = H.components(star.union(path)).groupBy("root").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 2999), (5000, 200)]
