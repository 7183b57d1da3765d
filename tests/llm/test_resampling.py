"""Resampling against a loop over the texts, and the selection on its own."""

import hashlib
import math
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from colloquy.llm import queries, resampling

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
ROWS = "doc_id bigint, text string, score string, _row string, n int"


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def brute(docs, target, percent=25, least=20):
    """Of ``(id, text)`` rows: ``(id, n_features, weight, score, rank)``, equal ids in no fixed order."""
    at = lambda f: zlib.crc32(f.encode()) % 10000
    source, aim = [0] * 10000, [0] * 10000
    for counts, texts in ((source, [t for _, t in docs]), (aim, target)):
        for t in texts:
            for f in features(t)[1]:
                counts[at(f)] += 1
    s_all, t_all = sum(source), sum(aim)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) for s, t in zip(source, aim)]
    out = []
    for d, text in docs:
        w, f = features(text)
        weight = sum(gain[at(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def plain(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


@tables
def test_query_against_a_loop(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = plain(queries.QUERIES["op12_resample"](spark, SF))
    assert got == sorted(brute(docs, target), key=repr)
    assert sum(r[4] is not None for r in got) > 10


def test_odd_rows(spark):
    long = " ".join(f"Wort{i % 997} ünd" for i in range(60_000))
    many = [(7, "x" * 3 + " same words again " * 10)] * 9  # one id and one text, nine times
    docs = [(1, None), (2, ""), (3, "  ...!  "), (4, "one"), (None, "a b " * 15), (None, "c d " * 15), (5, long), *many]
    docs += [(i, f"Dies ist Text {i} " + "été 12x " * i) for i in range(10, 40)]
    rows = [(d, t, "s", "r", 1) for d, t in docs]
    target = ["This Text is été", None, ""]
    got = resampling.resample(
        spark.createDataFrame(rows, ROWS).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent=60
    )
    want = brute(docs, target, percent=60)
    assert [r[:4] for r in plain(got)] == sorted((r[:4] for r in want), key=lambda r: repr((*r, None)))
    ranks = lambda rows: sorted((r[4], r[3]) for r in rows if r[4] is not None)
    assert ranks(plain(got)) == ranks(want)  # equal rows may swap their ranks
    assert len(ranks(want)) == 60 * sum(len(features(t)[0]) >= 20 for _, t in docs) // 100


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], ROWS), spark.createDataFrame([(1, "a b " * 20, "", "", 0)], ROWS)
    assert resampling.resample(none, one).collect() == []
    assert [(r.doc_id, r["rank"]) for r in resampling.resample(one, none, percent=100).collect()] == [(1, 1)]
    assert [r["rank"] for r in resampling.resample(one, none).collect()] == [None]  # floor(25 * 1 / 100) rows


@pytest.mark.parametrize("k", [1, 2, 499, 500, 501, 998, 1999, 2000])
def test_selection_finds_the_kth_key(spark, k):
    """Few different scores and ids, so that most keys differ in the row alone."""
    rows = spark.range(2000).select(
        (F.col("id") % 4).alias("score"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("doc_id"), F.col("id").alias("_row")
    )
    order = sorted(rows.collect(), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0, r._row))
    found = resampling.quickselect(rows, k, "doc_id", pivots=3)
    assert (found["score"], found["key"], found["row"]) == tuple(order[k - 1])
