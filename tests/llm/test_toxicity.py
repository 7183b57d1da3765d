"""Class-conditional Kneser-Ney against sums by definition, held-out accuracy, and the bounds of the sample."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import queries, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
DOCS = "doc_id bigint, text string, toxic string, score string, _hash string, _class int"
LABELS = "doc_id bigint, quality int, toxic int"


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(classes, d1, d2):
    """P_c(w | v) by the formulas of the docstring, from sets of texts."""
    pairs = [Counter(p for t in of for p in {*zip([None, *tokens(t)], tokens(t))}) for of in classes]
    held = [Counter(w for t in of for w in {*tokens(t)}) for of in classes]
    k = held[0] + held[1]
    d, total = toxicity.SHARED_DISCOUNT, sum(k.values())

    def shared(w):
        return max(k[w] - d, 0) / total + d * len(k) / total / (len(k) + 1)

    def single(c, w):
        n = sum(held[c].values())
        return max(held[c][w] - d1, 0) / n + sum(min(x, d1) for x in held[c].values()) / n * shared(w)

    def joint(c, v, w):
        after = {b: n for (a, b), n in pairs[c].items() if a == v}
        n = sum(after.values())
        if not n:
            return single(c, w)
        return max(after.get(w, 0) - d2, 0) / n + sum(min(x, d2) for x in after.values()) / n * single(c, w)

    return joint, list(k)


def counted(classes, d1, d2):
    words = {}
    ids = [toxicity.encode(of, words) for of in classes]
    return toxicity.Counts(ids, len(words) + 1).model(words, 0.5, d1, d2)


def test_features_of_a_fold_are_those_of_its_model():
    classes = [t for _, t, c in made(120) if not c], [t for _, t, c in made(120, 5) if c]
    words = {}
    ids = [toxicity.encode(of, words) for of in classes]
    toxicity.encode(["unseen words here"], words)  # known ids that nothing counted holds
    counts, texts = toxicity.Counts(ids, len(words) + 1), ["unseen w1 vile", "w2 w3 foul nasty w1 never"]
    own = toxicity.encode(texts[:1], words)
    for (d, e), rows in counts.features(own).items():
        np.testing.assert_allclose(rows[0], counts.model(words, 0.5, d, e).features(texts[0]), rtol=1e-9)


def test_models_against_definition():
    rng = random.Random(1)
    make = lambda extra: " ".join(rng.choice("the a cat dog sat ran on mat".split() + extra) for _ in range(rng.randint(1, 30)))
    classes = [make(["mild"]) for _ in range(40)], [make(["rude", "Rude"]) for _ in range(25)] + ["", "..."]
    for d1, d2 in ((0.75, 2.0), (4.0, 16.0), (100.0, 256.0)):
        model = counted(classes, d1, d2)
        joint, known = brute(classes, d1, d2)
        for v in (None, "the", "rude", "never"):
            for c in (0, 1):
                assert math.isclose(sum(joint(c, v, w) for w in [*known, None]), 1, rel_tol=1e-9)
        text = "The rude cat never sat on mat, the mild dog ran: RUDE"
        w = tokens(text)
        want = [math.log(joint(1, a, b) / joint(0, a, b)) for a, b in zip([None, *w], w)]
        got = model.features(text)
        np.testing.assert_allclose(got, [np.mean(want), sum(max(x - 1, 0) for x in want) / math.sqrt(len(w)), max(want)], rtol=1e-9)


def test_rare_expressions_say_nothing():
    common = ["so it goes on and on"] * 30
    model = counted(([*common, "odd"], [*common, "strange"]), 4.0, 16.0)
    for word in ("odd", "strange"):
        assert abs(model.features(word)[0]) < 0.2


def test_long_texts_in_slices(monkeypatch):
    text = "Some WORDS, here and ther2e; " * 400 + "x" * 5000 + " end"
    for size in (1, 7, 64, 1 << 20):
        assert [w for part in toxicity.slices(text, size) for w in part] == tokens(text)
    classes = ["some words here"] * 20, ["end words and"] * 20
    model = counted(classes, 0.75, 16.0)
    whole = model.features(text)
    monkeypatch.setattr(toxicity.slices, "__defaults__", (50,))
    np.testing.assert_allclose(model.features(text), whole, rtol=1e-9)


@tables
def test_held_out_documents(spark):
    rows = queries.QUERIES["op11_toxicity"](spark, SF).collect()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    insults = re.compile(r"\b(idiot|moron|scum|loser|stupid|pathetic|worthless|trash|clown|disgusting)\b", re.I)
    held = [r for r in rows if r.held_out]
    rude = [r for r in held if insults.search(texts[r.doc_id])]
    calm = [r for r in held if marks.get(r.doc_id) == 0]
    assert sum(r.predicted for r in rude) >= 0.9 * len(rude) > 0
    assert sum(r.predicted for r in calm) <= 0.05 * len(calm)


def made(n, seed=0):
    """Ordinary texts and toxic ones, the latter with a few of some words among the same others."""
    rng = random.Random(seed)
    calm = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            words += rng.choices(["vile", "foul", "nasty"], k=3)
            rng.shuffle(words)
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, "t", "s", "h", 1) for d, t, *_ in rows], DOCS)
    return docs, spark.createDataFrame([(d, 1, c) for d, c in labels], LABELS)


def test_odd_rows(spark):
    rows = made(300)
    odd = [(None, "vile foul nasty vile"), (1000, None), (1001, ""), (1002, "!!! ..."), (1003, "w1 w2 " * 200_000), (1004, "vile")]
    labels = [(d, c) for d, _, c in rows] + [(None, 1), (0, 1), (1, None), (5000, 1)]
    docs, marks = frames(spark, rows + odd, labels)
    model = toxicity.train(docs, marks, F.lit(True))
    got = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    share = model.share
    assert share == 75 / 300
    assert {(1000, share), (1001, share), (1002, share)} <= got
    by = {d: s for d, s in got}
    assert by[None] > 0.9 and by[1003] < 0.1 and by[1004] > 0.5
    again = {(r.doc_id, r.score) for r in toxicity.score(docs.repartition(3), toxicity.train(docs.repartition(5), marks, F.lit(True))).collect()}
    assert again == got


def test_one_class_no_label_no_rows(spark):
    rows = made(40)
    docs, none = frames(spark, rows, [])
    scores = lambda d, m: {r.score for r in toxicity.score(d, toxicity.train(d, m, F.lit(True))).collect()}
    assert scores(docs, none) == {0.0}
    assert scores(docs, frames(spark, [(0, "")], [(d, 1) for d, _, _ in rows])[1]) == {1.0}
    assert scores(docs, frames(spark, [(0, "")], [(d, 0) for d, _, _ in rows])[1]) == {0.0}
    assert scores(docs.limit(0), none) == set()


def test_sample_is_bounded_and_takes_copies_once(spark, monkeypatch):
    rows = made(400)
    rows += [(10_000 + i, "vile copy of one text", 1) for i in range(3000)]
    docs, marks = frames(spark, rows, [(d, c) for d, _, c in rows])
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda sample, sizes: seen.update(sample=sample, sizes=sizes) or toxicity.Model())
    toxicity.train(docs, marks, F.lit(True), sample_chars=4000, sample_texts=25)
    assert seen["sizes"] == (300, 101)
    for c in (0, 1):
        own = [t for _, k, t in seen["sample"] if k == c]
        assert 5 < len(own) <= 25 and sum(map(len, own)) <= 4000 and len(own) == len({*own})
    toxicity.train(docs, marks, F.lit(True))
    assert len(seen["sample"]) == 401
