"""Secret scan, quality rules, decontamination and language identification against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import langid, qgram_filter, quality_rules, secret_scan
from colloquy.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
PATTERNS = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
]
EXTRA = "doc_id bigint, text string, spans string, rules int, n int"


def rules(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            if k == 0 and len(m[2]) >= 6 or k == 1 and len(m[0]) >= 20 or k == 2 and len(m[0]) >= 24:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def names(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


RANDOM = "hJ8sK2pQ9vX4mZ7cR1tB6nD3"
SECRETS = [
    None, "", "no secret", "token=abc", "Token : 'abcdef'", "secret=token: abcdefgh", "api_key=\"x.y_z-1\" password=12345",
    "API_KEY==abcdef PASSWD:===", "AKIA123", "xAKIA" + "B" * 16, "AKIAAKIA" + "9" * 12, "f" * 23 + "g" + "a1" * 12,
    "token=" + "0123456789abcdef" * 2, "𝒳é token=abcdef 𝒳 " + "0a" * 13, "Key toKen=abcdef ſecret=abcdef",
    f"the key {RANDOM} is here", "internationalization_of_the_documents", "a" * 100_000 + " password = " + "x" * 50_000,
    "token=abcdef,token=abcdef\ntoken=abcdefg", "1234567890123456789012345678",
]


def test_secret_rules_and_models(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(SECRETS)] + [(None, "token=abcdef", "y", 1, 1)], EXTRA)
    words = ["international", "documents", "the_documents_of", "internationalization", "extraction", "20240101", "1234567890"]
    words += ["quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "vexing", "zebra", "why", "pack", "my", "box", "jug", "2019-07-04"]
    words = (words + [w.upper() for w in words] + [w.title() for w in words] + [f"{w}_{v}" for w in words for v in words[:4]]) * 40
    made = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(40)]
    r = random.Random(1)
    made += ["".join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(30)) for _ in range(200)]
    samples = spark.createDataFrame([(w, False) for w in words] + [(m, True) for m in made] + [(None, True), ("é", None)], "value string, random boolean")
    model = secret_scan.train(samples)
    got = {(r.doc_id, r.text): (r["r"], r["s"]) for r in secret_scan.scan(docs, model).select(
        "doc_id", "text", secret_scan.span_text("rules").alias("r"), secret_scan.span_text("spans").alias("s")).collect()}
    for i, t in enumerate(SECRETS):
        ruled, every = got[i, t or ""]
        assert ruled == names(rules(t)), t
        assert [x for x in every.split(",") if not x.startswith("markov")] == ruled.split(",") or every.startswith("markov")
    at = SECRETS.index(f"the key {RANDOM} is here")
    assert got[at, SECRETS[at]][1] == f"markov:8:{8 + len(RANDOM)}"
    assert got[SECRETS.index("internationalization_of_the_documents"), "internationalization_of_the_documents"][1] == ""
    score = spark.createDataFrame([(RANDOM,)], "v string").select(secret_scan.ratio(F.col("v"), model)).first()[0]
    k, a = len(secret_scan.ALPHABET), secret_scan.ALPHABET
    assert score == pytest.approx(sum(model[a.index(x) * k + a.index(y)] for x, y in zip(RANDOM, RANDOM[1:])))


def test_secret_scan_without_samples(spark):
    empty = spark.createDataFrame([], "value string, random boolean")
    model = secret_scan.train(empty)
    docs = spark.createDataFrame([(1, RANDOM, "", 1, 1)], EXTRA)
    assert secret_scan.scan(docs, model).select(F.size("spans")).first()[0] == 0
    assert secret_scan.train(secret_scan.labelled_samples(docs.limit(0))) == model
    assert secret_scan.scan(docs.limit(0), model).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token=abcdef b password=" + "0a" * 12, "", 1, 1), (2, "plain", "", 1, 1)], EXTRA)
    model = [0.0] * len(secret_scan.ALPHABET) ** 2
    got = secret_scan.scan(docs, model).select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == {1: "a <secret> b <secret>", 2: "plain"}


@tables
def test_registered_secret_scan(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_secret_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = rules(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert r.base_sha256 == hashlib.sha256(names(base).encode()).hexdigest()


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def prose(r, words=200, junk=False):
    pool = ["the", "of", "and", "water", "stone", "garden", "Morning", "light", "running", "house", "river", "small"]
    return " ".join(r.choice(pool) + r.choice(["", str(r.randrange(50))]) + ("###" if junk else "") for _ in range(words))


def test_quality_statistics_and_outliers(spark):
    r = random.Random(2)
    rows = [(i, prose(r), "en", f"s{i % 2}") for i in range(150)]
    rows += [(1000 + i, prose(r, junk=True), "en", "s0") for i in range(6)]
    edge = [None, "", " \n\t\v", "a", "a a a a", "a b c a b c\n\na b c\na b c", "É x | <b>\r\nx", "x y " * 30_000, "l\nl\n \nl\nm"]
    edge += [" ".join(f"w{r.randrange(9)}" for _ in range(n)) for n in (2, 3, 60, 700)]
    rows += [(2000 + i, t, None, None) for i, t in enumerate(edge)] + [(None, prose(r), "xx", "rare"), rows[0]]
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id bigint, text string, lang string, source string, kept int, `group` string")
    got = collections.defaultdict(list)
    for x in quality_rules.verdicts(docs).collect():
        got[x.doc_id].append(x)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, *_ in rows:
        x, want = got[i][0], statistics(t)
        assert tuple(x[n] for n in NAMES) == want, (i, t)
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert x.base_failed == failed
        assert x.kept == (not failed and not 1000 <= (i or 0) < 2000), i
    assert quality_rules.verdicts(docs.limit(0)).collect() == []


def test_repeats_alone_reject(spark):
    r = random.Random(5)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(40)]
    some = lambda n: [r.choice(pool) for _ in range(n)]
    lined = lambda w: "\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10))
    rows = [(i, lined(some(400))) for i in range(150)]
    again = some(90)
    rows += [(1000, "\n".join(some(400))), (1001, lined([*again, *some(111), *again, *some(109)]))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    got = {x.doc_id: x for x in quality_rules.verdicts(docs).collect()}
    lines, words = got[1000], got[1001]
    assert lines.n_dup_lines == 360 and lines.n_repeat_words < 40 and words.n_dup_lines == 0 and 180 <= words.n_repeat_words < 200
    assert not lines.base_failed and not words.base_failed
    assert [i for i in sorted(got) if not got[i].kept] == [1000, 1001]


def test_mcd_against_exact_concentration(spark):
    r = np.random.default_rng(0)
    clean = r.normal(size=(400, quality_rules.P)) @ np.diag([0.5, 1, 2, 1, 0.7])
    x = np.vstack([clean, r.normal(8, 0.5, (60, quality_rules.P))])
    rows = [("g", *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "group string, " + ", ".join(f"{n} double" for n in quality_rules.X))
    got = quality_rules.mcd(df).first()
    low = np.zeros((quality_rules.P, quality_rules.P))
    for i, j in quality_rules.PAIRS:
        low[i, j] = got[f"l{i}{j}"]
    mean = np.array([got[f"m{i}"] for i in range(quality_rules.P)])
    assert np.abs(mean - clean.mean(0)).max() < 0.25
    assert np.abs(np.sqrt(np.diag(low @ low.T)) / clean.std(0) - 1).max() < 0.25
    assert quality_rules.chi2_quantile(0.75, 5) == pytest.approx(6.6257, abs=1e-3)
    assert math.isclose(quality_rules.chi2_cdf(11.0705, 5), 0.95, abs_tol=1e-4)


def brute_distance(item, text):
    """Least edits of ``item`` against any run of ``text``."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark, monkeypatch):
    r = random.Random(4)
    item = lambda n: "".join(r.choice("abcdefgh  ") for _ in range(n)).strip() or "x"
    items = [(i, "q" + item(r.randint(60, 200))) for i in range(12)] + [(50, None), (51, ""), (52, "tiny"), (53, "q" + item(1500)), (54, item(70).upper())]
    docs, planted = [], {}
    for d in range(60):
        i, t = items[r.randrange(12)]
        clean, _ = qgram_filter.normalized(t)
        m, c = len(clean), list("".join(map(chr, clean)))
        edits = r.choice([0, 1, qgram_filter.budget(m), m // 3])
        for k in r.sample(range(5, m - 5), edits):
            c[k] = r.choice("xyz")
        docs.append((d, item(r.randint(0, 300)) + " " + "".join(c).upper().replace(" ", r.choice([" ", "\n\t"])) + " " + item(r.randint(0, 300))))
        planted[d] = i, edits, m
    docs += [(100, None), (101, ""), (102, items[13 + 2][1]), (103, items[16][1]), (104, "abc " * 300_000 + items[0][1]), (None, items[1][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, start int")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int")
    got = qgram_filter.contaminated(df, bench, block_chars=900).collect()
    found = collections.defaultdict(set)
    for x in got:
        found[x.doc_id].add(x.item_id)
        text = dict(docs)[x.doc_id]
        part = "".join(map(chr, qgram_filter.normalized(text[x.start : x.end])[0]))
        whole = "".join(map(chr, qgram_filter.normalized(dict(items)[x.item_id])[0]))
        if x.item_id != 53:
            assert brute_distance(whole, part) <= x.edits <= qgram_filter.budget(len(whole))
    for d, (i, edits, m) in planted.items():
        assert (i in found[d]) == (edits <= qgram_filter.budget(m)), (d, i, edits, m)
    assert found[102] == {53} or 53 in found[102]
    assert 54 in found[103] and 0 in found[104] and 1 in found[None]
    assert not found[100] and not found[101]
    assert qgram_filter.contaminated(df.limit(0), bench).count() == 0
    assert qgram_filter.contaminated(df, bench.limit(0)).count() == 0
    monkeypatch.setattr(qgram_filter, "SLICE", 1000)
    index = qgram_filter.Index(items)
    long = item(4990) + items[3][1] + item(3000)
    assert {index.ids[h[1]] for h in qgram_filter.search(index, [long])} == {3}


@tables
def test_language_identification(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = QUERIES["op8_language"](spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_rows(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([("the and of water", "en"), ("der und die das", "de")] * 30)]
    rows += [(100, None, "en", "x"), (101, "12 !?", "de", "x"), (102, "the of", None, "x"), (None, "und der", "de", "x"), (103, "the " * 800_000, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    model = langid.train(docs, F.lit(True), per_language=20)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[100] == got[101] == ("und", 0.0)
    assert got[102][0] == got[103][0] == "en" and got[None][0] == "de"
    none = langid.train(docs, F.lit(False))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
    assert (model.weights == 0).mean() > 0.5  # the elastic net leaves most weights at zero


def test_slices_of_long_texts_count_alike(monkeypatch):
    text = "Größe naïve water 12 stone " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "SLICE", 100)
    assert (langid.features(text) == whole).all()
