"""Secret scans by rules and by two character Markov models. Built-in expressions only.

Rules find assignments, access keys and hex runs. Beyond them, every run of
``MIN_CHARS`` or more token characters is scored by the log-likelihood ratio of two
first-order character models, one of random strings and one of ordinary
identifiers, and reported where the ratio speaks for random. Both models are
smoothed transition counts over labelled samples. A transition that a run repeats
speaks once, so lines of dashes or zeros have nothing to say however long they are.
``labelled_samples`` makes such a table from a corpus: random are values that the rules
found and digests of document ids in several alphabets; identifiers are words and numbers
of the texts, paths, slugs and camel case made of them and of ``ORDINARY``, and alphabets
in order. It uses a bounded sample of documents; the scan covers whole texts of all rows.

Rows: a NULL text is empty and has no spans. Repeated rows are scanned alike and are one
row of the sample. With an empty sample all ratios are zero and only the rules report.
Very long runs of token characters are one run. Columns beyond key and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import let

#: Kinds in order; on equal starts a span of an earlier kind comes first.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run has no later start that is long enough
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
MIN_CHARS = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_CHARS},}}={{0,2}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Bits by which a run must look more random than ordinary, in all and per character.
MIN_RATIO = 16.0
MIN_MEAN = 0.5
SAMPLE_DOCS = 2000
SMOOTHING = 0.5
#: Labelled ordinary: what identifiers, paths and host names are made of.
ORDINARY = (
    "get set is has to from with by of in on at for the and or not new old add remove delete create update find search "
    "list array map key value name type id index count size length width height min max sum first last next previous "
    "start end begin stop open close read write load save file path dir folder home user usr local lib bin etc var share "
    "include src test main app api http https www com org net html json xml config settings default option version build "
    "make python java linux unix windows server client host port request response session token page class object "
    "function method factory builder manager handler service provider controller listener event message string number "
    "integer float double boolean true false null none error exception warning abstract interface base proxy singleton "
    "bean context node tree graph table column row field record model view template style color image audio video text "
    "document language unknown generic package module library system site http2 utf8 x86 x64 v1 v2 2024 01 12 31 100 1000"
).split()
IN_ORDER = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "1-2-3-4", "1_2_3_4", "1/2/3/4")

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, gate: str, pattern: str, kind: int, passes) -> Column:
    """Spans of the matches of ``pattern`` for which ``passes(match, value)`` holds.

    Places are running sums over the matches and the gaps between them, so that
    they count code points whatever the regular expression engine counts.
    """
    value_group = 2 if kind == 0 else 0

    def place(found):
        def step(acc, i):
            start = acc["at"] + F.length(F.get(found["gaps"], i))
            match = F.get(found["all"], i)
            end = start + F.length(match)
            span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            good = passes(match, F.get(found["values"], i))
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found["all"]) - 1), zero, step, lambda acc: acc["out"])

    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("values"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    return F.when(text.rlike(gate), let(found, place)).otherwise(F.array().cast(_SPANS))


def rule_spans(text: Column) -> Column:
    """Spans by the rules, in order."""
    always = lambda match, value: F.lit(True)
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, ASSIGN, 0, lambda match, value: F.length(value) >= MIN_VALUE),
            _spans(text, ACCESS, ACCESS, 1, always),
            _spans(text, HEX, HEX, 2, always),
        )
    )


def _steps(value: Column) -> Column:
    """Places of a string's character pairs in the flat transition table."""
    width = len(ALPHABET)

    def pairs(chars):
        codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        return let(
            codes,
            lambda k: F.transform(
                F.sequence(F.lit(1), F.size(k) - 1), lambda i: F.get(k, i - 1) * width + F.get(k, i)
            ),
        )

    return F.when(F.length(value) > 1, let(F.split(value, ""), pairs)).otherwise(F.array().cast("array<int>"))


def train(samples: DataFrame, value: str = "value", random: str = "random") -> list[float]:
    """The ratio in bits of every transition, from rows of ``(value, random)``.

    Characters outside ``ALPHABET`` are left out. The result has one number for each
    pair of characters; only those sums reach the driver.
    """
    clean = F.regexp_replace(F.coalesce(value, F.lit("")), f"[^{ALPHABET.replace('-', '')}-]", "")
    counted = (
        samples.where(F.col(random).isNotNull())
        .groupBy(clean.alias("_v"), F.col(random).cast("boolean").alias("_r"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_r", "_n", F.explode(_steps(F.col("_v"))).alias("_step"))
        .groupBy("_r", "_step")
        .agg(F.sum("_n").alias("_n"))
        .collect()
    )
    from math import log2

    width = len(ALPHABET)
    counts = {True: [0.0] * width**2, False: [0.0] * width**2}
    for r in counted:
        counts[r["_r"]][r["_step"]] = r["_n"]
    if not counted:
        return [0.0] * width**2
    logs = {}
    for label, c in counts.items():
        rows = [sum(c[a * width : (a + 1) * width]) for a in range(width)]
        logs[label] = [log2((c[i] + SMOOTHING) / (rows[i // width] + SMOOTHING * width)) for i in range(width**2)]
    return [round(x - y, 4) for x, y in zip(logs[True], logs[False])]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio in bits of a string of ``ALPHABET`` characters, each of its transitions once."""
    table = F.expr("cast(split('" + ",".join(map(repr, model)) + "', ',') as array<double>)")
    return F.aggregate(F.array_distinct(_steps(value)), F.lit(0.0), lambda acc, step: acc + F.get(table, step))


def markov_spans(text: Column, model: list[float]) -> Column:
    def passes(match, _):
        return let(ratio(match, model), lambda r: (r >= MIN_RATIO) & (r >= MIN_MEAN * F.length(match)))

    return _spans(text, TOKEN, TOKEN, 3, passes)


def scan(docs: DataFrame, model: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, rules, spans)``: whole texts (NULL: empty), spans by rules, and all spans.

    A run that overlaps a span of a rule is already reported and adds none.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.withColumns({"rules": rule_spans(F.col("text")), "more": markov_spans(F.col("text"), model)})
    apart = F.filter(
        "more", lambda m: ~F.exists("rules", lambda r: (r["start"] < m["end"]) & (m["start"] < r["end"]))
    )
    return found.select(key, "text", "rules", F.array_sort(F.concat("rules", apart)).alias("spans"))


def span_text(spans: str | Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``."""

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, done))


def _shapes(words: Column) -> Column:
    """A path, a slug, snake, camel and upper case of some words."""
    titled = F.transform(words, F.initcap)
    snake = F.array_join(words, "_")
    return F.array(
        F.concat(F.lit("/"), F.array_join(words, "/")), F.array_join(words, "-"), snake, F.upper(snake),
        F.array_join(titled, ""), F.concat(F.get(words, F.lit(0)), F.array_join(F.slice(titled, 2, 40), "")),
    )


def labelled_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(value, random)`` from at most ``sample_docs`` documents, chosen by the hash of id and text.

    Rows that repeat both are one document. Hashes are compared only where they lie in a
    range that four times as many rows as wanted should fall into, so that neither the
    choice nor a row with very many copies moves more than a few.
    """
    order = F.xxhash64(F.col(key), F.xxhash64(text))
    chosen = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), order.alias("_h"))
    share = min(1.0, 4 * sample_docs / max(1, docs.count()))
    near = chosen.where(F.pmod("_h", F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    picked = near.select("_h").distinct().orderBy("_h").limit(sample_docs)
    # Only hashes are sorted; their texts are fetched after.
    sample = near.join(F.broadcast(picked), "_h", "left_semi").dropDuplicates(["_h"])
    digest = F.sha2(F.concat_ws("|", F.lit("sample"), F.col("_h").cast("string")), 256)
    made = F.array(
        F.substring(digest, 1, 40),
        F.base64(F.unhex(digest)),
        F.conv(F.substring(digest, 1, 15), 16, 36),
        F.lower(F.conv(F.substring(digest, 16, 15), 16, 36)),
        F.translate(F.base64(F.unhex(F.md5(digest))), "+/", "-_"),
    )
    ruled = F.transform(rule_spans(F.col("_text")), lambda s: F.substring(F.col("_text"), s["start"] + 1, s["end"] - s["start"]))
    values = F.transform(ruled, lambda v: F.regexp_replace(v, r"""^.*[:="'\x20]""", ""))
    words = F.regexp_extract_all("_text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    numbers = F.regexp_extract_all("_text", F.lit(r"(?<![A-Za-z0-9+/_-])[0-9][0-9-]{2,}(?![A-Za-z0-9+/_-])"), F.lit(0))
    joined = F.concat(
        F.array_join(F.slice(F.col("w"), 1, 40), "_"),
        F.lit("-"),
        F.array_join(F.transform(F.slice(F.col("w"), 1, 40), F.initcap), ""),
        F.lit("/"),
        F.array_join(F.transform(F.slice(F.col("w"), 1, 40), F.upper), "_"),
    )
    known = F.array(*map(F.lit, ORDINARY))
    picks = F.array(*(F.get(known, F.pmod(F.xxhash64("_h", F.lit(k)), F.lit(len(ORDINARY))).cast("int")) for k in range(6)))
    rows = sample.select(
        F.concat(made, values).alias("r"), words.alias("w"), numbers.alias("n"), picks.alias("g")
    ).withColumn(
        "o", F.concat("w", "n", F.array(joined), _shapes(F.slice("w", 1, 40)), _shapes(F.col("g")), F.array(*map(F.lit, IN_ORDER)))
    )
    return (
        rows.select(F.explode("r").alias("value"), F.lit(True).alias("random"))
        .unionByName(rows.select(F.explode("o").alias("value"), F.lit(False).alias("random")))
        .where(F.length("value") > 1)
    )
