"""Quality rules with robust multivariate outlier tests. Built-in expressions only.

Statistics of every whole text are turned into a vector. For each language and
source the minimum covariance determinant estimate of its location and scatter is
found by concentration steps from two starts (medians and quartile ranges; means
and all covariances), reweighted once, and documents whose squared Mahalanobis
distance exceeds the chi-square quantile ``1 - REJECT`` are rejected. Documents that
fail the base rules are no part of the estimates.

The texts are read once; the steps run on a narrow table with a row per document.
Each step is two map-side combined aggregations, so a source with a third of all
rows adds one partial row per task. Half-sample limits are ``percentile_approx``
with an accuracy of 1/10000.

``FLOORS`` are least standard deviations: where most documents agree exactly, as on
having no symbols, plain estimates would make any other value an outlier. So that each
statistic can reject by itself, repeated words count against the rest up to what the base
rule lets pass, and repeated lines against the different ones.

Rows: a NULL text has no words and fails the base rules. A NULL language or source
is a value of its own. Groups under ``MIN_GROUP`` documents are pooled by language, then
all together, and a pool that is still smaller gets no verdict but the base rules'.
Repeated rows count as often as they occur and get equal verdicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import let, stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 50
COVERAGE = 0.75
REWEIGHT = 0.975
REJECT = 1e-6
STEPS = 5
BROADCAST_GROUPS = 20_000
#: Word length (log), symbols and capitals (roots of shares), repeated words and repeated lines (roots of odds).
FLOORS = (0.08, 0.03, 0.05, 0.2, 0.2)
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are compared as 64-bit hashes. Sorting them with their places puts equal
    ones side by side; covered words are then counted from the sorted places.
    """

    def covered(places):
        last = F.size(places) - 1
        gap = lambda i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - F.get(places, i), F.lit(3)))
        return F.when(last < 0, F.lit(0)).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), F.lit(0), lambda acc, i: acc + gap(i))
        )

    def in_sorted(windows):
        same = lambda i, j: F.coalesce(F.get(windows, i)["h"] == F.get(windows, j)["h"], F.lit(False))
        marked = F.transform(windows, lambda w, i: F.when(same(i, i - 1) | same(i, i + 1), w["at"]))
        return let(F.array_sort(F.filter(marked, lambda x: x.isNotNull())), covered)

    def of_hashes(hashes):
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(pairs), in_sorted)
        )

    def of_words(w):
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(key, text_hash, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals)``."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"), F.xxhash64(text).alias("text_hash"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), t.alias("_text")
    )
    rest = lambda pattern: F.length(F.regexp_replace("_text", pattern, ""))
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD))
    by_words = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    long = lambda c: c.cast("bigint")
    return rows.select(
        "_key", "text_hash", "_lang", "_source", by_words.alias("w"), by_lines.alias("l"),
        long(F.length("_text") - rest(WORD)).alias("word_chars"),
        long(rest(SYMBOLS)).alias("n_symbols"),
        long(rest(r"\P{Lu}+")).alias("n_capitals"),
    ).select(
        F.col("_key").alias(key), "text_hash", F.col("_lang").alias("lang"), F.col("_source").alias("source"),
        long(F.col("w.n")).alias("n_words"), "word_chars", "n_symbols", long(F.col("l.d")).alias("n_dup_lines"),
        long(F.col("w.r")).alias("n_repeat_words"), long(F.col("l.n")).alias("n_lines"), "n_capitals",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> dict[str, Column]:
    """Repeated words and lines are odds, not shares: like the share while small, without bound near the most that passes."""
    limit = MAX_REPEAT_PERCENT / 100
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x1": share("n_symbols", "word_chars"),
        "x2": share("n_capitals", "word_chars"),
        "x3": F.sqrt(limit * F.col("n_repeat_words") / (F.greatest(limit * F.col("n_words") - F.col("n_repeat_words"), F.lit(0)) + 1)),
        "x4": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines") - F.col("n_dup_lines"), F.lit(1))),
    }


def chi2_cdf(x: float, p: int) -> float:
    """By the series of the incomplete gamma function."""
    a, z = p / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def consistency(share: float, p: int = P) -> float:
    """Factor that makes the scatter of the inner ``share`` that of a normal sample."""
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table of one row per group, ready to be joined: broadcast only if counted to be small."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean, scatter (times ``factor``, plus floors) and its Cholesky factor by group."""
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(x).alias(f"s_{x}") for x in X],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"c_{i}{j}") for i, j in PAIRS],
    )
    means = {f"m{i}": F.col(f"s_{x}") / F.col("n") for i, x in enumerate(X)}
    out = sums.withColumns(means)
    scatter = {
        f"c{i}{j}": factor * (F.col(f"c_{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
        + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for i, j in PAIRS
    }
    return _cholesky(out.select(*keys, *means, *[v.alias(k) for k, v in scatter.items()]), keys)


def _cholesky(scatter: DataFrame, keys: list[str]) -> DataFrame:
    df = scatter
    for j in range(P):
        inner = lambda i, j=j: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner(j), F.lit(FLOORS[j] ** 2 * 1e-3))))
        df = df.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - inner(i)) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    size = sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    return df.select(*keys, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS], size.alias("log_det"))


def _distance(rows: DataFrame, estimates: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the squared Mahalanobis distance ``d2``, by forward substitution."""
    df = rows.join(estimates, keys, how)
    for i in range(P):
        known = sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z{i}", (F.col(X[i]) - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))
    return df.select(*rows.columns, d2.alias("d2"))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges (start 0), means and covariances (start 1)."""
    quartiles = rows.groupBy("group").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i, x in enumerate(X)])
    spread = lambda i: F.pow((F.get(f"q{i}", 2) - F.get(f"q{i}", 0)) / 1.349, 2) + FLOORS[i] ** 2
    robust = quartiles.select(
        "group", F.lit(0).alias("start"), *[F.get(f"q{i}", 1).alias(f"m{i}") for i in range(P)],
        *[(spread(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS],
    )
    plain = _moments(rows.withColumn("start", F.lit(1)), ["group", "start"], 1.0)
    return _cholesky(robust, ["group", "start"]).unionByName(plain)


def mcd(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Reweighted estimate per ``group`` of rows with columns ``x0 ..``: means, Cholesky factor, ``log_det``."""
    keys = ["group", "start"]
    both = rows.select("group", *X).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    estimates = _small(_start(rows.select("group", *X)), "mcd-start")
    for _ in range(steps):
        placed = _distance(both, estimates, keys)
        limit = _small(placed.groupBy(*keys).agg(F.percentile_approx("d2", COVERAGE, 10000).alias("limit")), "mcd-limit")
        inner = placed.join(limit, keys).where("d2 <= limit")
        estimates = _small(_moments(inner, keys, consistency(COVERAGE)), "mcd-step")
    best = estimates.groupBy("group").agg(F.min(F.struct("log_det", "start")).alias("best"))
    chosen = _small(
        estimates.join(best, "group").where(F.col("start") == F.col("best.start")).drop("best", "start"), "mcd-best"
    )
    near = _distance(rows.select("group", *X), chosen, ["group"]).where(F.col("d2") <= chi2_quantile(REWEIGHT, P))
    return _small(_moments(near, ["group"], consistency(REWEIGHT)), "mcd")


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Statistics of every row with ``base_failed``, the squared distance ``d2`` and ``kept``."""
    stats = statistics(docs, key, text, lang, source).withColumn("base_failed", base_failed()).withColumns(vector())
    stats = stored(stats, "statistics")
    # The finest of (language, source), (language), all that has enough rows to estimate from.
    fine, coarse = F.to_json(F.struct("lang", "source", F.lit(2).alias("level"))), F.to_json(F.struct("lang", F.lit(1).alias("level")))
    sizes = (
        stats.where(~F.col("base_failed"))
        .groupBy("lang", "source")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("small", F.col("n") < MIN_GROUP)
    )
    pooled = sizes.where("small").groupBy(F.col("lang").alias("pool")).agg(F.sum("n").alias("pool_n"))
    groups = _small(
        sizes.join(pooled, F.col("lang").eqNullSafe(F.col("pool")), "left").select(
            F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
            F.when(~F.col("small"), fine).when(F.col("pool_n") >= MIN_GROUP, coarse).otherwise(F.lit("{}")).alias("group"),
        ),
        "groups",
    )
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    grouped = stored(stats.join(groups, same, "left").drop("g_lang", "g_source"), "grouped-statistics")
    rest = grouped.where((F.col("group") == "{}") & ~F.col("base_failed")).limit(MIN_GROUP).count()
    fitted = grouped.where(~F.col("base_failed") & ((F.col("group") != "{}") | F.lit(rest >= MIN_GROUP)))
    judged = _distance(grouped, mcd(fitted), ["group"], "left")
    inside = F.coalesce(F.col("d2") <= chi2_quantile(1 - REJECT, P), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("group", *X)
