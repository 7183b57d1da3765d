"""Resampling documents towards a target's distribution of hashed word features.

Features are all runs of one and two consecutive words, hashed into buckets. The
gain of a bucket is the floored logarithm of how much likelier the target makes
it; a document's weight is the floored mean gain of its features; its score adds
seeded Gumbel noise, so that the highest scores are a draw without replacement in
proportion to the weights' exponentials.

How it runs. Each partition counts its buckets in one array, whatever the
number of texts; these arrays are added up, and the gains (one array of as many entries as there are buckets)
are put to every feature of a document's array of buckets. The draw is a distributed quickselect: random rows still in
question give pivot keys, one aggregate counts exactly how many rows lie above and
on each, and the range between the two pivots around the k-th key is all that is
left for the next round. Only the drawn rows are sorted, in range partitions.

Keys are (score down, id up, row up), where the row number belongs to the stored
table of scores; so every key differs, ties included, and each round is certain to
get smaller.

Rows: a NULL text is empty; without features a weight is 0, and the score is noise
alone. A NULL id comes after others on ties and draws noise as the empty string
does. Repeated rows get the same score and ranks of their own. Whole texts are
used, however long. Empty documents give no rows; an empty target counts 0
everywhere. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stored
from colloquy.operators.ordering import global_position

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Pivot keys of one round of the selection.
PIVOTS = 31
#: Bytes up to "z" that are no digit or letter, as the contract of words lists them.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, with A-Z lowered."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, _GAP), lambda w: w != "")


def feature_buckets(word_list: str, buckets: int = BUCKETS) -> Column:
    """Buckets of all single words, then of all pairs of neighbours."""
    of = lambda s: F.pmod(F.crc32(s.cast("binary")), F.lit(buckets)).cast("int")
    n = F.greatest(F.size(word_list) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(word_list, F.lit(1), n), F.slice(word_list, F.lit(2), n), lambda a, b: of(F.concat(a, F.lit(" "), b))
    )
    return F.concat(F.transform(word_list, of), pairs)


def _featured(table: DataFrame, keep: dict[str, Column], text: str, buckets: int) -> DataFrame:
    split = table.select(*[c.alias(n) for n, c in keep.items()], words(F.col(text)).alias("_words"))
    return split.select(*keep, F.size("_words").alias("_n"), feature_buckets("_words", buckets).alias("_at"))


def bucket_counts(table: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Features of all texts by bucket; at most ``buckets`` rows come to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("_at").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counted = _featured(table, {}, text, buckets).select("_at").mapInArrow(run, "at bigint, n bigint")
    out = [0] * buckets
    for r in counted.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the ratio of smoothed shares), target over source."""
    n, s, t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(((b + 1) * (s + n)) / ((a + 1) * (t + n)))) for a, b in zip(source, target)]


def noise(seed: int, key: Column) -> Column:
    """floor of 1000 times a Gumbel variate that seed and key fix."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """``(key, n_words, n_features, weight, score)`` of every document."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one array
    rows = _featured(docs, {key: F.col(key)}, text, buckets).select(
        key,
        F.col("_n").cast("bigint").alias("n_words"),
        F.size("_at").cast("bigint").alias("n_features"),
        F.aggregate("_at", F.lit(0).cast("bigint"), lambda total, b: total + F.get(table, b)).alias("_sum"),
    )
    # Whole-number division of the multiple below, so that no rounding of doubles is met.
    below = (F.col("_sum") - F.pmod("_sum", "n_features")) / F.col("n_features")
    weight = F.when(F.col("n_features") > 0, below).otherwise(0).cast("bigint")
    return rows.withColumn("weight", weight).select(
        key, "n_words", "n_features", "weight", (F.col("weight") + noise(seed, F.col(key))).alias("score")
    )


def _before(key: str, pivot: dict) -> Column:
    """Whether a row's key comes before the pivot's, by columns that push down and generate code."""
    score, row = F.col("score"), F.col("_row")
    k, p = F.col(key), pivot["key"]
    if p is None:
        earlier, same = k.isNotNull(), k.isNull()
    else:
        earlier, same = F.coalesce(k < F.lit(p), F.lit(False)), k.eqNullSafe(F.lit(p))
    tied = earlier | (same & (row < pivot["row"]))
    return (score > pivot["score"]) | ((score == pivot["score"]) & tied)


def quickselect(rows: DataFrame, k: int, key: str, pivots: int = PIVOTS, seed: int = SEED) -> dict:
    """The k-th key (from 1) of the draw's order, as a pivot; ``rows`` hold at least ``k``."""
    rows = rows.select("score", key, "_row")
    low = high = None  # the places and keys between which the k-th one is
    for turn in itertools.count():
        left = rows
        if high is not None:
            left = left.where(_before(key, high[1]))
        if low is not None:
            left = left.where(~_before(key, low[1]) & (F.col("_row") != low[1]["row"]))
        # Random rows that are still in question; their hashes change with the turn.
        order = F.xxhash64("_row", F.lit(seed), F.lit(turn))
        drawn = left.orderBy(order, "_row").limit(pivots).collect()
        found = [{"score": r["score"], "key": r[key], "row": r["_row"]} for r in drawn]
        counts = left.agg(*[F.sum(_before(key, p).cast("bigint")).alias(f"n{i}") for i, p in enumerate(found)]).first()
        # Before, on (the pivot's own row alone) and after each pivot.
        start = 0 if low is None else low[0] + 1
        for place, pivot in sorted(((start + counts[i], p) for i, p in enumerate(found)), key=lambda x: x[0]):
            if place == k - 1:
                return pivot
            if place < k - 1:
                low = (place, pivot)
            else:
                high = (place, pivot)
                break


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """All documents with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (NULL where not drawn)."""
    scored = scores(docs, target, key, text, target_text, seed, buckets)
    rows = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")
    kept = [c for c in rows.columns if c != "_row"]
    eligible = rows.where(F.col("n_words") >= least_words)
    k = percent * eligible.count() // 100
    unranked = F.lit(None).cast("bigint").alias("rank")
    if not k:
        return rows.select(*kept, unranked)
    last = quickselect(eligible, k, key, seed=seed)
    drawn = (F.col("n_words") >= least_words) & (_before(key, last) | (F.col("_row") == last["row"]))
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), "_row"]
    ranked = global_position(rows.where(drawn).withColumnRenamed("_row", "_at"), *order[:2], "_at", out="_pos")
    return ranked.select(*kept, (F.col("_pos") + 1).alias("rank")).unionByName(rows.where(~drawn).select(*kept, unranked))
