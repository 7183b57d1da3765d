"""Weighted interleaving of shuffled sources with a stopping rule.

Slot after slot draws a source with its share as probability and takes that
source's next row; a source that ends starts over. The draw depends on seed and
slot only, so any range of slots can be computed anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import fixed
from colloquy.operators.ordering import _per_source, hash_fraction, hash_key
from colloquy.schema import shares

STOPS = ("all_exhausted", "first_exhausted")
MIN_BLOCK, MAX_BLOCK = 1 << 14, 1 << 20
# The offset table has (sources x blocks) rows of 20 bytes; it is broadcast up to this many.
OFFSET_ROWS = 400_000
# Slots that may meet one row of a repeated source in the join.
HITS_PER_ROW = 1_000


def normalize_weights(specs: DataFrame, weight: str = "weight", out: str = "share") -> DataFrame:
    """``w / sum(w)`` over the table of sources (one row per source)."""
    w = F.coalesce(F.col(weight), F.lit(1.0)).cast("double")
    everything = Window.partitionBy(F.lit(0))
    return specs.withColumn(out, w / F.sum(w).over(everything))


def single_source(ranked: DataFrame, rank: str = "rank", out: str = "pos") -> DataFrame:
    """One source needs no draw: its shuffled order is the global order."""
    return ranked.withColumnRenamed(rank, out)


def with_drawn_source(slots: DataFrame, slot: str, probability: dict, seed: int, out: str) -> DataFrame:
    """First source whose cumulative share exceeds the slot's uniform draw."""
    u = hash_fraction(hash_key(seed, slot)) / F.lit(float(1 << 32))
    live = [(k, p) for k, p in probability.items() if p > 0]
    choice, reached = None, 0.0
    for k, p in live[:-1]:
        reached += p
        hit = F.col("_u") < reached
        choice = F.when(hit, F.lit(k)) if choice is None else choice.when(hit, F.lit(k))
    last = F.lit(live[-1][0])
    # The draw is a column of its own, so the md5 is taken once and not once per source.
    drawn = slots.withColumn("_u", u).withColumn(out, last if choice is None else choice.otherwise(last))
    return drawn.drop("_u")


def _tasks(spark: SparkSession, most: int) -> int:
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, min(most, wide))


def _slots(
    spark: SparkSession, total: int, block: int, probability: dict, seed: int, source: str, start: int = 0
) -> DataFrame:
    """``(block, slot, source)`` for ``total`` slots from ``start`` on.

    The blocks are range-partitioned at their origin and slots are generated
    from them in place, so counting and numbering per block need no exchange.
    """
    n = math.ceil(total / block)
    blocks = spark.range(0, n, 1, _tasks(spark, n)).withColumnRenamed("id", "block")
    first = F.lit(start) + F.col("block") * F.lit(block)
    last = F.least(first + F.lit(block), F.lit(start + total)) - 1
    slots = blocks.select("block", F.explode(F.sequence(first, last)).alias("slot"))
    return with_drawn_source(slots, "slot", probability, seed, source)


def _block_counts(slots: DataFrame, source: str) -> DataFrame:
    """Draws per source and block, with the draws in earlier blocks."""
    counts = slots.groupBy("block", source).agg(F.count(F.lit(1)).alias("draws"))
    earlier = Window.partitionBy(source).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("draws").over(earlier), F.lit(0)))


def _block_size(total: int, n_sources: int, block: int | None) -> int:
    if block:
        return block
    return max(MIN_BLOCK, min(MAX_BLOCK, math.ceil(total * n_sources / OFFSET_ROWS)))


def _filled_at(spark, lengths, probability, seed, source, total, block, start) -> dict:
    """Per source, the slot that takes its last row for the first time (if among the ``total`` from ``start`` on)."""
    counts = _block_counts(_slots(spark, total, block, probability, seed, source, start), source)
    need = _per_source(lengths, source)
    crossing = counts.where((F.col("before") < need) & (need <= F.col("before") + F.col("draws")))
    first = F.lit(start) + F.col("block") * F.lit(block)
    # One block per source, spread by count because its bytes are too few to tell.
    spread = crossing.select(source, "block", (need - F.col("before")).alias("_nth")).repartition(
        _tasks(spark, len(lengths)), source
    )
    slots = spread.select(
        F.col(source).alias("_want"),
        "_nth",
        F.explode(F.sequence(first, F.least(first + F.lit(block), F.lit(start + total)) - 1)).alias("slot"),
    )
    inside = (
        with_drawn_source(slots, "slot", probability, seed, "_drawn")
        .where(F.col("_drawn") == F.col("_want"))
        .withColumn("_n", F.row_number().over(Window.partitionBy("_want").orderBy("slot")))
        .where(F.col("_n") == F.col("_nth"))
    )
    return {r["_want"]: r["slot"] for r in inside.select("_want", "slot").collect()}


def output_length(
    spark: SparkSession,
    lengths: dict,
    weights: dict,
    seed: int = fixed.DEFAULT_SEED,
    stop: str = fixed.DEFAULT_STOP,
    source: str = "source_id",
    block: int | None = None,
    start: int = 0,
) -> int:
    """Slots from ``start`` until the stopping rule holds. At most one row per source reaches the driver."""
    if stop not in STOPS:
        raise ValueError(f"stop must be one of {STOPS}")
    probability = shares(weights)
    if set(lengths) != set(probability):
        raise ValueError(f"sources without rows or without weight: {set(lengths) ^ set(probability)}")
    never = [k for k, p in probability.items() if p == 0]
    if never and stop == "all_exhausted":
        raise ValueError(f"sources of weight zero would never be exhausted: {never}")
    expected = {
        k: math.ceil((n + 6 * math.sqrt(n) + 20) / probability[k])
        for k, n in lengths.items()
        if probability[k] > 0
    }
    bound = max(expected.values()) if stop == "all_exhausted" else min(expected.values())
    while True:
        size = _block_size(bound, len(lengths), block)
        filled = _filled_at(spark, lengths, probability, seed, source, bound, size, start)
        if filled and (stop == "first_exhausted" or len(filled) == len(lengths)):
            return (max if stop == "all_exhausted" else min)(filled.values()) + 1 - start
        bound *= 2


def turns(
    spark: SparkSession, total: int, probability: dict, seed: int, source: str, block: int | None = None, start: int = 0
) -> DataFrame:
    """``(slot, source, turn)`` for ``total`` slots from ``start`` on; ``turn`` counts the source's earlier draws among them."""
    size = _block_size(total, len(probability), block)
    slots = _slots(spark, total, size, probability, seed, source, start)
    offsets = _block_counts(slots, source).select("block", source, "before")
    if math.ceil(total / size) * len(probability) <= OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    inside = F.row_number().over(Window.partitionBy("block", source).orderBy("slot"))
    return (
        slots.withColumn("_inside", inside)
        .join(offsets, ["block", source])
        .select("slot", source, (F.col("before") + F.col("_inside") - 1).alias("turn"))
    )


def interleave(
    ranked: DataFrame,
    weights: dict,
    seed: int = fixed.DEFAULT_SEED,
    stop: str = fixed.DEFAULT_STOP,
    source: str = "source_id",
    rank: str = "rank",
    block: int | None = None,
) -> DataFrame:
    """Mixed order of shuffled sources: ``pos`` (slot) and ``pass`` (0 for a row's first use).

    ``ranked`` holds key columns with a contiguous 0-based ``rank`` per source
    (see ``seeded_shuffle``); it is read twice, so give a stored or pinned frame
    if computing it is dear. Draws are counted per block of slots. A source that is repeated often gets several copies of its rows, one per group of
    passes, so no row has to meet more than about ``HITS_PER_ROW`` slots.
    """
    spark = ranked.sparkSession
    counted = ranked.groupBy(source).count().limit(len(weights) + 1).collect()
    lengths = {r[source]: r["count"] for r in counted}
    probability = shares(weights)
    total = output_length(spark, lengths, weights, seed, stop, source, block)
    turn, length = F.col("turn"), _per_source(lengths, source)
    picks = turns(spark, total, probability, seed, source, block).select(
        F.col("slot").alias("pos"),
        source,
        F.floor(turn / length).cast("bigint").alias("pass"),
        F.pmod(turn, length).cast("bigint").alias(rank),
    )
    copies = {
        k: math.ceil(total * p / lengths[k] / HITS_PER_ROW) if p > 0 else 1 for k, p in probability.items()
    }
    if max(copies.values()) > 1:
        n = _per_source(copies, source)
        picks = picks.withColumn("_copy", F.pmod("pass", n).cast("bigint"))
        ranked = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"))))
        return picks.join(ranked, [source, rank, "_copy"]).drop("_copy", rank)
    return picks.join(ranked, [source, rank]).drop(rank)


def mixture_report(mixed: DataFrame, weights: DataFrame, key: str, source: str = "source_id") -> DataFrame:
    """Rows, distinct samples, repeats and realised against requested share, per source.

    ``weights`` is the table of ``normalize_weights``; a source that was never
    drawn is listed with zero rows.
    """
    used = mixed.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_samples")
    )
    everything = Window.partitionBy(F.lit(0))
    zero = F.lit(0).cast("bigint")
    report = weights.select(source, F.col("share").alias("requested")).join(used, source, "left")
    rows, distinct = F.coalesce("rows", zero), F.coalesce("distinct_samples", zero)
    return report.select(
        source,
        rows.alias("rows"),
        distinct.alias("distinct_samples"),
        (rows - distinct).alias("repeats"),
        (rows / F.sum(rows).over(everything)).alias("realised"),
        "requested",
    )
