"""Reproducible orders and contiguous positions, without a one-task sort.

Positions come in two passes over narrow columns: count rows per bucket of the
order, then number the rows inside each bucket and add the rows of the buckets
before it. Callers pass key columns and join payload to the finished plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import fixed
from colloquy.operators.skew import pin

# At least so many buckets, and no more rows in one than this on average.
BUCKETS = 4096
BUCKET_ROWS = 1 << 18
BLOCK_ROWS = 1 << 18
_ROW_BITS = 33


def hash_key(seed: int, *parts: Column | str) -> Column:
    """Layout-independent sort key: md5 of ``seed|part|...``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_fraction(md5: Column) -> Column:
    """First 32 bits of an md5 as a whole number below 2**32."""
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("bigint")


def _number_in_buckets(df: DataFrame, within: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """0-based contiguous number per ``within`` when ``bucket`` is monotone in ``order``.

    The offset table has one row per bucket and is joined on the columns the
    numbering already partitioned by, so the rows move once.
    """
    offsets = (
        df.groupBy(*within, bucket)
        .count()
        .select(
            *within,
            bucket,
            F.coalesce(
                F.sum("count").over(
                    Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    inside = F.row_number().over(Window.partitionBy(*within, bucket).orderBy(*order))
    numbered = df.withColumn("_inside", inside)
    return (
        numbered.join(offsets, [*within, bucket])
        .withColumn(out, (F.col("_before") + F.col("_inside") - 1).cast("bigint"))
        .select(*[c for c in df.columns if c != bucket], out)
    )


def seeded_shuffle(
    df: DataFrame,
    key: str,
    seed: int = fixed.DEFAULT_SEED,
    source: str = "source_id",
    buckets: int | None = None,
    out: str = "rank",
) -> DataFrame:
    """Full permutation of every source: ``out`` is the 0-based place in its shuffled order.

    The number of buckets grows with the rows, which are counted for it; the
    order does not depend on it. Give pinned keys where they are dear to compute.

    Buckets are leading hash bits, so they are even whatever the source sizes
    are, and a source with most of the rows is numbered by ``buckets`` tasks.
    ``key`` is unique within a source and neither column is NULL;
    ``SourceSpec.row_key`` makes such a key where samples have none.
    """
    if buckets is None:
        buckets = max(BUCKETS, -(-df.count() // BUCKET_ROWS))
    md5 = hash_key(seed, source, key)
    keyed = df.withColumn("shuffle_key", md5).withColumn(
        "_bucket", F.shiftright(hash_fraction(F.col("shuffle_key")) * F.lit(buckets), 32)
    )
    return _number_in_buckets(keyed, [source], "_bucket", ["shuffle_key", key], out).drop("shuffle_key")


def global_position(df: DataFrame, *order, partitions: int | None = None, out: str = "pos") -> DataFrame:
    """Contiguous 0-based position in any total order (end it with a unique column).

    Range partitions are sampled, so the sorted layout is pinned by a reliable
    checkpoint before rows are counted. The offsets hold one row per partition.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    laid = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order))
    laid = pin(laid.sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", _ROW_BITS)
    offsets = (
        laid.groupBy(part.alias("_part"))
        .count()
        .select(
            "_part",
            F.coalesce(
                F.sum("count").over(
                    Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    return (
        laid.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(out, (F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).cast("bigint"))
        .select(*df.columns, out)
    )


def compact_positions(
    df: DataFrame, position: str = "pos", block: int = BLOCK_ROWS, out: str = "pos"
) -> DataFrame:
    """Close the gaps that a filter left in ``position``, keeping the order."""
    df = df.withColumns(
        {"_old": F.col(position), "_one": F.lit(0), "_bucket": F.floor(F.col(position) / F.lit(block))}
    ).drop(position)
    return _number_in_buckets(df, ["_one"], "_bucket", ["_old"], out).drop("_old", "_one")


def arrival_numbers(df: DataFrame, order: list[str], source: str = "source_id", out: str = "at") -> DataFrame:
    """0-based number of every row in its source's order of arrival; ``order`` is unique within a source."""
    placed = global_position(df, source, *order, out="_place")
    starts = placed.groupBy(source).agg(F.min("_place").alias("_start"))
    return placed.join(starts, source).withColumn(out, F.col("_place") - F.col("_start")).select(*df.columns, out)


def buffer_rows(buffer: int | dict, source: str) -> Column:
    """Rows of a source's buffer: ``{source: rows}``, with the default for sources it does not name, or one number."""
    if not isinstance(buffer, dict):
        buffer, rows = {}, F.lit(buffer)
    else:
        rows = F.lit(fixed.DEFAULT_SHUFFLE_BUFFER)
    named = _per_source(buffer, source)
    return (rows if named is None else F.coalesce(named, rows)).cast("bigint")


def leave_buffer(
    arrived: DataFrame, buffer: int | dict, seed: int, source: str, at: str = "at", out: str = "rank",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """When every row leaves a buffer of random places; NULL for those that are still in it.

    The first ``buffer`` rows of a source take its places in turn. Each later row
    takes a place that its number draws; the row that stood there leaves. So a row leaves with
    the next draw of its own place, and the k-th row to leave has ``out`` k: a lead
    over (source, place), which no row has to wait for.

    A source with few places has long leads, so these are taken inside blocks of arrivals; only the last
    row of a place in its block looks at the first ones of later blocks.
    """
    rows, number = buffer_rows(buffer, source), F.col(at)
    draw = F.pmod(hash_fraction(hash_key(seed, source, at)), rows)
    placed = arrived.withColumns(
        {
            "_place": F.when(number < rows, number).otherwise(draw),
            "_block": F.floor(number / F.greatest(F.lit(block_rows), rows * 16)),
        }
    )
    cell = [source, "_place", "_block"]
    inside = placed.withColumn("_next", F.lead(at).over(Window.partitionBy(*cell).orderBy(at)))
    firsts = placed.groupBy(*cell).agg(F.min(at).alias("_first"))
    later = firsts.withColumn("_later", F.lead("_first").over(Window.partitionBy(source, "_place").orderBy("_block")))
    left = F.coalesce("_next", "_later") - rows
    return inside.join(later.drop("_first"), cell).withColumn(out, left).select(*arrived.columns, out)


def bounded_shuffle(
    df: DataFrame,
    key: str,
    buffer: int | dict = fixed.DEFAULT_SHUFFLE_BUFFER,
    seed: int = fixed.DEFAULT_SEED,
    source: str = "source_id",
    arrival: str | None = None,
    out: str = "rank",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Shuffle of every source's arrival order through a buffer of ``buffer`` random places.

    ``buffer`` may differ by source, see ``buffer_rows``. Rows leave as ``leave_buffer`` says; those that
    are left at the end follow in the order of their hashes. ``arrival`` orders the rows of a
    source (``key`` unless given) and is unique in it.
    """
    numbered = pin(arrival_numbers(df, [arrival or key], source, "_at"))
    moved = pin(leave_buffer(numbered, buffer, seed, source, "_at", "_rank", block_rows))
    gone = moved.where(F.col("_rank").isNotNull()).select(*df.columns, F.col("_rank").alias(out))
    last = drain_buffer(moved.where(F.col("_rank").isNull()), key, buffer, seed, source, "_at", out)
    return gone.unionByName(last.select(*df.columns, out))


def drain_buffer(
    held: DataFrame, key: str, buffer: int | dict, seed: int, source: str, at: str = "at", out: str = "rank"
) -> DataFrame:
    """Places of the rows that are in the buffers when no more arrive.

    The row of the highest number is always among them, which tells how many have left before.
    """
    sizes = held.groupBy(source).agg((F.max(at) + 1).alias("_rows"))
    gone = F.greatest(F.col("_rows") - buffer_rows(buffer, source), F.lit(0))
    ordered = seeded_shuffle(held, key, seed, source, out="_after")
    return ordered.join(sizes, source).withColumn(out, gone + F.col("_after")).drop("_rows", "_after")


def _per_source(values: dict, source: str) -> Column:
    out = None
    for k, v in values.items():
        hit = F.col(source) == F.lit(k)
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out
