"""Batches, ranks, optimizer steps, padding and per-batch reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import fixed
from colloquy.functions import tokens
from colloquy.operators.ordering import compact_positions


def _div(value: Column | str, n: int) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(v / F.lit(n)).cast("bigint")


def assign_batches(
    df: DataFrame,
    batch_size: int,
    position: str = "pos",
    valid: Column | None = None,
    filter: str | None = None,
) -> DataFrame:
    """Consecutive groups of ``batch_size`` positions; the last one may be short.

    With ``valid``, ``filter='before'`` drops invalid rows and renumbers, so all
    batches are full; ``filter='after'`` drops them from the finished batches,
    which become ragged.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    if (valid is None) != (filter is None) or filter not in (None, "before", "after"):
        raise ValueError("give both valid and filter='before' or 'after', or neither")
    if filter == "before":
        df = compact_positions(df.where(valid), position, out=position)
    batched = df.withColumn("batch_id", _div(position, batch_size))
    return batched.where(valid) if filter == "after" else batched


def empty_batches(planned: DataFrame, valid: Column, fail: bool = False) -> DataFrame:
    """Batches of the unfiltered plan in which no row is valid."""
    alive = F.max(F.coalesce(valid, F.lit(False)))
    empty = planned.groupBy("batch_id").agg(alive.alias("_alive")).where(~F.col("_alive")).select("batch_id")
    if fail and empty.take(1):
        raise ValueError("a batch has no valid sample")
    return empty


def shard_plan(
    df: DataFrame,
    world: int,
    batch_size: int = 1,
    workers: int = 1,
    position: str = "pos",
    length: int | None = None,
) -> DataFrame:
    """Rank, batch within the rank and loader worker of every position.

    Ranks take positions round robin; the first rows are used again at the end
    until all ranks have equally many. Each row derives its own repeats from the
    length of the plan, so nothing is re-read or unioned. ``length`` counts the
    positions of the unfiltered plan; without it, it is the last position plus
    one, for which ``df`` is evaluated once more. Positions may have gaps, as
    ``filter='after'`` leaves them.
    """
    n = F.lit(length) if length is not None else df.agg((F.max(position) + 1).alias("n")).scalar()
    total = F.ceil(F.col("_n") / F.lit(world)).cast("bigint") * F.lit(world)
    spread = (
        df.withColumn("_n", n)
        .withColumn("_at", F.explode(F.sequence(F.col(position), total - 1, F.col("_n"))))
        .drop("_n", position)
        .withColumnRenamed("_at", position)
    )
    turn = _div(position, world)
    return spread.withColumns(
        {"rank": F.pmod(F.col(position), F.lit(world)).cast("bigint"), "batch_in_rank": _div(turn, batch_size)}
    ).withColumn("worker", F.pmod(F.col("batch_in_rank"), F.lit(max(workers, 1))).cast("bigint"))


def step_plan(df: DataFrame, accumulate: int = 1, max_steps: int | None = None) -> DataFrame:
    """Optimizer step of a rank's batch; ``max_steps`` ends the run."""
    steps = df.withColumn("step", _div("batch_in_rank", accumulate))
    return steps if max_steps is None else steps.where(F.col("step") < max_steps)


def pad_to_longest(
    df: DataFrame,
    ids: str = "input_ids",
    by: str | tuple[str, ...] = "batch_id",
    pad_id: int = fixed.PAD_ID,
    length: Column | None = None,
    ready: Column | None = None,
) -> DataFrame:
    """Right-pad to the longest row of the batch; adds ``length``, ``width``, mask and labels.

    Rows may cross the exchange in a compact form: then ``ready`` makes their final
    ids, and ``length`` says beforehand how many those will be.

    The mask is set exactly for the ids that were there before padding, so
    labels are those ids followed by ignored places (what ``tokens.labels``
    yields from the mask), built by copying arrays rather than by element.
    """
    keys = [by] if isinstance(by, str) else list(by)
    missing = F.col("width") - F.col("length")
    return (
        df.withColumn("length", F.size(ids) if length is None else length.cast("int"))
        .withColumn("width", F.max("length").over(Window.partitionBy(*keys)))
        .withColumn(ids, F.col(ids) if ready is None else ready)
        .withColumns(
            {
                "attention_mask": tokens.attention_mask("length", "width"),
                "labels": F.concat(ids, F.array_repeat(F.lit(fixed.IGNORE_LABEL), missing)),
                ids: tokens.pad(ids, "width", pad_id),
            }
        )
    )


def batch_summary(df: DataFrame, by: str | tuple[str, ...] = "batch_id") -> DataFrame:
    """Rows, width, real tokens, pad share and supervised labels of every batch."""
    supervised = F.size("labels") - tokens.count_of("labels", fixed.IGNORE_LABEL)
    keys = [by] if isinstance(by, str) else list(by)
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("width").cast("bigint").alias("width"),
            F.sum("length").alias("real_tokens"),
            F.sum(supervised).alias("supervised"),
        )
        .withColumn("pad_share", 1 - F.col("real_tokens") / (F.col("rows") * F.col("width")))
    )


def batch_modality(df: DataFrame, has_image: Column | str = "has_image", by: str = "batch_id") -> DataFrame:
    """``text``, ``image`` or ``mixed``."""
    flag = F.col(has_image) if isinstance(has_image, str) else has_image
    return df.groupBy(by).agg(
        F.when(~F.max(flag), "text").when(F.min(flag), "image").otherwise("mixed").alias("modality"),
        F.sum(flag.cast("bigint")).alias("images"),
    )


def batch_images(df: DataFrame, ref: str = "ref", position: str = "pos", by: str = "batch_id") -> DataFrame:
    """Image refs of a batch in sample order; rows without an image contribute none."""
    held = F.collect_list(F.when(F.col(ref).isNotNull(), F.struct(position, ref)))
    return df.groupBy(by).agg(F.transform(F.sort_array(held), lambda x: x[ref]).alias("images"))


def collate(df: DataFrame, fn: Callable, schema, by: str = "batch_id") -> DataFrame:
    """User hook: ``fn`` gets one batch (at most ``batch_size`` rows) as pandas."""
    return df.groupBy(by).applyInPandas(fn, schema)


def collate_rows(
    df: DataFrame, handler: type, schema, by: str | tuple[str, ...] = "batch_id", order: str | tuple[str, ...] = "pos"
) -> DataFrame:
    """User hook as a table function: ``handler().eval(row)`` sees a batch row by row in ``order``.

    Both ``eval`` and ``terminate``, which is called at the end of each batch, may yield
    rows of ``schema``. No batch is held as a whole, so its size has no bound. A NULL
    batch is one batch. ``collate`` is faster where whole batches fit.
    """
    keys, places = ([x] if isinstance(x, str) else list(x) for x in (by, order))
    table = df.asTable().partitionBy(*keys).orderBy(*places)
    return F.udtf(handler, returnType=schema, useArrow=True)(table)
