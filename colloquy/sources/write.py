"""Sinks: training shards in global order, accepted rows and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shard_of(rows_per_shard: int, position: str = "pos"):
    if rows_per_shard < 1:
        raise ValueError("rows_per_shard must be positive")
    return F.floor(F.col(position) / F.lit(rows_per_shard)).cast("long")


def write_training_shards(
    df: DataFrame,
    path: str,
    rows_per_shard: int,
    position: str = "pos",
    mode: str = "overwrite",
    partitioned: bool = False,
) -> None:
    """Parquet under ``shard=N/``, shard N holding positions ``[N*rows, (N+1)*rows)`` in order.

    The shard is computed from the position, so no bounds are sampled, a retried
    task writes the same file again, and positions spread evenly whatever the
    sources look like. Sorting by shard keeps one writer open per task. With
    ``partitioned`` the frame comes with its ``shard`` column and is partitioned
    by it (see ``plans.prepare.training_arrays``), so it does not move again; without,
    a column of that name is replaced.
    """
    if not partitioned:
        df = df.withColumn("shard", shard_of(rows_per_shard, position)).repartition("shard")
    df.sortWithinPartitions("shard", position).write.mode(mode).partitionBy("shard").parquet(path)


def write_quarantine(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Accepted and rejected rows in one pass: ``accepted=true/`` and ``accepted=false/``.

    ``df`` carries ``reject_reason`` (see ``operators.quality.quarantine``).
    """
    (
        df.withColumn("accepted", F.col("reject_reason").isNull())
        .write.mode(mode)
        .partitionBy("accepted")
        .parquet(path)
    )
