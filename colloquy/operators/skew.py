"""Helpers for hot keys and for pinning an intermediate result."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one key that one task should handle; also bounds the list of hot keys,
# which has at most (rows / HOT_ROWS) entries.
HOT_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the shared checkpoint folder the session names.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is not None:
        return
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the layout is fixed and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str | list[str],
    spread: str,
    hot_rows: int = HOT_ROWS,
    how: str = "left",
    strategy: str | None = None,
) -> DataFrame:
    """Join to a side that is unique on ``key``, with hot keys of ``left`` split.

    A key with ``n`` left rows is split into ``ceil(n / hot_rows)`` salts by the
    hash of ``spread``; only the matching right rows of such keys are repeated,
    once per salt. Counting the keys is a map-side combined aggregate of the key
    columns alone. Rows with a NULL key meet nothing, so they do not move at all.

    ``strategy`` is a join hint. Give ``merge`` where ``left`` makes many rows of few in
    place, as ``mixing.turns`` does: Spark takes such a side for small and would broadcast it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = (
        left.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(hot_rows)).cast("int").alias("_salts"))
        .where(F.col("_salts") > 1)
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    unmatched = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    keyed, rest = left.where(~unmatched), left.where(unmatched) if how == "left" else None
    salted_left = (
        keyed.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
        .drop("_salts")
    )
    salted_right = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    if strategy:
        salted_left = salted_left.hint(strategy)
    joined = salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
    return joined if rest is None else joined.unionByName(rest, allowMissingColumns=True)
