"""Folders that a stream's epochs are committed to, each exactly once.

``foreachBatch`` calls again for an epoch whose end Spark did not record. Everything here
writes data first and then one line in an ``EpochLog``; what has no line is not read, and an
epoch that has one is not written again. A folder belongs to one stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colloquy.plans import prepare as batch

ACCEPTED, REJECTED = "accepted", "rejected"


class EpochLog:
    """The last committed epoch of a folder and what belongs to it.

    Two files by turns: a commit that breaks off leaves the one before it whole.
    """

    _SCHEMA = "epoch bigint, writes bigint, base bigint, slots array<bigint>"

    def __init__(self, path: str):
        self.path = path

    def last(self, spark: SparkSession):
        """Row of the last commit, or None."""
        found = []
        for turn in (0, 1):
            try:
                found += spark.read.schema(self._SCHEMA).parquet(f"{self.path}/{turn}").collect()  # one row
            except Exception as missing:  # nothing is committed yet, or once only
                if "PATH_NOT_FOUND" not in str(missing):
                    raise
        return max(found, key=lambda r: r["writes"], default=None)

    def commit(self, spark: SparkSession, epoch: int, writes: int, base: int | None = None, slots: list[int] = ()) -> None:
        line = spark.createDataFrame([(epoch, writes, base, list(slots))], self._SCHEMA)
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{writes % 2}")


class UpsertTable:
    """The newest row of every key, from a stream in ``update`` mode.

    An epoch writes only the rows it changed. After ``compact_every`` epochs these
    are merged with the last whole table into a new one. Places are reused by turns,
    so the folder holds at most two tables and ``2 * compact_every`` epochs whatever
    the stream's age, and a reader's files stay for ``compact_every`` epochs more.

    Rows: NULL keys are a key like any other. Of rows with one key in one epoch the greatest
    stays. An empty epoch changes nothing. Values must have an order (no maps).
    """

    def __init__(self, path: str, schema: T.StructType, keys: list[str], compact_every: int = 20):
        if not keys or not set(keys) <= set(schema.names):
            raise ValueError(f"keys {keys} are not among {schema.names}")
        if compact_every < 1:
            raise ValueError("compact_every must be at least 1")
        self.path, self.schema, self.keys, self.every = path, schema, keys, compact_every
        self.log = EpochLog(f"{path}/log")

    def _merged(self, spark: SparkSession, base: int | None, slots: list[int]) -> DataFrame:
        """Newest rows of the table ``base`` and of the epochs in ``slots``, oldest first."""
        parts = [] if base is None else [f"{self.path}/table/{base}"]
        parts += [f"{self.path}/epochs/{s}" for s in slots]
        frames = [spark.read.schema(self.schema).parquet(p).withColumn("_age", F.lit(k)) for k, p in enumerate(parts)]
        if not frames:
            return spark.createDataFrame([], self.schema)
        newest = F.max(F.struct("_age", *(c for c in self.schema.names if c not in self.keys))).alias("_row")
        rows = reduce(DataFrame.unionAll, frames).groupBy(*self.keys).agg(newest)
        return rows.select(*(F.col(c) if c in self.keys else F.col(f"_row.`{c}`").alias(c) for c in self.schema.names))

    def write(self, frame: DataFrame, epoch: int) -> None:
        """For ``foreachBatch``. An epoch that is committed already is left as it is."""
        spark, last = frame.sparkSession, self.log.last(frame.sparkSession)
        if last is not None and epoch <= last["epoch"]:
            return
        writes = 0 if last is None else last["writes"] + 1
        base, slots = (None, []) if last is None else (last["base"], list(last["slots"]))
        slot = writes % (2 * self.every)
        frame.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/epochs/{slot}")
        slots.append(slot)
        if len(slots) >= self.every:
            fresh = 0 if base is None else 1 - base
            self._merged(spark, base, slots).write.mode("overwrite").parquet(f"{self.path}/table/{fresh}")
            base, slots = fresh, []
        self.log.commit(spark, epoch, writes, base, slots)

    def read(self, spark: SparkSession) -> DataFrame:
        last = self.log.last(spark)
        return self._merged(spark, None, []) if last is None else self._merged(spark, last["base"], last["slots"])


def upsert_stream(
    changes: DataFrame, path: str, checkpoint: str, keys: list[str], compact_every: int = 20, trigger: dict | None = None
) -> StreamingQuery:
    """Writes an aggregated stream's changed rows to an ``UpsertTable``; see ``read_upserts``."""
    return (
        changes.writeStream.outputMode("update")
        .foreachBatch(UpsertTable(path, changes.schema, keys, compact_every).write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_upserts(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    return UpsertTable(path, schema, keys).read(spark)


def outcome_stream(
    samples: DataFrame,
    path: str,
    checkpoint: str,
    config: batch.PrepareConfig = batch.PrepareConfig(),
    trigger: dict | None = None,
    on_written: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Prepared samples and rejected ones from one pass over a stream, committed together.

    A sample is judged once and written once, to ``path/rows/epoch=N/outcome=accepted`` or
    ``rejected``. Neither side of an epoch is read before both are whole: ``read_outcome`` looks at
    committed epochs only. ``on_written`` is called between data and commit.
    """
    log = EpochLog(f"{path}/log")
    judged = batch.prepare_judged(samples, config)

    def write(frame: DataFrame, epoch: int) -> None:
        spark, last = frame.sparkSession, log.last(frame.sparkSession)
        if last is not None and epoch <= last["epoch"]:
            return
        side = F.when(F.col("reject_reason").isNull(), ACCEPTED).otherwise(REJECTED)
        rows = frame.withColumn("outcome", side)
        rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/rows/epoch={epoch}")
        if on_written is not None:
            on_written(epoch)
        log.commit(spark, epoch, 0 if last is None else last["writes"] + 1)

    return (
        judged.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_outcome(spark: SparkSession, path: str, schema: T.StructType, outcome: str) -> DataFrame:
    """``accepted`` or ``rejected`` rows of all committed epochs, with their ``epoch``.

    ``schema`` is that of ``plans.prepare.prepare_judged``. Other epochs and the other side are not opened.
    """
    if outcome not in (ACCEPTED, REJECTED):
        raise ValueError(f"outcome must be {ACCEPTED} or {REJECTED}")
    whole = T.StructType([*schema.fields, T.StructField("epoch", T.LongType()), T.StructField("outcome", T.StringType())])
    last = EpochLog(f"{path}/log").last(spark)
    if last is None:
        return spark.createDataFrame([], whole).drop("outcome")
    rows = spark.read.schema(whole).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.where((F.col("outcome") == outcome) & (F.col("epoch") <= last["epoch"])).drop("outcome")
