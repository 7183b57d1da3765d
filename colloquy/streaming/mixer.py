"""Shuffle buffers, draws and batches that go on from one micro-batch of a stream to the next.

Rows in hand (in a buffer, or out of it and waiting for their slot) and the counts of
each source are the state. It is written for every epoch, in one of two folders by turns,
so an epoch that is tried again finds the state before it untouched. What is emitted does not depend on
how the stream is cut into micro-batches: a row's number in its source decides when it leaves the buffer,
the rows that have left are numbered without gaps, and the draw of a slot depends on the slot alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import fixed
from colloquy.operators.mixing import output_length, turns
from colloquy.operators.ordering import _per_source, arrival_numbers, drain_buffer, leave_buffer
from colloquy.operators.skew import pin, salted_left_join
from colloquy.schema import shares

#: The source column of a mix without weights: all rows are one source.
ALL = "_mix"


class StreamMixer:
    """One stream's order. ``path`` is a folder that driver and executors share.

    Without ``weights`` all rows pass through one buffer. With them every source has its own and gives
    the next slot that draws it; a source that has no row ready holds all others up, as slots are in order.
    Rows that wait for slots stay in the state, so weights should go with the rates of arrival.
    """

    def __init__(
        self, path: str, batch_size: int, weights: dict | None = None, buffer: int | dict = fixed.DEFAULT_SHUFFLE_BUFFER,
        seed: int = fixed.DEFAULT_SEED, key: str = "id", source: str = "source_id",
    ):
        self.path, self.batch_size, self.seed, self.key, self.given = path, batch_size, seed, key, source
        self.weights, self.source = ({0: 1.0}, ALL) if weights is None else (weights, source)
        self.buffer = fixed.DEFAULT_SHUFFLE_BUFFER if weights is None and isinstance(buffer, dict) else buffer
        shares(self.weights)

    def _room(self, source) -> int:
        return self.buffer.get(source, fixed.DEFAULT_SHUFFLE_BUFFER) if isinstance(self.buffer, dict) else self.buffer

    def _folder(self, epoch: int, name: str) -> str:
        return f"{self.path}/{epoch % 2}/{name}"

    def _tagged(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn(ALL, F.lit(0)) if self.source == ALL else frame

    def _state(self, spark: SparkSession, epoch: int, schema: T.StructType | None) -> tuple[DataFrame, dict, dict]:
        """Rows in hand and, by source, how many have arrived and how many have been emitted."""
        if epoch < 0:
            empty = T.StructType([*schema.fields, T.StructField("_at", T.LongType()), T.StructField("_rank", T.LongType())])
            return spark.createDataFrame([], empty), {}, {}
        counts = spark.read.parquet(self._folder(epoch, "counts")).collect()  # one row for each source and a marker
        if {r["epoch"] for r in counts} != {epoch}:
            raise ValueError(f"no state of epoch {epoch} in {self.path}")
        own = [r for r in counts if r["source"] is not None]
        held = spark.read.parquet(self._folder(epoch, "held"))
        return held, {r["source"]: r["arrived"] for r in own}, {r["source"]: r["taken"] for r in own}

    def last_epoch(self, spark: SparkSession) -> int:
        found = []
        for epoch in (0, 1):
            try:
                found += [r["epoch"] for r in spark.read.parquet(self._folder(epoch, "counts")).limit(1).collect()]
            except Exception as missing:  # the stream may have written one state only, or none
                if "PATH_NOT_FOUND" not in str(missing):
                    raise
        return max(found, default=-1)

    def _ready(self, spark: SparkSession, ready: dict, start: int) -> int:
        """Slots after ``start`` until a source has used what it has ready; a multiple of the batch in all."""
        live = {k: w for k, w in self.weights.items() if w > 0}
        if any(ready.get(k, 0) <= 0 for k in live):
            return 0
        lengths = {k: ready[k] for k in live}
        n = output_length(spark, lengths, live, self.seed, "first_exhausted", self.source, start=start)
        return (start + n) // self.batch_size * self.batch_size - start

    def step(self, frame: DataFrame, epoch: int) -> tuple[DataFrame, Callable[[], None]]:
        """The rows whose batches are complete, with ``pos`` and ``pass``, and what writes the new state.

        Call the latter when the rows are written. Rows arrive in the order of their keys.
        """
        spark, frame, source = frame.sparkSession, self._tagged(frame), self.source
        held, arrived, taken = self._state(spark, epoch - 1, frame.schema)
        fresh = pin(frame.withColumn("_uid", F.monotonically_increasing_id()))
        narrow = fresh.select(*dict.fromkeys([source, self.given, self.key]), "_uid")
        numbers = pin(arrival_numbers(narrow, [self.key, self.given, "_uid"], source, "_at").select(source, "_uid", "_at"))
        came = {r[source]: r["count"] for r in numbers.groupBy(source).count().limit(len(self.weights) + 1).collect()}
        if not set(came) <= set(self.weights):
            raise ValueError(f"sources without weight: {set(came) - set(self.weights)}")
        before = _per_source(arrived, source)
        if before is not None:
            numbers = numbers.withColumn("_at", F.col("_at") + F.coalesce(before, F.lit(0)))
        arrived = {k: arrived.get(k, 0) + came.get(k, 0) for k in {*arrived, *came}}

        inside = held.where(F.col("_rank").isNull()).select(source, "_at").unionByName(numbers.select(source, "_at"))
        moved = leave_buffer(inside, self.buffer, self.seed, source, "_at", "_rank")
        ranks = moved.unionByName(held.where(F.col("_rank").isNotNull()).select(source, "_at", "_rank"))
        start = sum(taken.values())
        ready = {k: max(0, n - self._room(k)) - taken.get(k, 0) for k, n in arrived.items()}
        n = self._ready(spark, ready, start)
        if n:
            drawn = turns(spark, n, shares(self.weights), self.seed, source, start=start)
            first = _per_source(taken, source)
            rank = F.col("turn") if first is None else F.col("turn") + F.coalesce(first, F.lit(0))
            slots = drawn.select(source, rank.alias("_rank"), F.col("slot").alias("pos"))
            # Slots are exploded from a few blocks, so Spark takes them for small; there is one for each row.
            plan = ranks.join(slots.hint("merge"), [source, "_rank"], "left")
        else:
            plan = ranks.withColumn("pos", F.lit(None).cast("bigint"))
        rows = held.drop("_rank").unionByName(fresh.join(numbers, [source, "_uid"]).drop("_uid"))
        placed = pin(rows.join(plan, [source, "_at"]))
        out = placed.where(F.col("pos").isNotNull())
        used = {r[source]: r["count"] for r in out.groupBy(source).count().collect()}
        taken = {k: taken.get(k, 0) + used.get(k, 0) for k in arrived}

        def commit() -> None:
            placed.where(F.col("pos").isNull()).drop("pos").write.mode("overwrite").parquet(self._folder(epoch, "held"))
            kind = frame.schema[source].dataType
            schema = T.StructType(
                [T.StructField("epoch", T.LongType()), T.StructField("source", kind)]
                + [T.StructField(c, T.LongType()) for c in ("arrived", "taken")]
            )
            counts = [(epoch, None, 0, 0), *((epoch, k, v, taken[k]) for k, v in arrived.items())]
            spark.createDataFrame(counts, schema).coalesce(1).write.mode("overwrite").parquet(self._folder(epoch, "counts"))

        return out.withColumn("pass", F.lit(0).cast("bigint")).drop("_at"), commit

    def finish(self, spark: SparkSession, used: DataFrame | None, stop: str = fixed.DEFAULT_STOP) -> DataFrame | None:
        """The rest of the order, when no more rows arrive: the buffers are emptied and the stopping rule holds.

        ``used`` are the rows emitted so far, in the columns of the state with their ``_rank``; sources that are repeated take
        them from there. All of the stream is then in the order that one micro-batch would have given.
        """
        held, arrived, taken = self._state(spark, self.last_epoch(spark), None)
        source, weights = self.source, {k: w for k, w in self.weights.items() if k in arrived}
        if not weights:
            return None
        inside = held.where(F.col("_rank").isNull()).select(source, self.key, "_at")
        drained = drain_buffer(inside, self.key, self.buffer, self.seed, source, "_at", "_rank")
        left = held.where(F.col("_rank").isNull()).drop("_rank").join(drained.select(source, "_at", "_rank"), [source, "_at"])
        rows = [held.where(F.col("_rank").isNotNull()), left.select(held.columns)]
        rows += [] if used is None else [self._tagged(used).withColumn("_at", F.lit(None).cast("bigint")).select(held.columns)]
        total, start = output_length(spark, arrived, weights, self.seed, stop, source), sum(taken.values())
        if total == start:
            return None
        length = _per_source(arrived, source)
        drawn = turns(spark, total - start, shares(weights), self.seed, source, start=start)
        turn = F.col("turn") + _per_source({k: taken.get(k, 0) for k in arrived}, source)
        picks = drawn.withColumn("_turn", turn).select(
            F.col("slot").alias("pos"), source, F.floor(F.col("_turn") / length).cast("bigint").alias("pass"),
            F.pmod("_turn", length).cast("bigint").alias("_rank"),
        )
        every = pin(reduce(lambda a, b: a.unionByName(b), rows))
        return salted_left_join(picks, every, [source, "_rank"], "pos", how="inner", strategy="merge").drop("_at")
