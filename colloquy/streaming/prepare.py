"""The same preparation over samples that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy import fixed
from colloquy.functions.tokens import pieces
from colloquy.operators.batching import assign_batches, pad_to_longest
from colloquy.operators.encoding import encode
from colloquy.operators.quality import quarantine, reject_summary
from colloquy.plans import prepare as batch
from colloquy.streaming.mixer import ALL, StreamMixer


def prepare_stream(samples: DataFrame, config: batch.PrepareConfig = batch.PrepareConfig()) -> DataFrame:
    """Stateless, append mode: row for row what ``plans.prepare.prepare`` gives on a table."""
    return batch.prepare(samples, config)


def reject_stream(samples: DataFrame, variant: str = "current", source: str = "source_id") -> DataFrame:
    """Running reject counts for ``update`` or ``complete`` mode; state is one row per source and reason."""
    return reject_summary(quarantine(samples, variant), source=source)


def _padded(placed: DataFrame, batch_size: int, config: batch.PrepareConfig) -> DataFrame:
    batched = assign_batches(placed.drop(ALL), batch_size)
    return pad_to_longest(batched, length=batch.expanded_length(config), ready=batch.expand_ids(config)).drop("n_visual")


def _mixer(checkpoint: str, *args) -> StreamMixer:
    return StreamMixer(f"{checkpoint}/mixer", *args)


def batch_stream(
    samples: DataFrame,
    vocab: DataFrame,
    path: str,
    checkpoint: str,
    batch_size: int,
    config: batch.PrepareConfig = batch.PrepareConfig(),
    seed: int = fixed.DEFAULT_SEED,
    trigger: dict | None = None,
    on_epoch: Callable[[DataFrame, int], None] | None = None,
    weights: dict | None = None,
    buffer: int | dict = fixed.DEFAULT_SHUFFLE_BUFFER,
) -> StreamingQuery:
    """Writes the batches that a micro-batch completes to ``path/epoch=N``.

    Buffers, draws and positions go on from one micro-batch to the next, see
    ``StreamMixer``: ``pos`` and ``batch_id`` count through the whole stream, a batch lies in one epoch,
    and any cut of the same rows gives the same order. Call ``finish_batches`` when
    the stream has ended for the rows that are then still in hand. An epoch that is
    tried again overwrites its own folder and state. ``weights`` and ``buffer`` (by source) come from the
    sources' specs, see ``schema.stream_mixture``. ``id`` orders the arrivals of a
    micro-batch. The vocabulary is looked up when the stream starts.
    """
    mixer = _mixer(checkpoint, batch_size, weights, buffer, seed)

    def write(frame: DataFrame, epoch: int) -> None:
        placed, commit = mixer.step(frame, epoch)
        ready = _padded(placed, batch_size, config)
        if on_epoch is not None:
            on_epoch(ready, epoch)
        ready.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        commit()

    whole = batch.render_prompts(samples, config).withColumn("n_visual", batch.visual_tokens(config))
    prepared = whole.select(
        "source_id", "id", F.col("image.ref").alias("ref"), "n_visual", pieces("prompt", config.style).alias("pieces")
    )
    return (
        encode(prepared, vocab)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def finish_batches(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    batch_size: int,
    config: batch.PrepareConfig = batch.PrepareConfig(),
    seed: int = fixed.DEFAULT_SEED,
    weights: dict | None = None,
    buffer: int | dict = fixed.DEFAULT_SHUFFLE_BUFFER,
    stop: str = fixed.DEFAULT_STOP,
) -> int | None:
    """Empties the buffers of a stream that has ended into one more epoch, whose number it returns.

    With ``stop='all_exhausted'`` sources that ended early are repeated until the
    last one has ended, with their rows read from what the stream has written.
    Writing the epoch again gives the same rows.
    """
    mixer = _mixer(checkpoint, batch_size, weights, buffer, seed)
    epoch = mixer.last_epoch(spark) + 1
    if not epoch:
        return None
    written = spark.read.option("basePath", path).parquet(f"{path}/epoch=*").where(F.col("epoch") < epoch)
    # Ids that have been expanded and cut once stay as they are: a placeholder of one token, nothing behind the cut.
    again = written.where(F.col("pass") == 0).drop("n_visual").withColumns(
        {"n_visual": F.lit(1).cast("bigint"), "input_ids": F.slice("input_ids", F.lit(1), F.col("length"))}
    )
    placed = mixer.finish(spark, again, stop)
    if placed is None:
        return None
    _padded(placed, batch_size, config).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return epoch
