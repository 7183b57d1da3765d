"""Roll-ups of a training log ``(run, epoch, step, batch_size, loss)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epoch_metric(metrics: DataFrame) -> DataFrame:
    """Epoch loss: mean of step losses weighted by batch size. Steps without a loss have no weight."""
    weight = F.when(F.col("loss").isNotNull(), F.col("batch_size"))
    return metrics.groupBy("run", "epoch").agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum("batch_size").alias("samples"),
        (F.sum(F.col("loss") * F.col("batch_size")) / F.sum(weight)).alias("loss"),
    )


def step_metric(metrics: DataFrame, accumulate: int) -> DataFrame:
    """Loss per optimizer step: mean over its accumulated micro-batches."""
    step = F.floor(F.col("step") / F.lit(accumulate)).cast("bigint")
    return metrics.groupBy("run", step.alias("optimizer_step")).agg(
        F.count(F.lit(1)).alias("micro_batches"), F.avg("loss").alias("loss")
    )


def thin_log(metrics: DataFrame, every_n: int) -> DataFrame:
    """Keep every n-th step."""
    return metrics.where(F.pmod(F.col("step") + 1, F.lit(every_n)) == 0)
