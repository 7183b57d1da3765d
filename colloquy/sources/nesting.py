"""Long turn rows <-> nested samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_conversations(
    turns: DataFrame,
    key: str = "conv_id",
    position: str = "turn",
    fields: tuple[str, str] = ("src", "value"),
    carry: dict | None = None,
) -> DataFrame:
    """One row per conversation with its turns in order.

    ``carry`` adds conversation-level columns: ``{name: aggregate Column}``.
    Turns are collected map-side first, so a conversation crosses the shuffle
    as a few partial lists, and one hash exchange on ``key`` is the only one;
    later per-conversation steps keyed by ``key`` reuse that partitioning.
    Turns without a key belong to no conversation and are left out, so that they do not
    all meet in one row; ``keyless_turns`` gives them.
    """
    src, value = fields
    turn = F.struct(
        F.col(position).alias("turn"), F.col(src).alias("src"), F.col(value).alias("value")
    )
    ordered = F.sort_array(F.collect_list(turn))
    conversations = F.transform(
        ordered, lambda t: F.struct(t["src"].alias("src"), t["value"].alias("value"))
    )
    extra = [agg.alias(name) for name, agg in (carry or {}).items()]
    keyed = turns.where(F.col(key).isNotNull())
    return keyed.groupBy(key).agg(*extra, conversations.alias("conversations"))


def keyless_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns that name no conversation, with ``reject_reason``; row-local, for the quarantine."""
    return turns.where(F.col(key).isNull()).withColumn("reject_reason", F.lit("null_key"))


def explode_turns(samples: DataFrame, conversations: str = "conversations", keep=("conv_id",)) -> DataFrame:
    """One row per turn; a sample without turns keeps one row with NULLs."""
    return samples.select(*keep, F.posexplode_outer(conversations).alias("turn", "_turn")).select(
        *keep, "turn", F.col("_turn.src").alias("src"), F.col("_turn.value").alias("value")
    )
