"""Which samples are kept, and why the others are not."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import fixed
from colloquy.functions.messages import has_assistant_text, has_null_turn, has_turns, has_user_turn
from colloquy.functions.templates import placeholder_count
from colloquy.functions.text import clean_text, is_assistant, is_user

VARIANTS = ("current", "strict", "legacy")


def legacy_valid(df: DataFrame, conv: str = "conversations", image: str = "image") -> DataFrame:
    """Image and conversation both present; an empty conversation passes."""
    return df.where(F.col(image).isNotNull() & F.col(conv).isNotNull())


def strict_valid(df: DataFrame, conv: str = "conversations", image: str = "image") -> DataFrame:
    return df.where(F.col(image).isNotNull() & has_user_turn(conv) & has_assistant_text(conv))


def current_valid(df: DataFrame, conv: str = "conversations") -> DataFrame:
    return df.where(has_assistant_text(conv))


def filter_samples(df: DataFrame, predicate: Column) -> DataFrame:
    """Any boolean column; a Python rule comes as a Boolean ``pandas_udf`` applied to columns."""
    return df.where(predicate)


def reject_reason(
    variant: str = "current",
    conv: str = "conversations",
    image: str = "image",
    decodable: str | None = None,
    slot: str = fixed.IMAGE_SLOT,
) -> Column:
    """First reason that rejects a sample, NULL for an accepted one.

    ``misaligned`` are samples whose cleaned texts still hold the ``slot`` marker of
    the prompt's style, so that the prompt would show more slots than images.
    """
    with_image = F.col(image).isNotNull()
    reason = F.when(F.col(conv).isNull(), "null_conversation")
    if variant != "legacy":
        reason = reason.when(~has_turns(conv), "no_turns")
    if variant != "current":
        reason = reason.when(~with_image, "no_image")
    if variant == "legacy":
        reason = reason.when(has_null_turn(conv), "null_turn")
    if variant == "strict":
        reason = reason.when(~has_user_turn(conv), "no_user_turn")
    if variant != "legacy":
        reason = reason.when(~has_assistant_text(conv), "no_assistant_text")
    if variant == "current":
        reason = reason.when(with_image & ~has_user_turn(conv), "image_without_slot")
    if decodable is not None:
        reason = reason.when(with_image & ~F.coalesce(F.col(decodable), F.lit(False)), "image_not_decodable")
    if variant != "legacy":
        reason = reason.when(has_stray_slot(conv, slot), "misaligned")
    return reason


def has_stray_slot(conv: str = "conversations", slot: str = fixed.IMAGE_SLOT) -> Column:
    """Whether a turn that a message is built from holds ``slot`` after cleaning.

    A marker that survives cleaning was put together by it or stood there before, so
    only samples that hold one anywhere are looked at turn by turn.
    """
    said = F.array_join(F.col(conv)["value"], "\n")
    suspects = [F.contains(said, F.lit(m)) for m in dict.fromkeys((slot, fixed.IMAGE_SLOT))]

    def stray(t):
        return (is_user(t["src"]) | is_assistant(t["src"])) & F.contains(clean_text(t["value"]), F.lit(slot))

    return F.when(reduce(or_, suspects), F.coalesce(F.exists(conv, stray), F.lit(False))).otherwise(False)


def quarantine(df: DataFrame, variant: str = "current", **columns) -> DataFrame:
    """Adds ``reject_reason``; ``sources.write.write_quarantine`` splits it in one pass."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    return df.withColumn("reject_reason", reject_reason(variant, **columns))


def reject_summary(df: DataFrame, totals: bool = False, source: str = "source_id") -> DataFrame:
    """Rejects per source and reason; ``totals`` adds per-source and grand totals (NULL keys)."""
    rejects = df.where(F.col("reject_reason").isNotNull())
    grouped = rejects.rollup if totals else rejects.groupBy
    return grouped(source, "reject_reason").agg(F.count(F.lit(1)).alias("rejects"))


def check_image_alignment(
    df: DataFrame, prompt: str = "prompt", image: str = "image", token: str = fixed.IMAGE_SLOT
) -> DataFrame:
    """Adds ``n_slots``, ``n_images`` and whether they agree."""
    return df.withColumns(
        {"n_slots": placeholder_count(prompt, token), "n_images": F.col(image).isNotNull().cast("int")}
    ).withColumn("aligned", F.col("n_slots") == F.col("n_images"))
