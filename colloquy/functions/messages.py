"""Turn arrays -> message arrays, plus the predicates on them.

``conversations`` is ``ARRAY<STRUCT<src, value>>``; a message is
``STRUCT<role, content: ARRAY<STRUCT<type, text>>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import fixed
from colloquy.functions.text import (
    bind,
    clean_text,
    column,
    default_user_text,
    is_assistant,
    is_user,
    role_strict,
)
from colloquy.schema import PART, TURN

USER_FALLBACK = {"current": "", "strict": fixed.STRICT_USER_TEXT}


def has_turns(conv: Column | str) -> Column:
    return F.coalesce(F.size(column(conv)), F.lit(0)) > 0


def has_image(image: Column | str) -> Column:
    return column(image).isNotNull()


def has_user_turn(conv: Column | str) -> Column:
    return F.coalesce(F.exists(column(conv), lambda t: is_user(t["src"])), F.lit(False))


def has_assistant_text(conv: Column | str) -> Column:
    """Some assistant turn still has text after cleaning (stops at the first one)."""
    return F.coalesce(
        F.exists(column(conv), lambda t: is_assistant(t["src"]) & (clean_text(t["value"]) != "")),
        F.lit(False),
    )


def has_null_turn(conv: Column | str) -> Column:
    """Some turn lacks its speaker or its text, which the transcript form cannot express."""
    return F.coalesce(
        F.exists(column(conv), lambda t: t["src"].isNull() | t["value"].isNull()), F.lit(False)
    )


def drop_turns(conv: Column | str) -> Column:
    """Drop turns without a known role and blank assistant turns; blank user turns stay."""
    return F.filter(
        column(conv),
        lambda t: is_user(t["src"]) | (is_assistant(t["src"]) & (clean_text(t["value"]) != "")),
    )


def _cleaned(conv: Column, keep_system: bool) -> Column:
    """Kept turns as ``(role, text)``, every text cleaned exactly once."""
    turns = F.transform(
        conv,
        lambda t: F.struct(
            role_strict(t["src"], keep_system).alias("role"), clean_text(t["value"]).alias("text")
        ),
    )
    return F.filter(
        turns, lambda t: t["role"].isNotNull() & ((t["role"] != "assistant") | (t["text"] != ""))
    )


def image_slot(conv: Column | str, image: Column | str) -> Column:
    """0-based turn that carries the image: the first user turn, NULL without image or user turn."""
    found = F.array_position(F.transform(column(conv), lambda t: is_user(t["src"])), F.lit(True))
    return F.when(has_image(image) & (found > 0), found - 1)


def build_messages(
    conv: Column | str,
    image: Column | str | None = None,
    mode: str = "current",
    keep_system: bool = False,
) -> Column:
    """Messages of a conversation.

    ``image`` is the image column (its NULLness decides on the slot). The slot
    goes in front of the text of the first user turn only.
    """
    fallback = USER_FALLBACK[mode]
    with_image = F.lit(False) if image is None else has_image(image)

    def text_part(t: Column) -> Column:
        text = F.when(t["role"] == "user", default_user_text(t["text"], fallback)).otherwise(t["text"])
        return F.struct(F.lit("text").alias("type"), text.alias("text")).cast(PART)

    image_part = F.struct(
        F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")
    ).cast(PART)

    def messages(ctx: Column) -> Column:
        return F.transform(
            ctx["turns"],
            lambda t, i: F.struct(
                t["role"].alias("role"),
                F.when(i + 1 == ctx["slot"], F.array(image_part, text_part(t)))
                .otherwise(F.array(text_part(t)))
                .alias("content"),
            ),
        )

    turns = _cleaned(F.coalesce(column(conv), F.array().cast(T.ArrayType(TURN))), keep_system)
    context = bind(
        turns,
        lambda ts: F.struct(
            ts.alias("turns"),
            F.when(with_image, F.array_position(F.transform(ts, lambda t: t["role"] == "user"), F.lit(True)))
            .otherwise(F.lit(0))
            .alias("slot"),
        ),
    )
    return bind(context, messages)


def assistant_text(messages: Column | str) -> Column:
    """Texts of the assistant messages, in order."""
    spoken = F.filter(column(messages), lambda m: m["role"] == "assistant")
    return F.flatten(F.transform(spoken, lambda m: part_texts(m["content"])))


def part_texts(content: Column) -> Column:
    """Texts of the text parts of one message."""
    return F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
