"""Pieces of a prompt and arithmetic on token arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import fixed
from colloquy.functions.text import column


def piece_pattern(style: str = "image_first") -> str:
    """Special tokens whole, runs of letters, single digits, blank runs, single other characters.

    The alternatives cover every character, so the pieces of a prompt joined
    again are the prompt. The frequent kinds come first; a special token starts
    with none of them.
    """
    special = "|".join(re.escape(token) for _, token, _ in fixed.SPECIAL_TOKENS[style])
    return "|".join([r"\p{L}+", fixed.WHITESPACE_CLASS + "+", r"\p{N}", special, "(?s:.)"])


def pieces(prompt: Column | str, style: str = "image_first") -> Column:
    return F.regexp_extract_all(column(prompt), F.lit(piece_pattern(style)), F.lit(0))


def expand_image_tokens(
    ids: Column | str, n_visual: Column | str | int, image_id: int = fixed.IMAGE_ID
) -> Column:
    """Each image placeholder becomes ``n_visual`` copies of itself.

    Around a single one, which is the usual case, arrays are copied whole.
    """
    n = F.lit(n_visual) if isinstance(n_visual, int) else column(n_visual)
    c = column(ids)
    spread = F.flatten(
        F.transform(
            c,
            lambda x: F.when(x == image_id, F.array_repeat(x, n.cast("int"))).otherwise(F.array(x)),
        )
    )
    place = F.array_position(c, image_id).cast("int")
    around = F.concat(
        F.slice(c, F.lit(1), F.greatest(place - 1, F.lit(0))), F.array_repeat(F.lit(image_id), n.cast("int")), F.slice(c, place + 1, F.size(c))
    )
    return F.when(place == 0, c).when(count_of(c, image_id) == 1, around).otherwise(spread)


def count_of(ids: Column | str, value: int) -> Column:
    """How many elements of ``ids`` are ``value``."""
    c = column(ids)
    return F.size(c) - F.size(F.array_remove(c, value))


def truncate(ids: Column | str, max_length: int = fixed.DEFAULT_MAX_LENGTH) -> Column:
    return F.slice(column(ids), 1, max_length)


def attention_mask(length: Column | str, width: Column | str) -> Column:
    n, w = column(length).cast("int"), column(width).cast("int")
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), w - n))


def pad(ids: Column | str, width: Column | str, pad_id: int = fixed.PAD_ID) -> Column:
    c = column(ids)
    return F.concat(c, F.array_repeat(F.lit(pad_id), column(width).cast("int") - F.size(c)))


def labels(ids: Column | str, mask: Column | str) -> Column:
    """Ids where the mask is set. It is the mask that decides, not the pad id."""
    return F.zip_with(
        column(ids), column(mask), lambda i, m: F.when(m == 0, fixed.IGNORE_LABEL).otherwise(i)
    )
