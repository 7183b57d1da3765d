"""End-to-end compositions of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import fixed
from colloquy.functions import tokens, vision
from colloquy.functions.messages import build_messages
from colloquy.functions.templates import (
    placeholder_count,
    render_chat_image_first,
    render_chat_interleaved,
    render_transcript,
)
from colloquy.operators.batching import assign_batches, pad_to_longest
from colloquy.operators.encoding import encode
from colloquy.operators.mixing import interleave
from colloquy.operators.ordering import seeded_shuffle
from colloquy.operators.quality import VARIANTS, reject_reason
from colloquy.operators.skew import pin, salted_left_join
from colloquy.sources.write import shard_of


@dataclass(frozen=True)
class PrepareConfig:
    variant: str = "current"
    style: str = "image_first"
    max_length: int = fixed.DEFAULT_MAX_LENGTH
    max_tiles: int = 1

    def __post_init__(self):
        if self.variant not in VARIANTS:
            raise ValueError(f"variant must be one of {VARIANTS}")
        if self.style not in fixed.SPECIAL_TOKENS:
            raise ValueError(f"style must be one of {tuple(fixed.SPECIAL_TOKENS)}")


def prompt_column(config: PrepareConfig, conv: str = "conversations", image: str = "image") -> Column:
    if config.variant == "legacy":
        return render_transcript(conv)
    messages = build_messages(conv, image, config.variant)
    render = render_chat_image_first if config.style == "image_first" else render_chat_interleaved
    return render(messages)


def slot_token(config: PrepareConfig) -> str:
    return fixed.IMAGE_SLOT if config.style == "image_first" else "<|image_pad|>"


def visual_tokens(config: PrepareConfig, image: str = "image") -> Column:
    w, h = F.col(f"{image}.width"), F.col(f"{image}.height")
    if config.style == "image_first":
        count = vision.visual_tokens_anyres(w, h, config.max_tiles)
    else:
        count = vision.visual_tokens_dynamic(w, h)
    # Of an image of unknown size one style shows the base tokens, the other its one placeholder.
    unknown = fixed.BASE_VISUAL_TOKENS if config.style == "image_first" else 1
    return F.when(F.col(image).isNotNull(), F.coalesce(count, F.lit(unknown).cast("bigint")))


def accept(samples: DataFrame, config: PrepareConfig = PrepareConfig()) -> DataFrame:
    """Samples without a reject reason. The test stops at the first turn that decides."""
    return samples.where(reject_reason(config.variant, slot=slot_token(config)).isNull())


def render_prompts(samples: DataFrame, config: PrepareConfig = PrepareConfig()) -> DataFrame:
    """Accepted samples with ``has_image``, ``prompt`` and ``n_slots``; row-local, no exchange."""
    return (
        accept(samples, config)
        .withColumns({"has_image": F.col("image").isNotNull(), "prompt": prompt_column(config)})
        .withColumn("n_slots", placeholder_count("prompt", slot_token(config)))
    )


def prepare(samples: DataFrame, config: PrepareConfig = PrepareConfig(), expand: bool = True) -> DataFrame:
    """Prompts plus pieces (tail cut) and token counts.

    Row-local throughout, so the same function serves tables and streams.
    ``n_tokens`` counts everything before the cut. With ``expand`` each image
    placeholder among the pieces is repeated; without, that is left to
    ``expand_ids`` after encoding, where repeating numbers costs less. Cutting
    first loses nothing, as expansion only moves pieces further back.
    """
    return _with_pieces(render_prompts(samples, config), config, expand)


def prepare_judged(samples: DataFrame, config: PrepareConfig = PrepareConfig()) -> DataFrame:
    """``prepare`` in one pass over all samples: rejected ones stay, with ``reject_reason`` and without a prompt."""
    accepted = F.col("reject_reason").isNull()
    judged = samples.withColumn("reject_reason", reject_reason(config.variant, slot=slot_token(config)))
    rendered = judged.withColumns(
        {"has_image": F.col("image").isNotNull(), "prompt": F.when(accepted, prompt_column(config))}
    ).withColumn("n_slots", F.when(accepted, placeholder_count("prompt", slot_token(config))))
    named = ("n_visual", "pieces", "n_tokens")
    full = _with_pieces(rendered, config)
    return full.withColumns({c: F.when(accepted, F.col(c)) for c in named})


def _with_pieces(rendered: DataFrame, config: PrepareConfig, expand: bool = True) -> DataFrame:
    visual = F.coalesce("n_visual", F.lit(1))
    full = (
        rendered.withColumn("n_visual", visual_tokens(config))
        .withColumn("pieces", tokens.pieces("prompt", config.style))
        .withColumn("n_tokens", F.size("pieces") + F.col("n_slots") * (visual - 1))
        .withColumn("pieces", tokens.truncate("pieces", config.max_length))
    )
    if not expand:
        return full
    spread = tokens.expand_image_tokens("pieces", visual, slot_token(config))
    return full.withColumn("pieces", tokens.truncate(spread, config.max_length))


def _image_id(config: PrepareConfig) -> int:
    return next(i for i, t, _ in fixed.SPECIAL_TOKENS[config.style] if t == slot_token(config))


def expand_ids(config: PrepareConfig, ids: str = "input_ids") -> Column:
    """Encoded prompt with its image placeholders repeated ``n_visual`` times and its tail cut."""
    spread = tokens.expand_image_tokens(ids, F.coalesce("n_visual", F.lit(1)), _image_id(config))
    return tokens.truncate(spread, config.max_length)


def expanded_length(config: PrepareConfig, ids: str = "input_ids") -> Column:
    """How many ids ``expand_ids`` will give, without expanding them."""
    slots = tokens.count_of(ids, _image_id(config))
    return F.least(F.size(ids) + slots * (F.coalesce("n_visual", F.lit(1)) - 1), F.lit(config.max_length))


def attach(plan: DataFrame, payload: DataFrame, key: list[str], spread: str = "pos") -> DataFrame:
    """Join payload (unique on ``key``) to a finished plan of positions.

    Over-sampled sources repeat their rows, so hot keys are salted.
    """
    return salted_left_join(plan, payload, key, spread, how="inner")


def keyed(samples: DataFrame, out: str = "row_key") -> DataFrame:
    """``samples`` with a unique key, for sources whose own ids are missing or repeated.

    The numbered samples are pinned, so the key stays with its row. Parquet
    sources get a key without that from ``SourceSpec.row_key``.
    """
    return pin(samples.withColumn(out, F.monotonically_increasing_id()))


def _checked_keys(samples: DataFrame, source: str, key: str) -> DataFrame:
    """Pinned ``(source, key)`` rows, refused where a key is missing or repeated."""
    keys = pin(samples.select(source, key))
    repeated = keys.groupBy(source, key).count().where(F.col(key).isNull() | F.col(source).isNull() | (F.col("count") > 1))
    if repeated.limit(1).count():
        raise ValueError(f"{key} is missing or repeated; give the samples a key with keyed() or SourceSpec.row_key")
    return keys


def mixed_order(
    samples: DataFrame,
    weights: dict,
    config: PrepareConfig = PrepareConfig(),
    key: str = "id",
    source: str = "source_id",
    seed: int = fixed.DEFAULT_SEED,
    stop: str = fixed.DEFAULT_STOP,
) -> DataFrame:
    """``(pos, source, pass, key)``, shuffled and interleaved as the variant does it.

    The strict variant validates before it mixes. The others mix all samples and
    drop the invalid ones from the finished batches, which ``training_arrays``
    does; their positions are part of the order here. The samples are read once:
    only keys are kept, and those and the finished order are pinned.
    """
    chosen = accept(samples, config) if config.variant == "strict" else samples
    ranked = seeded_shuffle(_checked_keys(chosen, source, key), key, seed, source)
    return pin(interleave(ranked, weights, seed, stop, source))


def training_arrays(
    samples: DataFrame,
    plan: DataFrame,
    vocab: DataFrame,
    batch_size: int,
    config: PrepareConfig = PrepareConfig(),
    key: tuple[str, ...] = ("source_id", "id"),
    rows_per_shard: int | None = None,
) -> DataFrame:
    """Padded ids, mask, labels and image ref per position, from samples and a mixed order.

    Every accepted sample is encoded once, however often the plan repeats it;
    positions of other samples are left out, and their batches are the shorter for
    it. Ids travel with one placeholder per image and are expanded, cut, padded and
    labelled after the last exchange. With ``rows_per_shard`` (a multiple of
    ``batch_size``) rows are partitioned by output shard before padding. A batch lies
    within one shard, so padding and ``write_training_shards`` then share that exchange.
    """
    whole = render_prompts(samples, config).withColumn("n_visual", visual_tokens(config))
    narrow = whole.select(
        *key, F.col("image.ref").alias("ref"), "n_visual", tokens.pieces("prompt", config.style).alias("pieces")
    )
    compact = encode(narrow, vocab)
    placed = assign_batches(attach(plan, compact, list(key)), batch_size)
    finish = {"length": expanded_length(config), "ready": expand_ids(config)}
    if rows_per_shard is None:
        return pad_to_longest(placed, **finish).drop("n_visual")
    if rows_per_shard % batch_size:
        raise ValueError("rows_per_shard must be a multiple of batch_size")
    sharded = placed.withColumn("shard", shard_of(rows_per_shard)).repartition("shard")
    return pad_to_longest(sharded, by=("shard", "batch_id"), **finish).drop("n_visual")
