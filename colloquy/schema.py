"""Row shapes and the description of one configured source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

from colloquy import fixed

TURN = T.StructType(
    [T.StructField("src", T.StringType()), T.StructField("value", T.StringType())]
)
IMAGE = T.StructType(
    [
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)
SAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("image", IMAGE),
        T.StructField("conversations", T.ArrayType(TURN)),
    ]
)
PART = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]
)
TOOL_CALL = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]
)
MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.ArrayType(PART))]
)


@dataclass(frozen=True)
class SourceSpec:
    """One entry of a training mixture.

    ``streaming=None`` takes the mixture-wide flag. ``split_column`` names the
    (partition) column that holds the split; ``None`` says the path holds one
    split only. ``row_key`` adds a column of that name with the file and row
    number of each Parquet row: a unique, repeatable key for sources whose own
    ids are missing or repeated.
    """

    path: str
    split: str = "train"
    weight: float = 1.0
    streaming: bool | None = None
    shuffle_buffer_size: int = fixed.DEFAULT_SHUFFLE_BUFFER
    format: str = "parquet"
    schema: T.StructType | None = None
    split_column: str | None = "split"
    source_id: int | str | None = None
    row_key: str | None = None
    options: dict[str, str] = field(default_factory=dict)


def check_specs(specs: Sequence[SourceSpec], streaming: bool = False) -> list[SourceSpec]:
    """Refuse mixtures that could never be read or never finish."""
    specs = list(specs)
    if not specs:
        raise ValueError("a mixture needs at least one source")
    modes = {streaming if s.streaming is None else s.streaming for s in specs}
    if len(modes) > 1:
        raise ValueError("a mixture is either all batch or all streaming")
    ids = [i if s.source_id is None else s.source_id for i, s in enumerate(specs)]
    if len(set(ids)) != len(ids):
        raise ValueError("source_id must differ between sources")
    shares({i: s.weight for i, s in zip(ids, specs)})
    return specs


def stream_mixture(specs: Sequence[SourceSpec]) -> tuple[dict, dict]:
    """Weights and shuffle buffers by ``source_id``, as ``streaming.prepare.batch_stream`` takes them."""
    ids = [i if s.source_id is None else s.source_id for i, s in enumerate(check_specs(specs, True))]
    return {i: s.weight for i, s in zip(ids, specs)}, {i: s.shuffle_buffer_size for i, s in zip(ids, specs)}


def shares(weights: dict) -> dict:
    """``w / sum(w)`` per source, for weights that describe a distribution."""
    values = {k: float(w) for k, w in weights.items()}
    bad = {k: w for k, w in values.items() if not w >= 0 or w == float("inf")}
    total = sum(values.values())
    if bad or not total > 0:
        raise ValueError(f"weights must be finite, not negative, and not all zero: {weights}")
    return {k: w / total for k, w in values.items()}
