"""Configured sources -> one DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.schema import SourceSpec, check_specs


def _tag(df: DataFrame, spec: SourceSpec, source_id) -> DataFrame:
    if spec.row_key is not None:
        place = F.concat_ws(":", "_metadata.file_path", "_metadata.row_index")
        df = df.withColumn(spec.row_key, place)
    if spec.split_column is not None:
        if spec.split_column not in df.columns:
            raise ValueError(f"{spec.path} has no column {spec.split_column!r}; split_column=None reads all of it")
        df = df.where(F.col(spec.split_column) == spec.split).drop(spec.split_column)
    return df.withColumns(
        {"source_id": F.lit(source_id), "weight": F.lit(float(spec.weight))}
    )


def read_source(spark: SparkSession, spec: SourceSpec, source_id=0) -> DataFrame:
    """Batch scan of one source. The split filter prunes partitions or reaches the scan."""
    reader = spark.read.format(spec.format).options(**spec.options)
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    own = source_id if spec.source_id is None else spec.source_id
    return _tag(reader.load(spec.path), spec, own)


def read_source_stream(spark: SparkSession, spec: SourceSpec, source_id=0) -> DataFrame:
    """The same scan over files that keep arriving; a stream needs its schema up front."""
    if spec.schema is None:
        raise ValueError("a streaming source needs a schema")
    reader = spark.readStream.format(spec.format).options(**spec.options).schema(spec.schema)
    own = source_id if spec.source_id is None else spec.source_id
    return _tag(reader.load(spec.path), spec, own)


def read_mixture(
    spark: SparkSession, specs: Sequence[SourceSpec], streaming: bool = False
) -> DataFrame:
    """All sources of a mixture in one frame, told apart by ``source_id``."""
    specs = check_specs(specs, streaming)
    lazy = streaming if specs[0].streaming is None else specs[0].streaming
    read = read_source_stream if lazy else read_source
    frames = [read(spark, s, i) for i, s in enumerate(specs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
