"""Image files: header probe, sizes, and the late join of their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.images import image_format, image_size
from colloquy.functions.integrity import image_fault
from colloquy.operators.skew import HOT_ROWS, salted_left_join


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(ref, content)`` of a folder of image files."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select(F.col("path").alias("ref"), "content")


def image_dimensions(images: DataFrame, content: str = "content", jpeg: bool = True) -> DataFrame:
    """Adds ``format``, ``width`` and ``height`` as read from the header."""
    return images.withColumns(
        {"format": image_format(content), "_size": image_size(content, jpeg)}
    ).select(
        *images.columns, "format", F.col("_size.width").alias("width"), F.col("_size.height").alias("height")
    )


def image_decodable(images: DataFrame, content: str = "content", jpeg: bool = True) -> DataFrame:
    """Adds ``decodable``: known magic bytes and a size above zero.

    A header probe, so weaker than decoding: it does not see damaged pixel data.
    """
    sized = image_dimensions(images, content, jpeg)
    known = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    return sized.withColumn("decodable", known)


def image_whole(images: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``decodable``: a known size in the header and a container that is whole to its end.

    Stronger than ``image_decodable``: files that are cut off, and PNG files with any changed bit, fail.
    """
    known = image_decodable(images, content)
    return known.withColumn("decodable", F.col("decodable") & image_fault(content).isNull()).select(*images.columns, "decodable")


def attach_image_bytes(
    plan: DataFrame, images: DataFrame, ref: str = "ref", spread: str = "pos", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join of the bytes, as the last step before writing.

    ``images`` is unique on ``ref``. One image may serve a large part of the
    plan (a placeholder picture), so hot refs are salted.
    """
    return salted_left_join(plan, images.select(ref, "content"), ref, spread, hot_rows)
