"""Lazy sources split by file: which rank and which loader process opens which files.

A source that is read as a stream of rows is not numbered row by row. Its files are
dealt out instead, so a rank never opens a file of another one. Where there are fewer
files than ranks, every rank reads all of them and keeps the rows of its turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.ordering import global_position
from colloquy.schema import SourceSpec
from colloquy.sources.read import read_source

#: Paths that one rank's reader may name; a rank with more reads its files in several readers.
MOST_PATHS = 100_000


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, size)`` of the files below ``path``, in bytes; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("length").alias("size"))


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size)`` in rows of the Parquet files below ``path``, from their footers."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("size"))


def _there_and_back(turn, n: int):
    """0, 1, .. n-1, n-1, .. 1, 0, 0, 1, .. by ``turn``."""
    lap, at = F.floor(turn / F.lit(n)), F.pmod(turn, F.lit(n))
    return F.when(lap % 2 == 0, at).otherwise(F.lit(n - 1) - at).cast("bigint")


def file_plan(files: DataFrame, world: int, workers: int = 1) -> DataFrame:
    """``(path, size, rank, worker)``: files from the largest down, dealt to the ranks there and back.

    Ranks differ by one file at most in number and by no more than the largest file in size: in each lap
    a rank that got the larger files of the last one gets the smaller ones of this, and
    laps only get smaller. Loader processes share the files of their rank in the
    same way. The order is that of size and path, so the plan depends on the listing alone.
    """
    if world < 1 or workers < 1:
        raise ValueError("world and workers must be positive")
    placed = global_position(files.select("path", "size"), F.col("size").desc(), "path", out="_at")
    lap = F.floor(F.col("_at") / F.lit(world))
    return placed.withColumns({"rank": _there_and_back(F.col("_at"), world), "worker": _there_and_back(lap, workers)}).drop("_at")


def read_rank(
    spark: SparkSession, spec: SourceSpec, plan: DataFrame, rank: int, worker: int | None = None, source_id=0
) -> DataFrame | None:
    """The rows of one rank (or of one of its loader processes), from its own files alone; None without any.

    Only the rank's own paths come to the driver, which has to name them.
    """
    own = plan.where(F.col("rank") == rank)
    if worker is not None:
        own = own.where(F.col("worker") == worker)
    paths = [r["path"] for r in own.select("path").orderBy("path").limit(MOST_PATHS + 1).collect()]
    if len(paths) > MOST_PATHS:
        raise ValueError(f"over {MOST_PATHS} files for one reader; read its workers one by one or use more ranks")
    if not paths:
        return None
    options = {"basePath": spec.path, **spec.options}
    return read_source(spark, _with(spec, path=paths, options=options), source_id)


def _with(spec: SourceSpec, **changes) -> SourceSpec:
    return SourceSpec(**{**spec.__dict__, **changes})


def rows_of_rank(df: DataFrame, world: int, rank: int) -> DataFrame:
    """For fewer files than ranks: every ``world``-th row of each file, from a start that the file's name sets.

    ``df`` is read from files that number their rows (Parquet). The rows of a rank are found in the
    scan itself; ranks are disjoint, complete and within one row a file of each other.
    """
    start = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(world))
    return df.where(F.pmod(F.col("_metadata.row_index") + start, F.lit(world)) == rank)
