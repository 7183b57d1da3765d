"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. The given
tables are small, so the same queries also run on copies of them with shifted
keys (``BENCH_COPIES``, 0 turns that off).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalog.queries import QUERIES
from colloquy.workers import reach_package

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "20"))

HEADLINE = [
    "cleaned_text",
    "prompts_image_first",
    "prompts_interleaved",
    "reject_counts",
    "prompt_pieces",
    "vocabulary",
    "encoded_ids",
    "padded_batches",
    "vision_anyres",
    "shuffled_documents",
    "buffered_shuffle",
    "interleave_conversations",
    "interleave_all_exhausted",
    "batches_filter_before",
    "rank_shards",
    "training_rows",
    "epoch_loss",
    "stream_prepare",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    reach_package(spark)
    return spark


def copy_tables(spark: SparkSession, copies: int) -> str:
    """Conversations and events ``copies`` times, documents a tenth of that, with shifted keys."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name, key, n in (
        ("conversations", "conv_id", copies),
        ("documents", "doc_id", max(copies // 10, 1)),
        ("events", "event_id", max(copies // 10, 1)),
    ):
        df = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        width = df.agg(F.max(key)).first()[0] + 1
        (
            df.repartition(2 * int(CPUS))
            .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn(key, F.col(key) + F.col("_copy") * width)
            .drop("_copy")
            .write.parquet(f"{out}/{name}.parquet")
        )
    return out


def timed(spark: SparkSession, directory: str, names) -> dict[str, float]:
    out = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - started, 3)
        print(f"{name} {out[name]}", file=sys.stderr, flush=True)
    return out


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = session()
    timed(spark, SF_DIR, names[:1])  # start-up is not part of any query
    given = timed(spark, SF_DIR, names)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(given.values()), 3),
        "unit": "sec",
        "queries": given,
        "sf": SF_DIR.rsplit("sf", 1)[-1],
    }
    if COPIES:
        directory = copy_tables(spark, COPIES)
        turns = spark.read.parquet(f"{directory}/conversations.parquet").count()
        documents = spark.read.parquet(f"{directory}/documents.parquet").count()
        scaled = timed(spark, directory, names)
        result["copies"] = {
            "turns": turns,
            "documents": documents,
            "total": round(sum(scaled.values()), 3),
            "queries": scaled,
        }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
