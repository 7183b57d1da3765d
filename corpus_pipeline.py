"""From raw documents to packed training sequences; every stage is one operator of ``colloquy.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import hyperminhash, packing, qgram_filter, quality_rules, secret_scan
from colloquy.llm.common import stored, table


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _those(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` that are (``left_semi``) or are not (``left_anti``) among ``(doc_id, text_hash)`` rows; NULLs are equal."""
    i, h = _free(docs, "_llm_id", "_llm_hash")
    marked = rows.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    return docs.join(marked, same, how).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the rules and are no outliers of their language and source."""
    return _those(docs, quality_rules.verdicts(docs).where("kept"), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, 80 percent): that of the smallest ``doc_id``.

    Where that id is NULL or has several texts in the group, the text of the least hash stays. Rows that repeat
    an id and its text are one document. Documents with NULL or empty texts have no copies and stay, once for each id.
    """
    found = hyperminhash.near_duplicate_groups(docs, words=5, percent=80).where("kept")
    counted = stored(found.groupBy("group_id", "doc_id", "text_hash").count(), "kept-rows")
    one = F.min(F.struct("doc_id", "text_hash", "count")).alias("one")
    chosen = counted.where("group_id IS NOT NULL").groupBy("group_id").agg(one).select("one.*")
    i, h, n = _free(docs, "_llm_id", "_llm_hash", "_llm_n")
    kept = stored(chosen.unionByName(counted.where("group_id IS NULL").drop("group_id")).toDF(i, h, n), "kept-ids")
    mine = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)))
    again = mine.where(F.col(n) > 1).dropDuplicates(["doc_id", "text"])
    if not kept.where(F.col(n) > 1).limit(1).count():
        return mine.select(*docs.columns)
    return mine.where(F.col(n) == 1).unionByName(again).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage."""
    found = qgram_filter.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _those(docs, found.select("doc_id", "text_hash").distinct(), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by ``<secret>``; all documents stay, NULL and empty texts as they are."""
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    text, (name,) = F.coalesce("text", F.lit("")), _free(docs, "_llm_spans")
    spans = F.array_sort(F.concat(secret_scan.rule_spans(text), secret_scan.markov_spans(text, model)))
    found, some = docs.withColumn(name, spans), F.size(name) > 0
    clean = found.withColumn("text", F.when(some, secret_scan.redact(F.col("text"), F.col(name))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(some, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: one row per piece of a document, with its place."""
    encode = packing.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(docs, encode)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: Near copies, robust estimates and a tokenizer are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
