"""One registered query per operator of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    chat,
    hyperminhash,
    katz,
    langid,
    packing,
    qgram_filter,
    quality_rules,
    resampling,
    secret_scan,
    site_style,
    toxicity,
    warc,
    whitening,
)
from colloquy.llm.common import shared_folder, table


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_style.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), path)
    return warc.page_report(spark, path)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    of_kind = lambda k: F.size(F.filter("rules", lambda s: s["kind"] == k)).cast("bigint")
    return secret_scan.scan(docs, model).select(
        "doc_id",
        *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])],
        F.sha2(secret_scan.span_text("rules"), 256).alias("base_sha256"),
        secret_scan.span_text("spans").alias("spans"),
    )


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        same.alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    count = chat.tokenizer_counts(public_tokenizers.path("byte_bpe_50k.json"))
    return chat.window_digests(chat.chat_windows(turns, count))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = packing.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), encode)


def _held_out(folds: int, at: int = 1):
    """Whether a document's id is in the held-out fold; a NULL id is not."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return F.coalesce(fold == at, F.lit(False))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qgram_filter.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = katz.katz_scores(table(spark, sf_dir, "documents"), ~_held_out(5), min_count=1)
    return scores.withColumn("held_out", ~F.col("learned")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~_held_out(3))
    found = langid.predict(docs, model)
    return found.select("doc_id", _held_out(3).alias("held_out"), "lang_pred", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~_held_out(4, 2))
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_chat_windows": op2_chat_windows,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality_rules": op4_quality_rules,
    "op5_pack": op5_pack,
    "op6_decontaminate": op6_decontaminate,
    "op7_katz": op7_katz,
    "op8_language": op8_language,
    "op9_main_text": op9_main_text,
    "op10_warc": op10_warc,
    "op11_toxicity": op11_toxicity,
    "op12_resample": op12_resample,
    "op13_whitening": op13_whitening,
}
