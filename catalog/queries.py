"""One registered query per operator, each over whole given tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import fixture as fx
from colloquy import fixed
from colloquy.functions import messages as M
from colloquy.functions import templates as R
from colloquy.functions import text as X
from colloquy.functions import tokens as K
from colloquy.functions import vision as V
from colloquy.functions.integrity import image_fault
from colloquy.operators import batching as B
from colloquy.operators import encoding as E
from colloquy.operators import metrics as G
from colloquy.operators import mixing as I
from colloquy.operators import ordering as O
from colloquy.operators import quality as Q
from colloquy.operators.skew import ensure_checkpoint_dir, pin
from colloquy.plans import prepare as P
from colloquy.schema import SourceSpec
from colloquy.sources import fetch
from colloquy.sources import images as S
from colloquy.sources.nesting import assemble_conversations, explode_turns, keyless_turns
from colloquy.sources.read import read_mixture, read_source, read_source_stream
from colloquy.sources.splits import count_rows, file_plan, read_rank
from colloquy.sources.write import write_quarantine, write_training_shards
from colloquy.streaming import prepare as W
from colloquy.streaming import sinks as U

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LANG_WEIGHTS = {"de": 2.0, "en": 1.0, "es": 3.0, "fr": 2.0}
CONV_WEIGHTS = {0: 1.0, 1: 2.0, 2: 1.0}
# Every id below those of bytes and special tokens; and a small one, to meet unknown pieces.
VOCAB_SIZE, FEW_WORDS = E.MAX_WORDS, 2_000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/catalog-{uuid.uuid4().hex}"


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


def joined(col, sep: str = ","):
    return F.array_join((F.col(col) if isinstance(col, str) else col).cast("array<string>"), sep)


# ---------------------------------------------------------------- sources, sinks


@query
def source_split(spark, sf):
    spec = SourceSpec(f"{sf}/documents.parquet", split="en", split_column="lang", weight=2.0)
    return read_source(spark, spec, 3).select("doc_id", "n_chars", big("source_id"), "weight")


@query
def source_mixture(spark, sf):
    specs = [
        SourceSpec(f"{sf}/documents.parquet", split=lang, split_column="lang", weight=w, source_id=lang)
        for lang, w in LANG_WEIGHTS.items()
    ]
    return read_mixture(spark, specs).select("doc_id", "source_id", "weight", "n_chars")


@query
def source_stream(spark, sf):
    path = f"{sf}/documents.parquet"
    files = path + "*"  # a pattern, so one file and a folder of files both serve as a stream
    schema = spark.read.parquet(path).schema
    stream = read_source_stream(
        spark, SourceSpec(files, split="de", split_column="lang", schema=schema, streaming=True), 1
    )
    return run_stream(stream.select("doc_id", "n_chars", big("source_id")))


def run_stream(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    out = scratch(spark)
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query
def nested_samples(spark, sf):
    s = fx.samples(spark, sf)
    turns = F.transform(
        "conversations",
        lambda t: F.concat_ws(":", t["src"], F.coalesce(F.length(t["value"]), F.lit(-1)).cast("string")),
    )
    return s.select("conv_id", F.size("conversations").cast("bigint").alias("n_turns"), F.array_join(turns, "|").alias("turns"))


@query
def keyed_turns(spark, sf):
    """Turns of which many have lost their key: the others make conversations, these are counted by reason and role."""
    key = F.when((F.col("conv_id") + F.col("turn")) % 3 != 0, F.col("conv_id"))
    turns = fx.table(spark, sf, "conversations").select(key.alias("conv_id"), "turn", "role", "text")
    nested = assemble_conversations(turns, fields=("role", "text"))
    whole = nested.select("conv_id", F.lit(None).cast("string").alias("role"), big_size("conversations").alias("n_turns"))
    lost = keyless_turns(turns).groupBy("reject_reason", "role").agg(F.count(F.lit(1)).alias("n_turns"))
    return whole.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(
        lost.withColumn("conv_id", F.lit(None).cast("bigint"))
    )


@query
def exploded_turns(spark, sf):
    return explode_turns(fx.samples(spark, sf), keep=("conv_id", "source_id")).select(
        "conv_id", "source_id", big("turn"), "src", "value"
    )


@query
def training_shards(spark, sf):
    """Writes ordered shards and reads back what each of them holds."""
    plan = interleaved_documents(spark, sf, "all_exhausted")
    out = scratch(spark)
    write_training_shards(plan, out, rows_per_shard=500)
    return spark.read.parquet(out).groupBy(big("shard")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.sum("id").alias("id_sum"),
    )


def _image_files(spark, sf):
    """A folder of image files, and the sample and path of each."""
    folder = scratch(spark).removeprefix("file:")
    fx.image_folder(spark, sf, folder)
    path = F.concat(F.lit(f"{folder}/part="), (F.col("conv_id") % 7).cast("string"), F.lit("/conv-"), F.col("conv_id").cast("string"))
    return folder, fx.whole_images(spark, sf).select("conv_id", "w", "h", path.alias("ref"))


@query
def image_fetch(spark, sf):
    """Sizes read from fetched files: of their own for some samples, of one shared file for others; the rest is not opened."""
    _, files = _image_files(spark, sf)
    first = files.agg(F.min(F.when(F.col("conv_id") % 6 == 4, F.col("ref")))).first()[0]
    plan = files.where("conv_id % 6 IN (2, 4)").select(
        "conv_id", F.when(F.col("conv_id") % 6 == 4, F.lit(first)).otherwise(F.col("ref")).alias("ref")
    )
    fetched = fetch.attach_fetched(plan, spread="conv_id", hot_rows=50)
    return S.image_dimensions(fetched).select("conv_id", "format", big("width"), big("height"))


@query
def image_ranged_headers(spark, sf):
    """Format and size from a few ranges of every file, and whether that was less than 400 bytes."""
    _, files = _image_files(spark, sf)
    heads = fetch.read_headers(fetch.distinct_refs(files))
    sized = S.image_dimensions(heads, "head")
    return sized.join(files.select("ref", "conv_id"), "ref").select(
        "conv_id", "format", big("width"), big("height"), (F.col("bytes_read") < 400).alias("few_bytes")
    )


@query
def image_integrity(spark, sf):
    """Which files are whole, by a walk of their containers."""
    return fx.whole_images(spark, sf).select("conv_id", "kind", image_fault("content").isNull().alias("whole"))


@query
def file_shards(spark, sf):
    """Files dealt to three ranks of two loader processes, and what each reads."""
    out = f"{scratch(spark)}/documents"
    part = F.floor(F.sqrt(F.col("doc_id") % 289)).cast("int")
    fx.table(spark, sf, "documents").withColumn("part", part).repartition("part").write.partitionBy("part").parquet(out)
    plan = pin(file_plan(count_rows(spark, out), world=3, workers=2))
    spec = SourceSpec(out, split_column=None)
    parts = []
    for rank in range(3):
        for worker in range(2):
            mine = read_rank(spark, spec, plan, rank, worker)
            if mine is not None:
                parts.append(mine.select("doc_id", "part", F.lit(rank).alias("rank"), F.lit(worker).alias("worker")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy(big("rank"), big("worker")).agg(
        F.countDistinct("part").alias("files"), F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("id_sum")
    )


@query
def image_payload(spark, sf):
    """Each sample gets the bytes of its (shared) image."""
    plan = fx.samples(spark, sf).select("conv_id", F.col("image.ref").alias("ref"))
    images = (
        plan.where("ref IS NOT NULL").select("ref").distinct().withColumn("content", F.encode(F.md5("ref"), "utf-8"))
    )
    return S.attach_image_bytes(plan, images, spread="conv_id").select(
        "conv_id", "ref", F.decode("content", "utf-8").alias("payload")
    )


# ---------------------------------------------------------------- filters


@query
def sample_flags(spark, sf):
    s = fx.samples_with_gaps(spark, sf)
    return s.select(
        "conv_id", M.has_turns("conversations").alias("has_turns"), M.has_image("image").alias("has_image")
    )


@query
def valid_legacy(spark, sf):
    return Q.legacy_valid(fx.samples_with_gaps(spark, sf)).select("conv_id")


@query
def valid_strict(spark, sf):
    return Q.strict_valid(fx.samples_with_gaps(spark, sf)).select("conv_id")


@query
def valid_current(spark, sf):
    return Q.current_valid(fx.samples_with_gaps(spark, sf)).select("conv_id")


@query
def kept_turns(spark, sf):
    kept = F.transform(M.drop_turns("conversations"), lambda t: F.concat_ws(":", t["src"], F.length(t["value"]).cast("string")))
    return fx.samples(spark, sf).select("conv_id", F.array_join(kept, "|").alias("turns"))


@query
def image_headers(spark, sf):
    return S.image_dimensions(fx.image_files(spark, sf)).select("conv_id", "format", big("width"), big("height"))


@query
def image_probe(spark, sf):
    return S.image_decodable(fx.image_files(spark, sf)).select("conv_id", "decodable")


def _quarantined(variant: str) -> Query:
    def run(spark, sf):
        return Q.quarantine(fx.samples_with_gaps(spark, sf), variant).select("conv_id", "reject_reason")

    run.__name__ = f"quarantine_{variant}"
    return run


for _variant in Q.VARIANTS:
    query(_quarantined(_variant))


@query
def quarantine_tables(spark, sf):
    """Accepted and rejected samples written in one pass, counted from the two folders."""
    out = scratch(spark)
    write_quarantine(Q.quarantine(fx.samples_with_gaps(spark, sf), "strict"), out)
    return spark.read.parquet(out).groupBy(F.col("accepted").cast("boolean").alias("accepted")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("conv_id").alias("id_sum")
    )


@query
def reject_counts(spark, sf):
    return Q.reject_summary(Q.quarantine(fx.samples_with_gaps(spark, sf), "current"))


@query
def reject_totals(spark, sf):
    return Q.reject_summary(Q.quarantine(fx.samples_with_gaps(spark, sf), "strict"), totals=True)


@query
def filtered_samples(spark, sf):
    return Q.filter_samples(fx.samples(spark, sf), F.size("conversations") >= 6).select("conv_id")


@F.pandas_udf(T.BooleanType())
def _prime_width(width: pd.Series) -> pd.Series:
    return width.map(lambda w: w > 1 and all(w % d for d in range(2, math.isqrt(int(w)) + 1))).astype(bool)


@query
def filtered_samples_python(spark, sf):
    return Q.filter_samples(fx.samples(spark, sf), _prime_width(F.coalesce("image.width", F.lit(0)))).select("conv_id")


# ---------------------------------------------------------------- text and templates


@query
def cleaned_text(spark, sf):
    return fx.raw_turns(spark, sf).select(
        "conv_id", "turn", X.clean_text("value").alias("text"), X.py_strip("value").alias("stripped")
    )


@query
def turn_roles(spark, sf):
    return fx.raw_turns(spark, sf).select(
        "conv_id",
        "turn",
        X.role_strict("src").alias("role"),
        X.role_strict("src", keep_system=True).alias("role_with_system"),
        X.role_legacy("src").alias("speaker"),
    )


@query
def user_fallback(spark, sf):
    users = fx.raw_turns(spark, sf).where(X.is_user("src"))
    text = X.clean_text("value")
    return users.select(
        "conv_id",
        "turn",
        X.default_user_text(text).alias("text"),
        X.default_user_text(text, fixed.STRICT_USER_TEXT).alias("strict_text"),
    )


def _message_line(m):
    parts = F.transform(m["content"], lambda p: F.concat_ws("=", p["type"], p["text"]))
    return F.concat(m["role"], F.lit("["), F.array_join(parts, ";"), F.lit("]"))


def _messages(mode: str) -> Query:
    def run(spark, sf):
        built = fx.samples(spark, sf).withColumn("messages", M.build_messages("conversations", "image", mode))
        lines = F.array_join(F.transform("messages", _message_line), "|")
        return built.select("conv_id", big_size("messages"), lines.alias("messages"))

    run.__name__ = f"messages_{mode}"
    return run


def big_size(name: str):
    return F.size(name).cast("bigint").alias("n_" + name)


query(_messages("current"))
query(_messages("strict"))


@query
def image_slots(spark, sf):
    return fx.samples(spark, sf).select(
        "conv_id", M.image_slot("conversations", "image").cast("bigint").alias("slot_turn")
    )


@query
def transcripts(spark, sf):
    return fx.samples(spark, sf).select("conv_id", R.render_transcript("conversations").alias("transcript"))


def _chat(spark, sf, mode="current", keep_system=False):
    s = fx.samples(spark, sf)
    return s.withColumn("messages", M.build_messages("conversations", "image", mode, keep_system))


@query
def prompts_image_first(spark, sf):
    """Flagship: the training prompt of each accepted conversation and its image slots."""
    return P.render_prompts(fx.samples(spark, sf)).select("conv_id", "prompt", big("n_slots"))


@query
def prompts_strict(spark, sf):
    config = P.PrepareConfig(variant="strict")
    return P.render_prompts(fx.samples(spark, sf), config).select("conv_id", "prompt", big("n_slots"))


@query
def prompts_text(spark, sf):
    return _chat(spark, sf, keep_system=True).select("conv_id", R.render_chat_text("messages").alias("prompt"))


@query
def prompts_interleaved(spark, sf):
    """System turns kept; every third user turn shows a second image, every fourth a video."""
    extra = _chat(spark, sf, keep_system=True).withColumn("messages", _with_media("messages"))
    return extra.select(
        "conv_id",
        R.render_chat_interleaved("messages").alias("prompt"),
        R.render_chat_interleaved("messages", add_vision_id=True, generation=True).alias("numbered"),
    )


def _with_media(messages: str):
    def media(kind: str):
        return F.array(F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text")))

    none = F.slice(media("image"), 1, 0)
    return F.transform(
        messages,
        lambda m, i: F.struct(
            m["role"].alias("role"),
            F.concat(
                m["content"],
                F.when((m["role"] == "user") & (i % 3 == 0), media("image")).otherwise(none),
                F.when((m["role"] == "user") & (i % 4 == 0), media("video")).otherwise(none),
            ).alias("content"),
        ),
    )


@query
def prompts_tools(spark, sf):
    """Every second assistant turn calls two tools, the user turn after it holds the responses."""
    base = _chat(spark, sf, keep_system=True)
    no_calls = F.array().cast("array<struct<name:string,arguments:string>>")

    def call(name: str, m):
        size = F.length(m["content"][0]["text"]).cast("string")
        return F.struct(
            F.lit(name).alias("name"), F.concat(F.lit('{"size": '), size, F.lit("}")).alias("arguments")
        )

    messages = F.transform(
        "messages",
        lambda m, i: F.struct(
            F.when((m["role"] == "user") & (i % 4 >= 2), "tool").otherwise(m["role"]).alias("role"),
            F.when((m["role"] == "assistant") & (i % 4 == 1), F.slice(m["content"], 1, 0))
            .otherwise(m["content"])
            .alias("content"),
            F.when(
                (m["role"] == "assistant") & (i % 4 <= 1), F.array(call("measure", m), call("store", m))
            )
            .otherwise(no_calls)
            .alias("tool_calls"),
        ),
    )
    raw = F.concat(F.lit('{"type":"function",  "name":"tool, '), F.col("source_id").cast("string"), F.lit(': x"}'))
    tools = F.when(F.col("conv_id") % 2 == 0, F.array(X.json_one_line(raw), X.json_one_line(F.lit('{"a" :[1,2]}'))))
    return base.select("conv_id", R.render_tools(messages, tools).alias("prompt"))


@query
def prompts_generation(spark, sf):
    return _chat(spark, sf).select(
        "conv_id", R.generation_suffix(R.render_chat_image_first("messages"), True).alias("prompt")
    )


@query
def placeholder_counts(spark, sf):
    p = _chat(spark, sf).withColumn("prompt", R.render_chat_image_first("messages"))
    return p.select("conv_id", R.placeholder_count("prompt").cast("bigint").alias("n_slots"))


@query
def image_alignment(spark, sf):
    s = fx.samples_with_gaps(spark, sf)
    p = s.withColumn("prompt", P.prompt_column(P.PrepareConfig()))
    return Q.check_image_alignment(p).select("conv_id", big("n_slots"), big("n_images"), "aligned")


@query
def assistant_spans(spark, sf):
    return _chat(spark, sf).select("conv_id", F.array_join(M.assistant_text("messages"), "|").alias("spoken"))


# ---------------------------------------------------------------- token arrays


def _pieces(spark, sf):
    return E.tokenize(P.render_prompts(fx.samples(spark, sf)))


@query
def prompt_pieces(spark, sf):
    return _pieces(spark, sf).select(
        "conv_id", big_size("pieces"), F.md5(F.array_join("pieces", "\x1f")).alias("pieces_md5")
    )


@query
def document_pieces(spark, sf):
    return E.tokenize(fx.table(spark, sf, "documents"), "text").select(
        "doc_id", big_size("pieces"), F.md5(F.array_join("pieces", "\x1f")).alias("pieces_md5")
    )


def _vocab(spark, sf):
    return E.build_vocab(_pieces(spark, sf), VOCAB_SIZE)


@query
def vocabulary(spark, sf):
    return _vocab(spark, sf).select("piece", "uses", big("token_id"), "special")


@query
def document_vocabulary(spark, sf):
    words = E.build_vocab(E.tokenize(fx.table(spark, sf, "documents"), "text"), 20_000)
    return words.select("piece", "uses", big("token_id"))


@query
def special_token_uses(spark, sf):
    """How often each reserved token occurs in the prompts."""
    used = _pieces(spark, sf).select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("uses"))
    return (
        E.special_tokens(spark)
        .join(used, "piece", "left")
        .select("piece", big("token_id"), "special", F.coalesce("uses", F.lit(0)).alias("uses"))
    )


def _ids(spark, sf):
    """``(conv_id, source_id, image, input_ids)``."""
    narrow = _pieces(spark, sf).select("conv_id", "source_id", "image", "pieces")
    return E.encode(narrow, _vocab(spark, sf))


@query
def encoded_ids(spark, sf):
    return _ids(spark, sf).select("conv_id", joined("input_ids").alias("input_ids"))


@query
def encoded_ids_by_row(spark, sf):
    """By a small vocabulary: most pieces are unknown to it and become bytes."""
    pieces = _pieces(spark, sf)
    rows = E.encode(pieces.select("conv_id", "pieces"), E.build_vocab(pieces, FEW_WORDS))
    return rows.select("conv_id", joined("input_ids").alias("input_ids"))


def _expanded(spark, sf):
    n = V.visual_tokens_anyres("image.width", "image.height")
    return _ids(spark, sf).select(
        "conv_id", "source_id", "image", K.expand_image_tokens("input_ids", n).alias("input_ids")
    )


@query
def expanded_image_tokens(spark, sf):
    return _expanded(spark, sf).select(
        "conv_id",
        big_size("input_ids"),
        F.md5(joined("input_ids")).alias("ids_md5"),
        K.count_of("input_ids", fixed.IMAGE_ID).cast("bigint").alias("n_image_tokens"),
    )


@query
def truncated_ids(spark, sf):
    return _ids(spark, sf).select("conv_id", joined(K.truncate("input_ids", 1024)).alias("input_ids"))


@query
def truncation_losses(spark, sf):
    return E.truncation_report(_expanded(spark, sf), 1024)


def _placed(rows, batch_size=4):
    """Rows in shuffled order, batched over all sources."""
    rows = pin(rows)
    keys = rows.select("conv_id").withColumn("all", F.lit(0))
    placed = O.seeded_shuffle(keys, "conv_id", source="all", out="pos").drop("all").join(rows, "conv_id")
    return B.assign_batches(placed, batch_size)


def _placed_images(spark, sf):
    """Batches of the accepted samples without their texts."""
    return _placed(P.accept(fx.samples(spark, sf), P.PrepareConfig()).select("conv_id", "image"))


def _batched(spark, sf, max_length=2048):
    """Conversations in batches, expanded, cut and padded."""
    config = P.PrepareConfig(max_length=max_length)
    placed = _placed(_ids(spark, sf).withColumn("n_visual", P.visual_tokens(config)))
    return B.pad_to_longest(placed, length=P.expanded_length(config), ready=P.expand_ids(config))


@query
def padded_batches(spark, sf):
    return _batched(spark, sf).select(
        "conv_id",
        "batch_id",
        big("length"),
        big("width"),
        F.md5(joined("input_ids")).alias("ids_md5"),
        F.md5(joined("attention_mask")).alias("mask_md5"),
        F.md5(joined("labels")).alias("labels_md5"),
    )


@query
def batch_summaries(spark, sf):
    return B.batch_summary(_batched(spark, sf)).withColumn("pad_share", F.round("pad_share", 6))


@query
def batch_modalities(spark, sf):
    return B.batch_modality(_placed_images(spark, sf), F.col("image").isNotNull())


@query
def batch_image_refs(spark, sf):
    b = _placed_images(spark, sf).withColumn("ref", F.col("image.ref"))
    return B.batch_images(b).select("batch_id", F.array_join("images", ",").alias("images"))


@query
def collated_batches(spark, sf):
    """A user's batch function."""

    def longest(pdf: pd.DataFrame) -> pd.DataFrame:
        top = pdf.sort_values(["length", "conv_id"], ascending=[False, True]).iloc[0]
        return pd.DataFrame(
            {"batch_id": [int(top["batch_id"])], "rows": [len(pdf)], "longest_conv": [int(top["conv_id"])]}
        )

    b = _batched(spark, sf).select("batch_id", "conv_id", "length")
    return B.collate(b, longest, "batch_id bigint, rows bigint, longest_conv bigint")


@query
def collated_rows(spark, sf):
    """A user's batch function as a table function that gets one row at a time."""

    class LongestOfBatch:
        """The longest row of a batch, the smaller id of equals."""

        def __init__(self):
            self.rows, self.best = 0, None

        def eval(self, row):
            self.rows += 1
            mine = (-row["length"], row["conv_id"])
            if self.best is None or mine < self.best:
                self.best, self.batch = mine, row["batch_id"]

        def terminate(self):
            if self.best is not None:
                yield self.batch, self.rows, self.best[1]

    b = _batched(spark, sf).select("batch_id", "pos", "conv_id", "length")
    return B.collate_rows(b, LongestOfBatch, "batch_id bigint, rows bigint, longest_conv bigint")


@query
def plugged_tokenizer(spark, sf):
    """Any tokenizer, here one id per UTF-8 byte."""
    p = P.render_prompts(fx.samples(spark, sf)).select("conv_id", "prompt")
    ids = E.tokenize_with(p, lambda texts: [list(t.encode()) for t in texts])
    return ids.select("conv_id", big_size("input_ids"), F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


# ---------------------------------------------------------------- vision budget


def _sized(spark, sf):
    return fx.samples(spark, sf).where("image IS NOT NULL").select(
        "conv_id", "source_id", F.col("image.width").alias("w"), F.col("image.height").alias("h")
    )


@query
def vision_grid(spark, sf):
    cell = V.best_resolution("w", "h")
    return _sized(spark, sf).select(
        "conv_id", cell["h"].cast("bigint").alias("grid_h"), cell["w"].cast("bigint").alias("grid_w")
    )


@query
def vision_anyres(spark, sf):
    return _sized(spark, sf).select(
        "conv_id", V.visual_tokens_anyres("w", "h").alias("tokens_1"), V.visual_tokens_anyres("w", "h", 9).alias("tokens_9")
    )


@query
def vision_dynamic(spark, sf):
    return _sized(spark, sf).select("conv_id", V.visual_tokens_dynamic("w", "h").alias("tokens"))


@query
def length_budget(spark, sf):
    p = P.prepare(fx.samples(spark, sf), P.PrepareConfig(max_length=2048))
    visual = F.when(F.col("n_slots") > 0, F.col("n_visual"))
    return E.token_budget(p, 2048, F.col("n_tokens") - F.coalesce(visual, F.lit(0)), visual)


# ---------------------------------------------------------------- order, mixing, batches


def _documents(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("source_id"))


def _conversation_keys(spark, sf):
    return fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumn(
        "source_id", (F.col("id") % 3).cast("int")
    )


@query
def shuffled_documents(spark, sf):
    return O.seeded_shuffle(_documents(spark, sf), "id")


@query
def buffered_shuffle(spark, sf):
    return O.bounded_shuffle(_documents(spark, sf), "id", STREAM_BUFFERS)


@query
def source_shares(spark, sf):
    per_source = _documents(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("weight"))
    return I.normalize_weights(per_source).select("source_id", "weight", F.round("share", 6).alias("share"))


def interleaved_documents(spark, sf, stop):
    return I.interleave(_shuffled(_documents(spark, sf)), LANG_WEIGHTS, stop=stop)


def _shuffled(keys):
    """The order of narrow keys, each read once."""
    return pin(O.seeded_shuffle(pin(keys), "id"))


@query
def interleave_all_exhausted(spark, sf):
    return interleaved_documents(spark, sf, "all_exhausted")


@query
def interleave_first_exhausted(spark, sf):
    return interleaved_documents(spark, sf, "first_exhausted")


@query
def interleave_conversations(spark, sf):
    return I.interleave(_shuffled(_conversation_keys(spark, sf)), CONV_WEIGHTS)


@query
def single_source_order(spark, sf):
    one = _documents(spark, sf).withColumn("source_id", F.lit("all"))
    return I.single_source(O.seeded_shuffle(one, "id")).select("id", "pos")


@query
def length_positions(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    return O.global_position(docs, F.col("n_chars").desc(), "doc_id")


def _planned(spark, sf):
    """All conversations of the mixture in order, with their validity."""
    flags = fx.samples_with_gaps(spark, sf).select(
        F.col("conv_id").alias("id"), Q.reject_reason("current").isNull().alias("valid")
    )
    return pin(interleave_conversations(spark, sf).join(flags, "id"))


@query
def batches_plain(spark, sf):
    return B.assign_batches(_planned(spark, sf), 4).select("pos", "id", "batch_id")


@query
def batches_filter_before(spark, sf):
    b = B.assign_batches(_planned(spark, sf), 4, valid=F.col("valid"), filter="before")
    return b.select("pos", "id", "batch_id")


@query
def batches_filter_after(spark, sf):
    b = B.assign_batches(_planned(spark, sf), 4, valid=F.col("valid"), filter="after")
    return b.select("pos", "id", "batch_id")


@query
def batches_without_rows(spark, sf):
    thinned = _planned(spark, sf).withColumn("valid", F.col("valid") & (F.col("id") % 2 == 0))
    return B.empty_batches(B.assign_batches(thinned, 2), F.col("valid"))


@query
def rank_shards(spark, sf):
    plan = pin(interleave_all_exhausted(spark, sf).select("pos", "id"))
    return B.shard_plan(plan, world=7, batch_size=4, workers=2)


@query
def optimizer_steps(spark, sf):
    plan = B.shard_plan(pin(interleave_all_exhausted(spark, sf).select("pos", "id")), world=2, batch_size=1)
    return B.step_plan(plan, accumulate=4, max_steps=100).select("pos", "id", "rank", "batch_in_rank", "step")


@query
def mixture_shares(spark, sf):
    weights = I.normalize_weights(
        _documents(spark, sf).groupBy("source_id").agg(F.lit(1.0).alias("one")).withColumn(
            "weight", O._per_source(LANG_WEIGHTS, "source_id")
        )
    )
    report = I.mixture_report(interleave_all_exhausted(spark, sf), weights, "id")
    return report.withColumns({"realised": F.round("realised", 6), "requested": F.round("requested", 6)})


def _training(name: str, weights: dict, **config) -> Query:
    def run(spark, sf):
        """End to end: mixed order, encoded once per sample, batched, expanded, cut, padded, labelled."""
        settings = P.PrepareConfig(max_length=2048, **config)
        samples = fx.samples(spark, sf).withColumnRenamed("conv_id", "id").withColumn(
            "source_id", F.col("source_id").cast("int")
        )
        plan = P.mixed_order(samples, weights, settings)
        vocab = E.build_vocab(E.tokenize(P.render_prompts(samples, settings), style=settings.style), VOCAB_SIZE, style=settings.style)
        rows = P.training_arrays(samples, plan, vocab, 4, settings)
        return rows.select(
            "pos", "id", "pass", "batch_id", "ref", big("width"), big("length"), F.md5(joined("labels")).alias("labels_md5")
        )

    run.__name__ = name
    return run


query(_training("training_rows", CONV_WEIGHTS))
# Source 0 has no images, so the strict variant accepts none of it.
query(_training("training_rows_strict", {k: CONV_WEIGHTS[k] for k in (1, 2)}, variant="strict"))
query(_training("training_rows_legacy", CONV_WEIGHTS, variant="legacy"))
query(_training("training_rows_interleaved", CONV_WEIGHTS, style="interleaved"))


# ---------------------------------------------------------------- metrics


@query
def epoch_loss(spark, sf):
    return G.epoch_metric(fx.metric_log(spark, sf)).withColumn("loss", F.round("loss", 6))


@query
def step_loss(spark, sf):
    return G.step_metric(fx.metric_log(spark, sf), 4).withColumn("loss", F.round("loss", 6))


@query
def thinned_log(spark, sf):
    return G.thin_log(fx.metric_log(spark, sf), 50)


# ---------------------------------------------------------------- streams


def _document_stream(spark, sf):
    path = f"{sf}/documents.parquet"
    files = path + "*"  # a pattern, so one file and a folder of files both serve as a stream
    return fx.document_samples(spark.readStream.schema(spark.read.parquet(path).schema).parquet(files))


@query
def stream_prepare(spark, sf):
    prepared = W.prepare_stream(_document_stream(spark, sf))
    return run_stream(
        prepared.select(
            "id", big("n_slots"), big("n_tokens"), big_size("pieces"), F.md5("prompt").alias("prompt_md5"),
            F.md5(F.array_join("pieces", "\x1f")).alias("pieces_md5"),
        )
    )


@query
def stream_rejects(spark, sf):
    out = scratch(spark)
    counts = W.reject_stream(_document_stream(spark, sf))
    running = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(lambda frame, _: frame.write.mode("overwrite").parquet(f"{out}/counts"))
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/counts")


def _arriving(spark, sf, out: str) -> Iterator[DataFrame]:
    """Stream of the documents after each of three deliveries, in the order of their ids.

    A delivery is as many files as tasks write it. Run the stream to its end each time: its checkpoint
    knows what came before, so a delivery is one micro-batch.
    """
    documents = fx.table(spark, sf, "documents")
    last = documents.agg(F.max("doc_id")).first()[0]
    for part in range(3):
        place = F.floor(F.col("doc_id") * 3 / F.lit(last + 1))
        documents.where(place == part).write.parquet(f"{out}/in/part={part}")
        yield spark.readStream.schema(documents.schema).parquet(f"{out}/in/part=*")


@query
def stream_reject_updates(spark, sf):
    """Only the counts that an epoch changes are written; the merged table is read."""
    out = scratch(spark)
    keys = ["source_id", "reject_reason"]
    for stream in _arriving(spark, sf, out):
        counts = W.reject_stream(fx.document_samples(stream))
        U.upsert_stream(counts, f"{out}/counts", f"{out}/state", keys, compact_every=2).awaitTermination()
    return U.read_upserts(spark, f"{out}/counts", counts.schema, keys)


@query
def stream_outcomes(spark, sf):
    """Accepted and rejected samples of one stream, each epoch of both committed at once."""
    out = scratch(spark)
    for stream in _arriving(spark, sf, out):
        samples = fx.document_samples(stream)
        U.outcome_stream(samples, f"{out}/rows", f"{out}/state").awaitTermination()
    schema = P.prepare_judged(samples).schema
    sides = [
        U.read_outcome(spark, f"{out}/rows", schema, side).select(
            F.lit(side).alias("outcome"), "id", "reject_reason", big("n_tokens"), F.md5("prompt").alias("prompt_md5")
        )
        for side in (U.ACCEPTED, U.REJECTED)
    ]
    return sides[0].unionByName(sides[1])


STREAM_BUFFERS = {"de": 16, "en": 100, "es": 7}


@query
def stream_batches(spark, sf):
    """Documents by language as weighted sources, arriving in three deliveries; buffers and draws go on between them."""
    out = scratch(spark)
    samples = fx.document_samples(fx.table(spark, sf, "documents"))
    vocab = E.build_vocab(E.tokenize(P.render_prompts(samples)), VOCAB_SIZE)
    mix = {"weights": LANG_WEIGHTS, "buffer": STREAM_BUFFERS}
    for stream in _arriving(spark, sf, out):
        W.batch_stream(fx.document_samples(stream), vocab, f"{out}/rows", f"{out}/state", 8, **mix).awaitTermination()
    W.finish_batches(spark, f"{out}/rows", f"{out}/state", 8, **mix)
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    return rows.select(
        "pos", "pass", "id", "source_id", "batch_id", big("width"), big("length"), F.md5(joined("labels")).alias("labels_md5")
    )
