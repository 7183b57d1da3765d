"""Corpus vocabulary, ids and length accounting."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import fixed
from colloquy.functions import tokens
from colloquy.operators.ordering import global_position
from colloquy.operators.skew import pin

# Words are numbered from 0 and pieces without a number become their UTF-8 bytes,
# whose 256 ids end where the reserved ones begin. So a vocabulary has at most
# this many words, some 6 MB, whatever the corpus is.
BYTE_BASE = fixed.FIRST_RESERVED_ID - 256
MAX_WORDS = BYTE_BASE

# Rows of an Arrow batch that are encoded together: what a task holds besides the
# batch is some tens of times this, however many rows Spark puts into the batch.
PART_BYTES = 1 << 20


def special_tokens(spark: SparkSession, style: str = "image_first") -> DataFrame:
    rows = [
        F.struct(F.lit(t).alias("piece"), F.lit(i).alias("token_id"), F.lit(s).alias("special"))
        for i, t, s in fixed.SPECIAL_TOKENS[style]
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def tokenize(df: DataFrame, prompt: str = "prompt", style: str = "image_first", out: str = "pieces") -> DataFrame:
    return df.withColumn(out, tokens.pieces(prompt, style))


def tokenize_with(
    df: DataFrame, encode: Callable[[list[str]], list[list[int]]], prompt: str = "prompt", out: str = "input_ids"
) -> DataFrame:
    """Plug in any tokenizer: ``encode`` maps a list of prompts to lists of ids, by ``PART_BYTES`` of rows or a single row."""
    at = df.columns.index(prompt)

    def encoded(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(at).to_pylist()
        ids = iter(encode([t for t in texts if t is not None]))
        column = pa.array([None if t is None else next(ids) for t in texts], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out])

    def run(batches):
        for batch in batches:
            for part in halved(batch, PART_BYTES):
                yield encoded(part)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def build_vocab(df: DataFrame, size: int, pieces: str = "pieces", style: str = "image_first") -> DataFrame:
    """``(piece, uses, token_id, special)``: the ``size`` most used pieces, ties by piece.

    Give it whole, uncut pieces. Counts combine map-side, so a piece that makes up
    a third of the text costs one partial row per task. How many pieces have how
    many uses says from which use count on pieces are needed; only those, not the
    long tail of one-use pieces, are ordered. Special tokens keep their reserved ids.
    """
    if not 0 < size <= MAX_WORDS:
        raise ValueError(f"size must be within 1 and {MAX_WORDS}")
    reserved = [t for _, t, _ in fixed.SPECIAL_TOKENS[style]]
    counts = pin(
        df.select(F.explode(pieces).alias("piece"))
        .where(~F.col("piece").isin(reserved))
        .groupBy("piece")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    # At most ``size`` use counts are looked at, as each has a piece.
    ladder = counts.groupBy("uses").count().orderBy(F.col("uses").desc()).limit(size).collect()
    least, reached = 0, 0
    for step in ladder:
        least, reached = step["uses"], reached + step["count"]
        if reached >= size:
            break
    ranked = global_position(counts.where(F.col("uses") >= least), F.col("uses").desc(), F.col("piece"), out="_at")
    words = ranked.where(F.col("_at") < size).select(
        "piece", "uses", F.col("_at").cast("int").alias("token_id"), F.lit(False).alias("special")
    )
    fixed_ids = special_tokens(df.sparkSession, style).select(
        "piece", F.lit(None).cast("bigint").alias("uses"), "token_id", "special"
    )
    return words.unionByName(fixed_ids)


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings and the length of each."""
    lengths = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.array([values.cast(pa.binary()).to_pylist()], pa.list_(pa.binary())), b"")[0].as_py()
    return np.frombuffer(joined, np.uint8), lengths


def halved(batch: pa.RecordBatch, most: int = 1 << 30):
    """``batch`` in runs of rows below ``most`` bytes, or of a single row; offsets of ids then fit in 32 bits."""
    if batch.num_rows < 2 or batch.nbytes < most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half), most)
        yield from halved(batch.slice(half), most)


def encode(df: DataFrame, vocab: DataFrame, pieces: str = "pieces", out: str = "input_ids") -> DataFrame:
    """``df`` with ids in place of pieces, row by row: no exchange, also on streams.

    A piece that is not in the vocabulary becomes the ids of its UTF-8 bytes, so
    ``decode`` gives the text back. The vocabulary, at most ``MAX_WORDS`` and the
    special tokens, goes to the executors once and its table is built once per
    task; an Arrow kernel looks up all pieces of ``PART_BYTES`` of rows together. All
    columns of ``df`` take the way through Arrow, so select only narrow ones.
    """
    most = MAX_WORDS + max(map(len, fixed.SPECIAL_TOKENS.values()))
    table = vocab.select("piece", F.col("token_id").cast("int")).limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"the vocabulary has more than {most} rows")
    sent = df.sparkSession.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in table.columns))))
    kept = [f for f in df.schema.fields if f.name != pieces]
    names = [f.name for f in kept]

    def encoded(batch: pa.RecordBatch, known: dict) -> pa.RecordBatch:
        rows = batch.column(pieces)
        distinct = pc.dictionary_encode(rows.flatten())
        ids = np.array([known.get(p, -1) for p in distinct.dictionary.to_pylist()], np.int32)
        place = distinct.indices.to_numpy(zero_copy_only=False)
        flat = ids[place] if len(place) else np.zeros(0, np.int32)
        counts = np.ones(len(flat), np.int64)
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            data, lengths = _bytes_of(distinct.dictionary.take(pa.array(place[odd])))
            counts[odd] = lengths
        ends = np.cumsum(counts)
        found = np.repeat(flat, counts)
        if len(odd):
            found[np.repeat(flat < 0, counts)] = data.astype(np.int32) + BYTE_BASE
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        edges = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
        mask = rows.is_null() if rows.null_count else None
        column = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found, pa.int32()), mask=mask)
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, out])

    def look_up(batches):
        for batch in batches:
            for part in halved(batch, PART_BYTES):
                yield encoded(part, sent.value)

    return df.mapInArrow(
        look_up, T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))])
    )


def decode(df: DataFrame, vocab: DataFrame, ids: str = "input_ids", out: str = "text") -> DataFrame:
    """The text that ``encode`` was given, from its ids."""
    pairs = vocab.select(F.col("token_id").cast("int"), "piece").limit(MAX_WORDS + 1000).collect()
    words = df.sparkSession.sparkContext.broadcast({r["token_id"]: r["piece"].encode() for r in pairs})
    at = df.columns.index(ids)

    def run(batches):
        for batch in batches:
            texts = []
            for row in batch.column(at).to_pylist():
                parts = None if row is None else [words.value.get(i) or bytes([i - BYTE_BASE]) for i in row]
                texts.append(None if parts is None else b"".join(parts).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def truncation_report(
    df: DataFrame,
    max_length: int,
    ids: str = "input_ids",
    image_id: int = fixed.IMAGE_ID,
    source: str = "source_id",
) -> DataFrame:
    """Per source: rows, rows cut, tokens cut, and rows that lose image tokens to the cut."""
    over = F.greatest(F.size(ids) - F.lit(max_length), F.lit(0))
    # Counted from the start so that short rows yield an empty tail.
    tail = F.slice(F.col(ids), F.lit(max_length + 1), over)
    lost = F.size(F.filter(tail, lambda x: x == image_id))
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((over > 0).cast("bigint")).alias("rows_cut"),
        F.sum(over.cast("bigint")).alias("tokens_cut"),
        F.sum((lost > 0).cast("bigint")).alias("rows_image_cut"),
    )


def token_budget(
    df: DataFrame, max_length: int, text: Column, visual: Column, source: str = "source_id"
) -> DataFrame:
    """Per source: samples, tokens, and samples whose text and image tokens exceed the limit."""
    total = (text + F.coalesce(visual, F.lit(0))).cast("bigint")
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(text.cast("bigint")).alias("text_tokens"),
        F.sum(F.coalesce(visual, F.lit(0)).cast("bigint")).alias("visual_tokens"),
        F.sum((total > max_length).cast("bigint")).alias("too_long"),
    )
