"""Inputs that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.nesting import assemble_conversations


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with mixed speaker names, image markers, blank replies and NULL values."""
    role, conv, text = F.col("role"), F.col("conv_id"), F.col("text")
    with_image = conv % 3 != 0
    even = conv % 2 == 0
    src = (
        F.when(role == "user", F.when(even, "human").otherwise("user"))
        .when(role == "assistant", F.when(even, "gpt").otherwise("assistant"))
        .otherwise(role)
    )
    value = (
        F.when((role == "assistant") & (conv % 11 == 3), F.lit(" \n"))
        .when((role == "user") & (conv % 13 == 5), F.lit(None))
        .when(
            (role == "user") & with_image & (F.col("turn") <= 1), F.concat(F.lit("<image>\n"), text, F.lit(" "))
        )
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        src.alias("src"),
        value.alias("value"),
        F.when(with_image, 64 + (conv * 97) % 2400).alias("img_w"),
        F.when(with_image, 64 + (conv * 61) % 1800).alias("img_h"),
        (conv % 3).alias("source_id"),
    )


def image_ref():
    return F.concat(F.lit("img-"), (F.col("conv_id") % 50).cast("string"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested samples ``(conv_id, source_id, image, conversations)``."""
    nested = assemble_conversations(
        raw_turns(spark, sf_dir),
        carry={
            "source_id": F.max("source_id"),
            "img_w": F.max("img_w").cast("int"),
            "img_h": F.max("img_h").cast("int"),
        },
    )
    image = F.when(
        F.col("img_w").isNotNull(),
        F.struct(image_ref().alias("ref"), F.col("img_w").alias("width"), F.col("img_h").alias("height")),
    )
    return nested.select("conv_id", "source_id", image.alias("image"), "conversations")


def samples_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some conversations missing, some empty, some without user or reply turns, some with markers that cleaning makes."""
    conv, turns = F.col("conv_id"), F.col("conversations")

    def with_split_marker(t):
        asked = F.concat(F.lit("<ima<image>ge> "), F.coalesce(t["value"], F.lit("")))
        return t.withField("value", F.when(t["src"].isin("human", "user"), asked).otherwise(t["value"]))

    gapped = (
        F.when(conv % 17 == 1, F.lit(None))
        .when(conv % 17 == 2, F.slice(turns, 1, 0))
        .when(conv % 17 == 3, F.filter(turns, lambda t: ~t["src"].isin("human", "user")))
        .when(conv % 17 == 4, F.filter(turns, lambda t: ~t["src"].isin("gpt", "assistant")))
        .when(conv % 17 == 5, F.transform(turns, with_split_marker))
        .otherwise(turns)
    )
    return samples(spark, sf_dir).withColumn("conversations", gapped)


def document_samples(documents: DataFrame) -> DataFrame:
    """Single-turn samples, derived row by row so that the table may be a stream."""
    question = F.concat(F.lit("<image> Describe item "), F.col("doc_id").cast("string"))
    asked = F.when(F.col("doc_id") % 7 != 0, question)
    turns = F.array(
        F.struct(F.lit("human").alias("src"), asked.alias("value")),
        F.struct(
            F.lit("gpt").alias("src"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("value")
        ),
    )
    image = F.when(
        F.col("doc_id") % 3 != 0,
        F.struct(
            F.concat(F.lit("img-"), (F.col("doc_id") % 50).cast("string")).alias("ref"),
            (64 + (F.col("doc_id") * 97) % 2400).cast("int").alias("width"),
            (64 + (F.col("doc_id") * 61) % 1800).cast("int").alias("height"),
        ),
    )
    return documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("source_id"), image.alias("image"), turns.alias("conversations")
    )


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, content)``: headers of the sample sizes in six formats, and damaged ones."""
    w, h, kind = F.col("img_w"), F.col("img_h"), F.col("conv_id") % 10

    def big(n, digits):
        return F.lpad(F.hex(n), digits, "0")

    def little(n, digits=4):
        return F.concat(*[F.substring(big(n, digits), at, 2) for at in range(digits - 1, 0, -2)])

    jpeg = F.concat(
        F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), big(h, 4), big(w, 4), F.lit("03011100")
    )
    content = (
        F.when(kind == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 8), big(h, 8)))
        .when(kind == 1, F.concat(F.lit("474946383961"), little(w), little(h)))
        .when(kind == 2, jpeg)
        .when(kind == 3, F.lit("89504E470D0A1A0A"))
        .when(kind == 5, F.concat(F.lit("424D" + "00" * 12 + "28000000"), little(w, 8), little(h, 8)))
        .when(kind == 6, F.concat(F.lit("5249464600000000574542505650385800000000" + "00" * 4), little(w - 1, 6), little(h - 1, 6)))
        .when(kind == 7, F.concat(F.lit("49492A0008000000020000010300" + "01000000"), little(w), F.lit("0000" + "01010300" + "01000000"), little(h), F.lit("0000")))
        .when(kind == 8, F.concat(F.lit("5249464600000000574542505650382000000000" + "0000009D012A"), little(w), little(h)))
        .when(kind == 9, F.concat(F.lit("89504E470D0A1A0A0000000D49484452FFFFFFFF"), big(h, 8)))
        .otherwise(F.md5(F.col("conv_id").cast("string")))
    )
    per_sample = raw_turns(spark, sf_dir).where("img_w IS NOT NULL").groupBy("conv_id").agg(
        F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h")
    )
    return per_sample.select("conv_id", F.unhex(content).alias("content"))


def whole_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, w, h, kind, content)``: whole files in six formats, some cut off, some with one byte changed.

    Pixel data is text of the conversation. ``conv_id % 5`` says what happens to a file: 1 cuts its last
    three bytes off, 2 changes a byte of the pixel data, which only PNG can tell; the rest is whole.
    """
    per = (
        raw_turns(spark, sf_dir).where("img_w IS NOT NULL").groupBy("conv_id")
        .agg(F.max("img_w").cast("int").alias("w"), F.max("img_h").cast("int").alias("h"), F.max(F.length("value")).alias("n"))
    )
    w, h = F.col("w"), F.col("h")

    def big(n, digits):
        return F.lpad(F.hex(n), digits, "0")

    def little(n, digits=4):
        return F.concat(*[F.substring(big(n, digits), at, 2) for at in range(digits - 1, 0, -2)])

    # Some hundred bytes without 00 or FF, as hex.
    data = F.repeat(F.hex(F.md5(F.col("conv_id").cast("string")).cast("binary")), 3 + F.col("conv_id").cast("int") % 4)
    size = (F.length(data) / 2).cast("bigint")

    def chunk(kind: str, body):
        typed = F.concat(F.hex(F.lit(kind).cast("binary")), body)
        return F.concat(big((F.length(body) / 2).cast("bigint"), 8), typed, big(F.crc32(F.unhex(typed)), 8))

    png = F.concat(
        F.lit("89504E470D0A1A0A"), chunk("IHDR", F.concat(big(w, 8), big(h, 8), F.lit("0802000000"))),
        chunk("tEXt", F.lit("436F6D6D656E7400")), chunk("IDAT", data), chunk("IEND", F.lit("")),
    )
    gif = F.concat(
        F.lit("474946383961"), little(w), little(h), F.lit("800000000000FFFFFF" + "21F9040000000000" + "2C00000000"),
        little(w), little(h), F.lit("0002"), little(F.lit(32), 2), F.substring(data, 1, 64), F.lit("00" + "3B"),
    )
    app = F.concat(F.lit("FFE1"), big(size * 40 + 2, 4), F.repeat(data, 40))  # a long segment before the size
    jpeg = F.concat(
        F.lit("FFD8"), app, app, F.lit("FFC0001108"), big(h, 4), big(w, 4), F.lit("03011100021100031100" + "FFDA0008010100003F00"),
        data, F.lit("FF00FFD0"), data, F.lit("FFD9"),
    )
    bmp = F.concat(
        F.lit("424D"), little(size + 54, 8), F.lit("00000000" + "36000000" + "28000000"), little(w, 8), little(h, 8), F.lit("01001800"),
        F.lit("01000000"), little(size, 8), F.repeat(F.lit("00"), 16), data,
    )
    webp = F.concat(F.lit("52494646"), little(size + 22, 8), F.lit("574542505650" + "3820"), little(size + 10, 8), F.lit("0000009D012A"), little(w), little(h), data)
    entry = lambda tag, value: F.concat(little(F.lit(tag)), F.lit("0400" + "01000000"), little(value, 8))
    tiff = F.concat(  # pixels before the directory
        F.lit("49492A00"), little(size + 8, 8), data, F.lit("0400"), entry(256, w), entry(257, h), entry(273, F.lit(8)), entry(279, size), F.lit("00000000")
    )
    kinds = ("png", "gif", "jpeg", "bmp", "webp", "tiff")
    text = F.array(png, gif, jpeg, bmp, webp, tiff)
    at = F.pmod(F.floor(F.col("conv_id") / 5), F.lit(6)).cast("int")
    hexed = F.element_at(text, at + 1)
    # The byte that changes lies in the pixel data of every kind.
    place = F.element_at(F.array(F.lit(70), F.lit(60), F.lit(10_000), F.lit(70), F.lit(45), F.lit(12)), at + 1) * 2 + 1
    place = F.when(F.element_at(F.array(*map(F.lit, kinds)), at + 1) == "jpeg", F.length(hexed) - 20).otherwise(place)
    hurt = (
        F.when(F.col("conv_id") % 5 == 1, F.substring(hexed, F.lit(1), F.length(hexed) - 6))
        .when(F.col("conv_id") % 5 == 2, F.concat(F.substring(hexed, F.lit(1), place - 1), F.lit("7A"), F.substring(hexed, place + 2, F.length(hexed))))
        .otherwise(hexed)
    )
    return per.select("conv_id", "w", "h", F.element_at(F.array(*map(F.lit, kinds)), at + 1).alias("kind"), F.unhex(hurt).alias("content"))


def image_folder(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The files of ``whole_images`` under ``folder/part=N/conv-<id>``, one write a file, by the tasks that hold them."""
    def write(rows):
        import os

        for r in rows:
            path = f"{folder}/part={r.conv_id % 7}"
            os.makedirs(path, exist_ok=True)
            with open(f"{path}/conv-{r.conv_id}", "wb") as file:
                file.write(r.content)

    whole_images(spark, sf_dir).select("conv_id", "content").foreachPartition(write)


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 5).alias("run"),
        (F.col("event_id") % 3).alias("epoch"),
        F.col("event_id").alias("step"),
        (1 + F.col("event_id") % 4).alias("batch_size"),
        F.col("value").alias("loss"),
    )
