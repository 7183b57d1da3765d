"""Properties, small fixtures and skewed inputs."""

import collections
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy import fixed
from colloquy.functions import tokens as K
from colloquy.functions import vision as V
from colloquy.functions.images import image_size
from colloquy.operators import batching as B
from colloquy.operators import encoding as E
from colloquy.operators import mixing as I
from colloquy.operators import ordering as O
from colloquy.operators import skew
from colloquy.schema import SourceSpec, check_specs
from colloquy.sources.nesting import assemble_conversations, keyless_turns
from colloquy.sources.write import write_training_shards


def keys(spark, sizes, partitions=3):
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "source_id int, id long").repartition(partitions)


def reference_mix(ranked, weights, stop, seed=42):
    """Slot by slot, as one loop."""
    total = sum(weights.values())
    at, seen, out, slot = dict.fromkeys(ranked, 0), dict.fromkeys(ranked, False), [], 0
    rule = all if stop == "all_exhausted" else any
    while not rule(seen.values()):
        u = int(hashlib.md5(f"{seed}|{slot}".encode()).hexdigest()[:8], 16) / 2**32
        reached = 0.0
        for s, w in weights.items():
            reached += w / total
            if u < reached:
                break
        out.append((slot, s, ranked[s][at[s] % len(ranked[s])]))
        at[s] += 1
        seen[s] |= at[s] >= len(ranked[s])
        slot += 1
    return out


def by_rank(df):
    out = collections.defaultdict(dict)
    for r in df.collect():
        out[r["source_id"]][r["rank"]] = r["id"]
    return {s: [v[i] for i in range(len(v))] for s, v in out.items()}


@pytest.mark.parametrize("stop", I.STOPS)
@pytest.mark.parametrize("block", [None, 64])
def test_interleave_equals_loop(spark, stop, block):
    """One source holds most rows, one is tiny and repeated often; many blocks."""
    sizes, weights = {0: 900, 1: 40, 2: 3}, {0: 1.0, 1: 1.0, 2: 2.0}
    ranked = O.seeded_shuffle(keys(spark, sizes), "id", buckets=16)
    got = I.interleave(ranked, weights, stop=stop, block=block)
    want = reference_mix(by_rank(ranked), weights, stop)
    assert sorted((r["pos"], r["source_id"], r["id"]) for r in got.collect()) == want


def test_interleave_copies_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "HITS_PER_ROW", 4)
    sizes, weights = {0: 500, 1: 2}, {0: 1.0, 1: 1.0}
    ranked = O.seeded_shuffle(keys(spark, sizes), "id")
    got = I.interleave(ranked, weights)
    want = reference_mix(by_rank(ranked), weights, "all_exhausted")
    assert sorted((r["pos"], r["source_id"], r["id"]) for r in got.collect()) == want


def test_interleave_refuses_endless_rules(spark):
    ranked = O.seeded_shuffle(keys(spark, {0: 3, 1: 3}), "id")
    with pytest.raises(ValueError):
        I.interleave(ranked, {0: 1.0, 1: 0.0})
    with pytest.raises(ValueError):
        I.interleave(ranked, {0: 1.0, 1: 1.0, 2: 1.0})
    assert I.interleave(ranked, {0: 1.0, 1: 0.0}, stop="first_exhausted").count() == 3


def test_shuffle_does_not_depend_on_layout(spark):
    sizes = {0: 2000, 1: 50}
    a = O.seeded_shuffle(keys(spark, sizes, 2), "id").collect()
    b = O.seeded_shuffle(keys(spark, sizes, 7), "id", buckets=64).collect()
    assert sorted(a) == sorted(b)
    ranks = collections.Counter((r["source_id"], r["rank"]) for r in a)
    assert set(ranks) == {(s, i) for s, n in sizes.items() for i in range(n)}
    assert sorted((r["source_id"], r["id"]) for r in a) == sorted((s, i) for s, n in sizes.items() for i in range(n))


def test_positions_do_not_depend_on_layout(spark):
    for parts in (3, 11):
        df = spark.range(5000, numPartitions=parts).select((F.col("id") * 7919 % 5003).alias("k"))
        got = O.global_position(df, F.col("k").desc(), partitions=parts).collect()
        assert [r["k"] for r in sorted(got, key=lambda r: r["pos"])] == sorted((r["k"] for r in got), reverse=True)
        assert sorted(r["pos"] for r in got) == list(range(5000))


def test_compact_positions_over_blocks(spark):
    df = spark.range(1000).select((F.col("id") * 3 + 1).alias("pos"), F.col("id").alias("v"))
    got = O.compact_positions(df, block=64).orderBy("pos").collect()
    assert [(r["pos"], r["v"]) for r in got] == [(i, i) for i in range(1000)]


def through_a_buffer(ids, rows, source, seed=42):
    """The buffer as a loop: a drawn place gives its row away and takes the new one; the rest by hash."""
    number = lambda *parts: hashlib.md5("|".join(map(str, (seed, source, *parts))).encode()).hexdigest()
    places, out = [], []
    for at, i in enumerate(ids):
        if at < rows:
            places.append(i)
            continue
        place = int(number(at)[:8], 16) % rows
        out.append(places[place])
        places[place] = i
    return out + sorted(places, key=number)


@pytest.mark.parametrize("rows", [1, 2, 7, 64, 300, 5000])
def test_bounded_shuffle_is_a_buffer(spark, rows):
    """Blocks far smaller than the leads, too, so that these reach over several of them."""
    got = O.bounded_shuffle(keys(spark, {0: 500, 1: 7, 2: 1}), "id", rows, block_rows=8).collect()
    for s, n in {0: 500, 1: 7, 2: 1}.items():
        mine = sorted((r["rank"], r["id"]) for r in got if r["source_id"] == s)
        assert [r for r, _ in mine] == list(range(n))
        assert [i for _, i in mine] == through_a_buffer(sorted(i for _, i in mine), rows, s)


def test_places_of_a_hot_source_are_dealt_out(spark):
    arrived = spark.range(5000).select(F.lit(0).alias("source_id"), F.col("id").alias("at"))
    left = O.leave_buffer(arrived, 100, 42, "source_id", block_rows=1000)
    parts = left.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 2000


def test_no_single_task_on_rows(spark):
    """Only tables with one row per bucket or partition may meet in one task."""
    ranked = O.seeded_shuffle(keys(spark, {0: 100, 1: 10}), "id")
    for df in (ranked, I.interleave(ranked, {0: 1.0, 1: 1.0}), B.assign_batches(ranked.withColumnRenamed("rank", "pos"), 4)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_slots_need_no_exchange(spark):
    slots = I._slots(spark, 1000, 50, {0: 0.5, 1: 0.5}, 42, "source_id")
    plan = I._block_counts(slots, "source_id").select("block", "source_id", "draws")
    assert "Exchange hashpartitioning(block" not in plan._jdf.queryExecution().executedPlan().toString()
    assert slots.rdd.getNumPartitions() > 1


def test_salted_join_with_hot_and_null_keys(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("ref"),
        F.col("id").alias("pos"),
    )
    right = left.where("ref IS NOT NULL").select("ref").distinct().withColumn("content", F.md5("ref"))
    got = skew.salted_left_join(left, right, "ref", "pos", hot_rows=100)
    assert got.count() == 3000
    assert got.where(~F.col("content").eqNullSafe(F.md5("ref"))).count() == 0
    inner = skew.salted_left_join(left, right, ["ref"], "pos", hot_rows=100, how="inner")
    assert inner.count() == left.where("ref IS NOT NULL").count()


def test_encoding_is_lossless(spark):
    words = ["a", "b", "<image>", "zz", " ", "ü", "😀", ""]
    rows = [(i, [words[(i * k) % 8] for k in range(i % 9)]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "sample_id long, pieces array<string>").repartition(3)
    vocab = E.build_vocab(df, 3).cache()
    table = {r["piece"]: r["token_id"] for r in vocab.collect()}
    ids = lambda w: [table[w]] if w in table else [E.BYTE_BASE + b for b in w.encode()]
    want = {i: None if p is None else [x for w in p for x in ids(w)] for i, p in rows}
    encoded = E.encode(df, vocab)
    assert {r[0]: r[1] for r in encoded.select("sample_id", "input_ids").collect()} == want
    back = {r[0]: r[1] for r in E.decode(encoded, vocab).select("sample_id", "text").collect()}
    assert back == {i: None if p is None else "".join(p) for i, p in rows}
    everything = E.encode(df, E.build_vocab(df, E.MAX_WORDS))
    assert everything.where(F.exists("input_ids", lambda x: (x >= E.BYTE_BASE) & (x < fixed.FIRST_RESERVED_ID))).count() == 0


def test_vocab_orders_only_what_it_needs(spark):
    words = [("often",)] * 5 + [("twice",)] * 2 + [(f"w{i:03d}",) for i in range(200)] + [("also",)] * 2
    df = spark.createDataFrame(words, "w string").select(F.array("w").alias("pieces"))
    for size, want in ((2, ["often", "also"]), (4, ["often", "also", "twice", "w000"]), (500, None)):
        got = [r["piece"] for r in E.build_vocab(df, size).where("not special").orderBy("token_id").collect()]
        assert got == want if want else len(got) == 203
    with pytest.raises(ValueError):
        E.build_vocab(df, E.MAX_WORDS + 1)


def test_pieces_cover_the_text(spark):
    texts = ["", "a<|im_end|>b <image>\n\n12 ü—x́ \x85 <|x|> 😀", "<<image>>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", K.pieces("t").alias("p")).collect()
    assert all("".join(r["p"]) == r["t"] for r in got)
    assert "<|im_end|>" in got[1]["p"] and "<image>" in got[2]["p"]


def test_padding_masks_and_labels(spark):
    df = spark.createDataFrame([(0, [5, 6, 7]), (0, [8]), (1, [151643])], "batch_id int, input_ids array<int>")
    got = sorted((r["batch_id"], r["input_ids"], r["attention_mask"], r["labels"]) for r in B.pad_to_longest(df).collect())
    assert got == [
        (0, [5, 6, 7], [1, 1, 1], [5, 6, 7]),
        (0, [8, 151643, 151643], [1, 0, 0], [8, -100, -100]),
        (1, [151643], [1], [151643]),
    ]


def test_vision_sizes(spark):
    rows = [(384, 384, 1485, 144), (640, 480, 1465, 300), (1024, 768, 1465, 768), (64, 64, 1485, 64),
            (2304, 384, 1466, None), (300, 2000, 1477, None), (6000, 5000, None, 16240), (48, 640, None, 90)]
    df = spark.createDataFrame(rows, "w int, h int, a int, d int")
    got = df.select("*", V.visual_tokens_anyres("w", "h").alias("ga"), V.visual_tokens_dynamic("w", "h").alias("gd"),
                    V.best_resolution("w", "h").alias("g")).collect()
    for r in got:
        assert r["a"] in (None, r["ga"]) and r["d"] in (None, r["gd"]), r
    cells = {(r["w"], r["h"]): tuple(r["g"]) for r in got}
    assert cells[(640, 480)] == (768, 768) and cells[(1024, 768)] == (768, 1152) and cells[(300, 2000)] == (2304, 384)


def test_image_headers(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D494844520000028000000140")
    segment = b"\xff\xe1" + (70000 - 5000).to_bytes(2) + b"x" * (65000 - 2)
    jpeg = b"\xff\xd8" + segment + b"\xff\xff\xc2\x00\x11\x08" + (300).to_bytes(2) + (500).to_bytes(2) + b"\x03"
    rows = [("png", png, 640, 320), ("jpeg", jpeg, 500, 300), ("cut", jpeg[:100], None, None),
            ("noise", b"\x01\x02\x03" * 20, None, None), ("none", None, None, None), ("stub", b"\xff\xd8\xff", None, None)]
    df = spark.createDataFrame(rows, "name string, content binary, w int, h int")
    for r in df.select("*", image_size("content").alias("s")).collect():
        assert (r["s"]["width"], r["s"]["height"]) == (r["w"], r["h"]), r["name"]


def test_special_token_tables(spark):
    a = {r["token_id"]: r["piece"] for r in E.special_tokens(spark).collect()}
    b = E.special_tokens(spark, "interleaved").collect()
    assert len(a) == 5 and len(b) == 26 and sum(r["special"] for r in b) == 14
    assert a[151646] == "<image>" and {r["token_id"] for r in b} == set(range(151643, 151669))


def test_shard_plan_wraps_more_than_once(spark):
    df = spark.range(3).select(F.col("id").alias("pos"), F.col("id").alias("v"))
    got = B.shard_plan(df, world=8).orderBy("pos").collect()
    assert [r["v"] for r in got] == [0, 1, 2, 0, 1, 2, 0, 1] and [r["rank"] for r in got] == list(range(8))


def test_training_shards_on_disk(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("pos"), F.col("id").alias("v"))
    out = str(tmp_path / "shards")
    write_training_shards(df, out, 64)
    for shard in (0, 3, 15):
        files = list((tmp_path / "shards" / f"shard={shard}").glob("*.parquet"))
        assert len(files) == 1
        pos = [r["pos"] for r in spark.read.parquet(str(files[0])).collect()]
        assert pos == list(range(shard * 64, min(1000, shard * 64 + 64)))


def test_empty_batches_can_fail(spark):
    df = B.assign_batches(spark.range(4).withColumnRenamed("id", "pos"), 2)
    assert [r[0] for r in B.empty_batches(df, F.col("pos") < 2).collect()] == [1]
    with pytest.raises(ValueError):
        B.empty_batches(df, F.col("pos") < 2, fail=True)


def test_mixture_specs_are_checked():
    one = SourceSpec("p")
    with pytest.raises(ValueError):
        check_specs([one, SourceSpec("q", streaming=True)])
    with pytest.raises(ValueError):
        check_specs([SourceSpec("p", weight=-1.0), one])
    with pytest.raises(ValueError):
        check_specs([SourceSpec("p", weight=0.0)])
    with pytest.raises(ValueError):
        check_specs([])
    assert len(check_specs([one, SourceSpec("q")])) == 2


def test_expand_and_truncate(spark):
    df = spark.createDataFrame([([1, fixed.IMAGE_ID, 2],), ([3],), (None,)], "ids array<int>")
    got = [r[0] for r in df.select(K.truncate(K.expand_image_tokens("ids", 3), 4)).collect()]
    assert got == [[1] + [fixed.IMAGE_ID] * 3, [3], None]


def test_session_checkpoint_dir_is_used(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    skew.ensure_checkpoint_dir(spark)
    used = spark.sparkContext.getCheckpointDir()
    assert used is not None and (shared is None or shared.rstrip("/") in used)


def test_arrays_move_once_to_their_shard(spark, tmp_path):
    """Padding and the sharded write use the same exchange; both ways give the same rows."""
    from colloquy.plans import prepare as P
    from colloquy.schema import SAMPLE

    rows = [(f"s{i}", ("r", 64 + i, 300) if i % 2 else None, [("human", f"<image> q {i}"), ("gpt", "word " * (1 + i % 5))]) for i in range(60)]
    samples = spark.createDataFrame(rows, SAMPLE).withColumn("source_id", (F.substring("id", 2, 3).cast("int") % 3))
    config = P.PrepareConfig(max_length=700)
    vocab = E.build_vocab(E.tokenize(P.render_prompts(samples, config)), 30).cache()
    plan = P.mixed_order(samples, {0: 1.0, 1: 2.0, 2: 1.0}, config)
    plain = P.training_arrays(samples, plan, vocab, 4, config)
    sharded = P.training_arrays(samples, plan, vocab, 4, config, rows_per_shard=16)
    assert sorted(map(repr, sharded.drop("shard").collect())) == sorted(map(repr, plain.collect()))
    text = sharded._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(shard") == 1 and "Exchange hashpartitioning(batch_id" not in text
    # Arrays grow after the last exchange only: nothing below one expands or pads.
    below = text[text.index("Exchange hashpartitioning(shard"):]
    assert "flatten(" not in below and "array_repeat(" not in below
    assert {r["ref"] for r in sharded.select("ref").collect()} == {"r", None}
    write_training_shards(sharded, str(tmp_path / "t"), 16, partitioned=True)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == plan.count()  # every sample here is valid
    again = back.withColumn("shard", F.lit(7))
    write_training_shards(again, str(tmp_path / "u"), 8)
    renewed = spark.read.parquet(str(tmp_path / "u"))
    assert renewed.where(F.col("shard") != F.floor(F.col("pos") / 8)).count() == 0
    assert back.where(F.col("shard") != F.floor(F.col("pos") / 16)).count() == 0
    masked = back.where(F.col("labels") != K.labels("input_ids", "attention_mask"))
    assert masked.count() == 0


def small_samples(spark, rows):
    from colloquy.schema import SAMPLE

    return spark.createDataFrame(rows, SAMPLE).withColumn("source_id", F.lit(0))


def test_current_variant_mixes_first_and_strict_filters_first(spark):
    from colloquy.plans import prepare as P

    rows = [(f"s{i}", ("r", 64, 64), [("human", "q"), ("gpt", "a" if i % 3 else " ")]) for i in range(20)]
    samples = small_samples(spark, rows)
    vocab = E.build_vocab(E.tokenize(P.render_prompts(samples)), 30)
    for variant, positions in (("current", 20), ("strict", 13)):
        config = P.PrepareConfig(variant=variant)
        plan = P.mixed_order(samples, {0: 1.0}, config)
        assert plan.count() == positions
        got = P.training_arrays(samples, plan, vocab, 4, config).select("pos", "batch_id", "id").collect()
        assert len(got) == 13 and all(r["batch_id"] == r["pos"] // 4 for r in got)
        assert all(int(r["id"][1:]) % 3 for r in got)
        ranks = B.shard_plan(spark.createDataFrame(got), world=3, length=positions)
        assert {r["pos"] for r in got} <= {r["pos"] for r in ranks.collect()}
    gapped = spark.createDataFrame([(0,), (4,), (50,)], "pos long")
    assert sorted(r["pos"] for r in B.shard_plan(gapped, world=34).collect()) == [0, 4, 50, 51, 55]


def test_missing_and_repeated_ids_are_refused_or_keyed(spark):
    from colloquy.plans import prepare as P

    rows = [(i, None, [("human", f"q{k}"), ("gpt", f"answer {k}")]) for k, i in enumerate(["a", "a", None, "d"])]
    samples = small_samples(spark, rows)
    with pytest.raises(ValueError):
        P.mixed_order(samples, {0: 1.0})
    keyed = P.keyed(samples)
    plan = P.mixed_order(keyed, {0: 1.0}, key="row_key")
    vocab = E.build_vocab(E.tokenize(P.render_prompts(samples)), 100)
    got = P.training_arrays(keyed, plan, vocab, 2, key=("source_id", "row_key"))
    assert sorted(r["pos"] for r in got.collect()) == [0, 1, 2, 3]
    texts = E.decode(got.withColumn("ids", F.slice("input_ids", F.lit(1), F.col("length"))), vocab, "ids").collect()
    assert sorted(r["text"].split("answer ")[1][0] for r in texts) == ["0", "1", "2", "3"]


def test_unnamed_sources_have_the_default_buffer(spark):
    got = O.bounded_shuffle(keys(spark, {0: 40, 1: 30}), "id", {0: 8}).collect()
    for source, n in ((0, 40), (1, 30)):
        assert sorted(r["rank"] for r in got if r["source_id"] == source) == list(range(n))


def test_missing_split_column_is_refused(spark, tmp_path):
    from colloquy.sources.read import read_source

    spark.range(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        read_source(spark, SourceSpec(str(tmp_path / "p"), split="test"))
    assert read_source(spark, SourceSpec(str(tmp_path / "p"), split_column=None)).count() == 3


def test_null_keys_stay_spread(spark):
    left = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 5000)).alias("ref"), F.col("id").alias("pos")
    )
    right = left.where("ref IS NOT NULL").select("ref").distinct().withColumn("content", F.md5("ref"))
    got = skew.salted_left_join(left, right, "ref", "pos")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * sum(sizes) / 8


def test_damaged_and_further_image_headers(spark):
    le = lambda n, k: n.to_bytes(k, "little")
    rows = [
        ("wide", bytes.fromhex("89504E470D0A1A0A0000000D49484452FFFFFFFF00000140"), None, 320),
        ("bmp", b"BM" + b"\0" * 12 + le(40, 4) + le(500, 4) + le(300, 4), 500, 300),
        ("bmp down", b"BM" + b"\0" * 12 + le(40, 4) + le(500, 4) + (-300).to_bytes(4, "little", signed=True), 500, 300),
        ("bmp old", b"BM" + b"\0" * 12 + le(12, 4) + le(70, 2) + le(80, 2), 70, 80),
        ("webp", b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + le(641, 2) + le(480, 2), 641, 480),
        ("webp lossless", b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + le((1000 - 1) | (700 - 1) << 14, 4), 1000, 700),
        ("webp extended", b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + le(69_999, 3) + le(3, 3), 70_000, 4),
        ("tiff", b"II*\0" + le(8, 4) + le(3, 2) + le(254, 2) + le(4, 2) + le(1, 4) + le(0, 4)
         + le(256, 2) + le(3, 2) + le(1, 4) + le(33, 4) + le(257, 2) + le(4, 2) + le(1, 4) + le(70_001, 4), 33, 70_001),
        ("tiff big-endian", b"MM\0*" + (8).to_bytes(4) + (2).to_bytes(2) + b"\x01\0\0\x03\0\0\0\x01\0\x40\0\0\x01\x01\0\x03\0\0\0\x01\0\x30\0\0", 64, 48),
        ("tiff cut", b"II*\0" + le(8, 4) + le(3, 2), None, None),
        ("tiff far", b"II*\0" + le(4_000_000_000, 4), None, None),
        ("webp cut", b"RIFF\0\0\0\0WEBPVP8 ", None, None),
    ]
    df = spark.createDataFrame(rows, "name string, content binary, w int, h int")
    for r in df.select("*", image_size("content").alias("s")).collect():
        assert (r["s"]["width"], r["s"]["height"]) == (r["w"], r["h"]), r["name"]


def test_image_folder(spark, tmp_path):
    from colloquy.sources.images import image_decodable, read_images

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D494844520000028000000140"))
    (tmp_path / "sub" / "b.png").write_bytes(b"no image")
    got = image_decodable(read_images(spark, str(tmp_path), "*.png")).collect()
    assert sorted((r["ref"].rsplit("/", 1)[1], r["decodable"]) for r in got) == [("a.png", True), ("b.png", False)]


def test_stray_markers_are_misaligned(spark):
    from colloquy.operators.quality import reject_reason

    rows = [("a", ("r", 1, 1), [("human", "<ima<image>ge> x"), ("gpt", "y")]), ("b", None, [("human", "<|image_pad|> x"), ("gpt", "y")]),
            ("c", ("r", 1, 1), [("human", "<image> x"), ("gpt", "y")]), ("d", None, [("system", "<ima<image>ge>"), ("human", "x"), ("gpt", "y")])]
    samples = small_samples(spark, rows)
    got = {r[0]: (r[1], r[2]) for r in samples.select("id", reject_reason("current"), reject_reason("current", slot="<|image_pad|>")).collect()}
    assert got == {"a": ("misaligned", None), "b": (None, "misaligned"), "c": (None, None), "d": (None, None)}


def test_unknown_image_size_by_style(spark):
    from colloquy.plans import prepare as P

    samples = small_samples(spark, [("a", ("r", None, None), [("human", "q"), ("gpt", "y")])])
    for style, want in (("image_first", 729), ("interleaved", 1)):
        assert samples.select(P.visual_tokens(P.PrepareConfig(style=style))).first()[0] == want


def test_steps_without_loss_have_no_weight(spark):
    from colloquy.operators.metrics import epoch_metric

    rows = [(0, 0, 0, 4, 1.0), (0, 0, 1, 100, None), (0, 0, 2, 4, 3.0)]
    got = epoch_metric(spark.createDataFrame(rows, "run int, epoch int, step int, batch_size int, loss double")).first()
    assert (got["steps"], got["samples"], got["loss"]) == (3, 108, 2.0)


def test_turns_without_a_key_stay_apart(spark):
    """A third of the turns has no key: they make no conversation and do not move."""
    turns = spark.range(9000).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 100).alias("conv_id"), F.col("id").alias("turn"),
        F.lit("user").alias("src"), F.lit("x").alias("value"),
    )
    nested = assemble_conversations(turns)
    assert nested.where("conv_id IS NULL").count() == 0
    assert nested.agg(F.sum(F.size("conversations"))).first()[0] == 6000
    lost = keyless_turns(turns)
    assert lost.count() == 3000 and {r[0] for r in lost.select("reject_reason").distinct().collect()} == {"null_key"}
    assert "Exchange" not in lost._jdf.queryExecution().executedPlan().toString()


def test_collate_rows_sees_batches_in_order(spark):
    class EveryOther:
        """Rows of a batch by turns, and one row at its end."""

        def __init__(self):
            self.n = 0

        def eval(self, row):
            self.n += 1
            self.batch = row["batch_id"]
            if self.n % 2:
                yield self.batch, row["pos"]

        def terminate(self):
            yield self.batch, -self.n

    rows = [(b, p) for b in (0, 1, 2, None) for p in range(5)]
    df = spark.createDataFrame(rows[::-1], "batch_id bigint, pos bigint")
    got = [tuple(r) for r in B.collate_rows(df, EveryOther, "batch bigint, pos bigint").collect()]
    assert sorted(got, key=repr) == sorted([(b, p) for b in (0, 1, 2, None) for p in (0, 2, 4, -5)], key=repr)
    assert B.collate_rows(df.limit(0), EveryOther, "batch bigint, pos bigint").count() == 0


def test_large_batches_are_halved():
    rows = pa.array([["ab"] * n for n in (0, 1, 500, 3, 40, 0, 7)] + [None])
    batch = pa.RecordBatch.from_arrays([rows, pa.array(range(8))], names=["pieces", "id"])
    parts = list(E.halved(batch, 400))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert len(parts) > 2 and all(p.nbytes < 400 or p.num_rows == 1 for p in parts)
    assert [p.num_rows for p in E.halved(batch)] == [8] and [p.num_rows for p in E.halved(batch.slice(0, 0))] == [0]


def test_plugged_tokenizers_get_parts_of_batches(spark):
    """A call sees few texts where they are long, however many rows an Arrow batch has."""
    texts = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 10 != 3, F.repeat(F.lit("é"), 2000)).alias("prompt"))
    seen = E.tokenize_with(texts, lambda given: [[len(given), len(t)] for t in given]).collect()
    assert sorted(r["id"] for r in seen) == list(range(3000))
    assert all((r["input_ids"] is None) == (r["prompt"] is None) == (r["id"] % 10 == 3) for r in seen)
    assert max(r["input_ids"][0] for r in seen if r["input_ids"]) * 4000 <= E.PART_BYTES
    assert {r["input_ids"][1] for r in seen if r["input_ids"]} == {2000}


def test_batches_are_encoded_in_parts(spark, monkeypatch):
    """Known and unknown pieces, NULL and empty rows of one large batch, as given and as its parts come back."""
    df = spark.createDataFrame([(0, ["a"])], "id bigint, pieces array<string>")
    vocab = spark.createDataFrame([("a", 0), ("word", 1)], "piece string, token_id int")
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, fn, schema: fn)
        look_up = E.encode(df, vocab)
    rows = [None if i % 7 == 5 else ["a", "é", "word"] * (i % 400) for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.string()))], ["id", "pieces"])
    assert batch.nbytes > 4 * E.PART_BYTES  # and so more than one part
    parts = list(look_up([batch]))
    start = 0
    for part in parts:
        assert part.num_rows == 1 or batch.slice(start, part.num_rows).nbytes < E.PART_BYTES
        start += part.num_rows
    got = pa.Table.from_batches(parts).to_pydict()
    byte = [E.BYTE_BASE + b for b in "é".encode()]
    assert got["id"] == list(range(len(rows)))
    assert got["input_ids"] == [None if r is None else [0, *byte, 1] * (len(r) // 3) for r in rows]
