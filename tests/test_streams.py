"""Streams over several files give what the batch functions give."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import fixture as fx
from catalog import queries as catalog
from colloquy.operators import encoding as E
from colloquy.operators.mixing import interleave
from colloquy.operators.ordering import bounded_shuffle
from colloquy.operators.quality import quarantine, reject_summary
from colloquy.operators.skew import pin
from colloquy.plans import prepare as P
from colloquy.schema import SAMPLE, SourceSpec, stream_mixture
from colloquy.sources.read import read_mixture, read_source
from colloquy.streaming import mixer as streaming
from colloquy.streaming import prepare as W
from colloquy.streaming.mixer import StreamMixer
from colloquy.streaming.sinks import UpsertTable, outcome_stream, read_outcome, read_upserts, upsert_stream


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("samples") / "t")
    rows = [
        (f"s{i}", ("r", 100 + i, 200) if i % 3 else None,
         None if i % 11 == 0 else [("human", f"<image>\nquestion {i}"), ("gpt", "answer " * (i % 7))])
        for i in range(120)
    ]
    spark.createDataFrame(rows, SAMPLE).withColumn("split", F.when(F.col("id") == "s1", "test").otherwise("train")).repartition(4).write.partitionBy("split").parquet(path)
    return path


def spec(folder, **kw):
    return SourceSpec(folder, schema=T.StructType([*SAMPLE.fields, T.StructField("split", T.StringType())]), **kw)


def drain(query):
    query.awaitTermination()


def test_split_prunes_partitions(spark, folder):
    df = read_source(spark, spec(folder))
    assert df.where("id = 's1'").count() == 0 and df.count() == 119
    assert "PartitionFilters: [isnotnull(split" in df._jdf.queryExecution().executedPlan().toString()


def test_row_key_is_unique_and_repeatable(spark, folder):
    df = read_source(spark, spec(folder, row_key="row"))
    first, again = (sorted(r[0] for r in df.select("row").collect()) for _ in range(2))
    assert first == again and len(set(first)) == 119


def test_prepare_stream_equals_batch(spark, folder, tmp_path):
    stream = read_mixture(spark, [spec(folder, streaming=True)])
    out = str(tmp_path / "out")
    drain(
        W.prepare_stream(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    want = P.prepare(read_mixture(spark, [spec(folder)]))
    cols = ["id", "source_id", "prompt", "n_tokens", "pieces"]
    a, b = spark.read.parquet(out).select(cols).collect(), want.select(cols).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and a


def test_reject_stream_equals_batch(spark, folder):
    stream = read_mixture(spark, [spec(folder, streaming=True)])
    drain(W.reject_stream(stream).writeStream.outputMode("complete").format("memory").queryName("rej").trigger(availableNow=True).start())
    want = reject_summary(quarantine(read_mixture(spark, [spec(folder)])))
    assert sorted(map(repr, spark.table("rej").collect())) == sorted(map(repr, want.collect()))


def test_batch_stream_covers_every_sample_once(spark, folder, tmp_path):
    samples = read_mixture(spark, [spec(folder)])
    prepared = P.prepare(samples)
    vocab = E.build_vocab(E.tokenize(P.render_prompts(samples)), 50)
    stream = read_mixture(spark, [spec(folder, streaming=True, options={"maxFilesPerTrigger": "2"})])
    out = str(tmp_path / "rows")
    drain(W.batch_stream(stream, vocab, out, str(tmp_path / "ck"), 8, buffer=10))
    assert W.finish_batches(spark, out, str(tmp_path / "ck"), 8, buffer=10) > 1
    rows = spark.read.option("basePath", out).parquet(out)
    assert rows.select("epoch").distinct().count() > 1
    assert sorted(r[0] for r in rows.select("id").collect()) == sorted(r[0] for r in prepared.select("id").collect())
    widths = rows.groupBy("batch_id").agg(F.countDistinct(F.size("input_ids")).alias("w"), F.count("*").alias("n"))
    assert widths.where("w <> 1 OR n > 8").count() == 0
    config = P.PrepareConfig()
    whole = P.render_prompts(samples).select("id", P.visual_tokens(config).alias("n_visual"), P.tokens.pieces("prompt").alias("pieces"))
    ids = {r[0]: r[1] for r in E.encode(whole, vocab).select("id", P.expand_ids(config)).collect()}
    assert any(151646 in v for v in ids.values())
    for r in rows.collect():
        assert r["input_ids"][: r["length"]] == ids[r["id"]]


def test_weights_and_buffers_of_specs(folder):
    specs = [spec(folder, streaming=True, weight=3.0, source_id="x"), spec(folder, streaming=True, source_id="y")]
    assert stream_mixture(specs) == ({"x": 3.0, "y": 1.0}, {"x": 10_000, "y": 10_000})


def parts_of(rows, cuts):
    """Rows dealt to micro-batches in order of their ids."""
    ends = [0, *cuts, len(rows)]
    return [rows[a:b] for a, b in zip(ends, ends[1:])]


WEIGHTS = {"x": 3.0, "y": 1.0, "z": 2.0}


@pytest.mark.parametrize(("weights", "stop"), [(None, "all_exhausted"), (WEIGHTS, "all_exhausted"), (WEIGHTS, "first_exhausted")])
def test_any_cut_gives_the_same_order(spark, tmp_path, weights, stop):
    """One micro-batch, several, empty ones, and epochs that are tried again."""
    buffer = {"x": 5, "y": 3, "z": 40} if weights else 12
    rows = [(i, "xxxyz"[i * 7 % 5], f"payload {i}") for i in range(230)]
    seen = []
    for n, cuts in enumerate([[], [60, 60, 170]]):
        mixer = StreamMixer(str(tmp_path / f"{n}"), 4, weights, buffer)
        out = []
        for epoch, part in enumerate(parts_of(rows, cuts)):
            frame = spark.createDataFrame(part, "id int, source_id string, payload string").repartition(3)
            mixer.step(frame, epoch)  # fails before it commits
            placed, commit = mixer.step(frame, epoch)
            got = placed.collect()
            assert len(got) % 4 == 0 and sorted(r["pos"] for r in got) == list(range(len(out), len(out) + len(got)))
            commit()
            if epoch % 2:  # commits, but the stream does not know it
                placed, commit = mixer.step(frame, epoch)
                assert sorted(placed.collect()) == sorted(got)
                commit()
            out += got
        assert mixer.last_epoch(spark) == len(cuts)
        used = spark.createDataFrame([r.asDict() for r in out], placed.schema).drop("pos", "pass", "_mix") if out else None
        out += mixer.finish(spark, used, stop).select(placed.columns).collect()
        assert sorted(r["pos"] for r in out) == list(range(len(out)))
        assert all(r["payload"] == f"payload {r['id']}" for r in out)
        seen.append([(r["source_id"], r["id"], r["pass"]) for r in sorted(out, key=lambda r: r["pos"])])
    assert all(order == seen[0] for order in seen[1:])
    if weights:
        keys = spark.createDataFrame([r[:2] for r in rows], "id int, source_id string")
        want = interleave(bounded_shuffle(keys, "id", buffer), weights, stop=stop).orderBy("pos").collect()
        assert seen[0] == [(r["source_id"], r["id"], r["pass"]) for r in want]
    else:
        assert sorted(i for _, i, _ in seen[0]) == list(range(230))


def test_sources_without_weight_are_refused(spark, tmp_path):
    frame = spark.createDataFrame([(1, "x"), (2, "q")], "id int, source_id string")
    with pytest.raises(ValueError):
        StreamMixer(str(tmp_path / "m"), 4, {"x": 1.0}, 5).step(frame, 0)


def test_a_source_that_never_comes(spark, tmp_path):
    frame = spark.createDataFrame([(i, "x") for i in range(9)], "id int, source_id string")
    mixer = StreamMixer(str(tmp_path / "m"), 4, {"x": 1.0, "y": 1.0}, 2)
    placed, commit = mixer.step(frame, 0)
    assert placed.count() == 0  # the first slot that draws y waits for it
    commit()
    assert sorted(r["id"] for r in mixer.finish(spark, None).collect()) == list(range(9))


def test_slots_are_joined_without_a_broadcast(spark, tmp_path, monkeypatch):
    """One for each row, though Spark takes them for a few: neither a micro-batch nor the end sends them to the driver."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pin(df)

    monkeypatch.setattr(streaming, "pin", kept)
    frame = spark.createDataFrame([(i, "xxxyz"[i % 5]) for i in range(100)], "id int, source_id string")
    mixer = StreamMixer(str(tmp_path / "m"), 4, WEIGHTS, 5)
    placed, commit = mixer.step(frame, 0)
    out = placed.collect()
    assert out and any(re.search(r"SortMergeJoin \[source_id#\d+, _rank#\d+L\]", p) for p in plans)
    assert not any(re.search(r"BroadcastHashJoin \[source_id#\d+, _rank#\d+L\]", p) for p in plans)
    commit()
    used = spark.createDataFrame(out, placed.schema).drop("pos", "pass")
    last = mixer.finish(spark, used)
    assert re.search(r"SortMergeJoin \[source_id#\d+, _rank#\d+L, _salt#\d+\]", last._jdf.queryExecution().executedPlan().toString())
    assert sorted(r["pos"] for r in out + last.collect()) == list(range(len(out) + last.count()))


COUNTS = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def test_upserts_keep_the_newest_row_of_each_key(spark, tmp_path):
    """Against a dictionary: replays, empty epochs, NULL keys, several rounds of compaction, a write that breaks off."""
    out = UpsertTable(str(tmp_path / "u"), COUNTS, ["k"], compact_every=3)
    assert out.read(spark).count() == 0
    want = {}
    for epoch in range(11):
        rows = [] if epoch == 4 else [(None if k == 5 else f"k{k}", epoch * 10 + k) for k in range(epoch % 4, 6)]
        frame = spark.createDataFrame(rows, COUNTS)
        if epoch in (5, 7, 8):  # the data are written, the line in the log is not
            before = sorted(map(repr, out.read(spark).collect()))
            whole, out.log.commit = out.log.commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
            with pytest.raises(OSError):
                out.write(spark.createDataFrame([("half", 1)], COUNTS), epoch)
            out.log.commit = whole
            assert sorted(map(repr, out.read(spark).collect())) == before
        out.write(frame, epoch)
        out.write(spark.createDataFrame([("again", 1)], COUNTS), epoch)  # committed already: changes nothing
        want.update(dict(rows))
        assert {r.k: r.n for r in out.read(spark).collect()} == want
        assert out.read(spark).count() == len(want)
    places = {p.name for p in (tmp_path / "u" / "epochs").iterdir()}
    assert len(places) <= 6 and {p.name for p in (tmp_path / "u" / "table").iterdir()} == {"0", "1"}


def test_upserts_of_one_epoch_and_bad_keys(spark, tmp_path):
    out = UpsertTable(str(tmp_path / "u"), COUNTS, ["k"])
    out.write(spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("a", None)], COUNTS), 0)
    assert [tuple(r) for r in out.read(spark).collect()] == [("a", 3)]
    for bad in ([], ["nothing"]):
        with pytest.raises(ValueError):
            UpsertTable("x", COUNTS, bad)


def test_reject_updates_equal_batch(spark, folder, tmp_path):
    stream = read_mixture(spark, [spec(folder, streaming=True)])
    counts, keys = W.reject_stream(stream), ["source_id", "reject_reason"]
    drain(upsert_stream(counts, str(tmp_path / "c"), str(tmp_path / "ck"), keys))
    want = reject_summary(quarantine(read_mixture(spark, [spec(folder)])))
    got = read_upserts(spark, str(tmp_path / "c"), counts.schema, keys)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_both_outcomes_or_neither(spark, folder, tmp_path):
    """A failure between data and commit leaves nothing to read; the next start writes the epoch once."""
    stream = read_mixture(spark, [spec(folder, streaming=True)])
    whole = P.prepare_judged(read_mixture(spark, [spec(folder)]))
    out, state = str(tmp_path / "o"), str(tmp_path / "ck")
    sides = lambda: [read_outcome(spark, out, whole.schema, s) for s in ("accepted", "rejected")]

    def fail(epoch):
        raise OSError("lost between the outputs and the commit")

    with pytest.raises(Exception, match="lost between"):
        drain(outcome_stream(stream, out, state, on_written=fail))
    assert [s.count() for s in sides()] == [0, 0]
    drain(outcome_stream(stream, out, state))
    drain(outcome_stream(stream, out, state))  # nothing new
    good, bad = sides()
    cols = ["id", "prompt", "n_tokens", "pieces"]
    want = P.prepare(read_mixture(spark, [spec(folder)])).select(cols).collect()
    assert sorted(map(repr, good.select(cols).collect())) == sorted(map(repr, want)) and want
    left = quarantine(read_mixture(spark, [spec(folder)])).where("reject_reason IS NOT NULL").select("id", "reject_reason")
    assert sorted(bad.select("id", "reject_reason").collect()) == sorted(left.collect())
    assert bad.where("prompt IS NOT NULL OR pieces IS NOT NULL OR n_tokens IS NOT NULL").count() == 0
    assert "PartitionFilters: [isnotnull(outcome" in good._jdf.queryExecution().executedPlan().toString()


def test_deliveries_are_written_by_many_tasks(spark, tmp_path):
    """No task writes a whole delivery; each is one epoch, with the ids that belong to it."""
    rows = spark.range(90).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("some text").alias("text"))
    rows.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    out = str(tmp_path / "out")
    for part, stream in enumerate(catalog._arriving(spark, str(tmp_path), out)):
        assert len(list((tmp_path / "out" / "in" / f"part={part}").glob("*.parquet"))) == 6
        samples = fx.document_samples(stream)
        drain(outcome_stream(samples, f"{out}/rows", f"{out}/state"))
    sides = [read_outcome(spark, f"{out}/rows", P.prepare_judged(samples).schema, s) for s in ("accepted", "rejected")]
    got = [(r["epoch"], r["id"]) for s in sides for r in s.select("epoch", "id").collect()]
    assert sorted(got) == [(i // 30, i) for i in range(90)]
