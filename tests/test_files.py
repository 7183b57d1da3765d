"""Files opened by reference, ranged headers, whole and damaged containers, files dealt to ranks."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from colloquy.functions.integrity import fault_of
from colloquy.schema import SourceSpec
from colloquy.sources import fetch, splits
from colloquy.sources import images as S


def chunk(kind, body):
    return len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)


def png(w, h, data=b"pixels" * 40):
    head = chunk(b"IHDR", w.to_bytes(4) + h.to_bytes(4) + b"\x08\x02\0\0\0")
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def jpeg(w, h, app=0, data=b"pixels" * 40):
    segments = b"".join(b"\xff\xe1" + (60_002).to_bytes(2) + b"\xff" * 60_000 for _ in range(app))
    frame = b"\xff\xc2\x00\x11\x08" + h.to_bytes(2) + w.to_bytes(2) + b"\x03\x01\x11\x00\x02\x11\x00\x03\x11\x00"
    scan = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    return b"\xff\xd8" + segments + b"\xff\xff" + frame[1:] + scan + data + b"\xff\x00\xff\xd3" + data + scan + data + b"\xff\xd9"


def gif(w, h):
    size = w.to_bytes(2, "little") + h.to_bytes(2, "little")
    image = b"\x2c\0\0\0\0" + size + b"\0\x02" + b"\x05abcde\x02fg\0"
    return b"GIF89a" + size + b"\x80\0\0" + b"\0" * 6 + b"\x21\xf9\x04\0\0\0\0\0" + image + b"\x3b"


def tiff(w, h, order="little", data=b"pixels" * 400):
    entry = lambda tag, v: tag.to_bytes(2, order) + (4).to_bytes(2, order) + (1).to_bytes(4, order) + v.to_bytes(4, order)
    start = 8 + len(data)
    entries = [entry(256, w), entry(257, h), entry(273, 8), entry(279, len(data))]
    mark = b"II*\0" if order == "little" else b"MM\0*"
    return mark + start.to_bytes(4, order) + data + len(entries).to_bytes(2, order) + b"".join(entries) + b"\0" * 4


def bmp(w, h):
    rows = (w * 24 + 31) // 32 * 4 * h
    n = lambda v, size: v.to_bytes(size, "little")
    return b"BM" + n(54 + rows, 4) + n(0, 4) + n(54, 4) + n(40, 4) + n(w, 4) + n(h, 4) + n(1, 2) + n(24, 2) + b"\0" * 24 + b"p" * rows


def webp(w, h, data=b"pixels" * 40):
    body = b"\0\0\0\x9d\x01\x2a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + data
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8 " + len(body).to_bytes(4, "little") + body


WHOLE = {
    "png": png(30, 20), "jpeg": jpeg(31, 21, app=3), "gif": gif(32, 22), "tiff": tiff(33, 23), "tiff_big": tiff(34, 24, "big"),
    "bmp": bmp(5, 4), "webp": webp(36, 26),
}


@pytest.mark.parametrize("kind", list(WHOLE))
def test_every_cut_is_found(kind):
    data = WHOLE[kind]
    assert fault_of(data) is None
    step = max(1, len(data) // 400)
    spared = {"tiff": 4, "tiff_big": 4}.get(kind, 0)  # the next directory's place, which is not read
    for end in range(0, len(data) - spared, step):
        assert fault_of(data[:end]) is not None, end
    assert kind in ("tiff", "tiff_big", "webp") or fault_of(data + b"more") is None


def test_any_changed_bit_of_a_png_is_found():
    data = png(3, 2, b"xyz")
    for at in range(8, len(data)):
        for bit in range(8):
            hurt = bytearray(data)
            hurt[at] ^= 1 << bit
            assert fault_of(bytes(hurt)) is not None, (at, bit)


def test_odd_files():
    assert fault_of(None) == fault_of(b"") == "empty"
    assert fault_of(b"%PDF-1.4") == "unknown format"
    assert fault_of(jpeg(1, 1).replace(b"\xff\xda", b"\xff\xfe")) is not None  # no scan
    assert fault_of(b"\x89PNG\r\n\x1a\n" + chunk(b"IEND", b"")) is not None


@pytest.fixture()
def folder(tmp_path):
    for name, data in WHOLE.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "cut.jpeg").write_bytes(WHOLE["jpeg"][:100])
    return tmp_path


def refs_of(spark, names):
    return spark.createDataFrame([(str(n),) for n in names], "ref string")


def test_headers_by_ranges(spark, folder):
    names = [folder / n for n in [*WHOLE, "cut.jpeg", "missing"]]
    heads = fetch.read_headers(refs_of(spark, names))
    got = {os.path.basename(r["ref"]): r for r in S.image_dimensions(heads, "head").collect()}
    sizes = {"png": (30, 20), "jpeg": (31, 21), "gif": (32, 22), "tiff": (33, 23), "tiff_big": (34, 24), "bmp": (5, 4), "webp": (36, 26)}
    for name, size in sizes.items():
        r = got[name]
        assert (r["width"], r["height"], r["error"]) == (*size, None), name
        assert r["bytes_read"] <= 64 + 32 * (r["reads"] - 1) + 100
    assert got["jpeg"]["reads"] == 4 and got["jpeg"]["bytes_read"] < 200 and len(WHOLE["jpeg"]) > 180_000
    assert got["cut.jpeg"]["width"] is None and got["cut.jpeg"]["format"] == "jpeg"
    assert got["missing"]["head"] is None and "missing" in got["missing"]["error"]


def test_only_files_referred_to_are_opened(spark, folder, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def opener(ref):
        import uuid

        (log / uuid.uuid4().hex).write_text(ref)
        if ref.endswith("gif"):
            raise AssertionError("not in the plan")
        return fetch._open(ref)

    rows = [(i, str(folder / ("png" if i % 3 else "webp"))) for i in range(3000)] + [(3000, None), (3001, str(folder / "nowhere"))]
    plan = spark.createDataFrame(rows, "pos int, ref string").repartition(6)
    got = fetch.attach_fetched(plan, hot_rows=300, opener=opener).collect()
    assert sorted(r["pos"] for r in got) == list(range(3002))
    for r in got:
        assert r["content"] == (None if r["pos"] >= 3000 else WHOLE["png" if r["pos"] % 3 else "webp"])
    opened = [p.read_text() for p in log.iterdir()]
    assert sorted(map(os.path.basename, opened)) == ["nowhere", "png", "webp"]  # each once, however hot


def test_whole_images(spark, folder):
    rows = [(n, d) for n, d in WHOLE.items()] + [("cut", WHOLE["png"][:-1]), ("none", None)]
    got = S.image_whole(spark.createDataFrame(rows, "name string, content binary")).collect()
    assert {r["name"] for r in got if r["decodable"]} == set(WHOLE)


@pytest.mark.parametrize(("world", "workers"), [(1, 1), (3, 2), (4, 3), (20, 2)])
def test_files_dealt_to_ranks(spark, world, workers):
    files = spark.createDataFrame([(f"f{i:02}", 1 + i * i % 53) for i in range(17)], "path string, size long").repartition(5)
    plan = splits.file_plan(files, world, workers).collect()
    assert sorted(r["path"] for r in plan) == [f"f{i:02}" for i in range(17)]
    number, size = [0] * world, [0] * world
    for r in plan:
        number[r["rank"]] += 1
        size[r["rank"]] += r["size"]
        assert 0 <= r["worker"] < workers
    assert max(number) - min(number) <= 1 and max(size) - min(size) <= max(r["size"] for r in plan)
    again = splits.file_plan(files.repartition(2), world, workers).collect()
    assert sorted(again) == sorted(plan)


def test_a_rank_opens_its_own_files_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000).withColumn("part", F.col("id") % 7).repartition("part").write.partitionBy("part").parquet(path)
    listed = splits.list_files(spark, path, "*.parquet")
    assert listed.count() == 7
    plan = splits.file_plan(listed, 3, 2).cache()
    spec = SourceSpec(path, split_column=None)
    seen = []
    for rank in range(3):
        mine = splits.read_rank(spark, spec, plan, rank)
        per_worker = [splits.read_rank(spark, spec, plan, rank, w) for w in range(2)]
        ids = sorted(r["id"] for r in mine.collect())
        assert ids == sorted(r["id"] for df in per_worker if df is not None for r in df.collect())
        seen += ids
    assert sorted(seen) == list(range(1000))
    assert splits.read_rank(spark, spec, plan, 9) is None
    # Files of other ranks may be unreadable.
    for r in plan.where("rank <> 0").collect():
        place = r["path"].removeprefix("file:")
        os.chmod(place, 0o600)
        with open(place, "wb") as file:
            file.write(b"broken")
    assert sorted(r["id"] for r in splits.read_rank(spark, spec, plan, 0).collect())


def test_fewer_files_than_ranks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1003, 1, 2).write.parquet(path)
    df = spark.read.parquet(path)
    ranks = [sorted(r["id"] for r in splits.rows_of_rank(df, 5, k).collect()) for k in range(5)]
    assert sorted(i for r in ranks for i in r) == list(range(1003))
    assert max(map(len, ranks)) - min(map(len, ranks)) <= 2
