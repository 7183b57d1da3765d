"""Image files opened by reference: whole ones for the samples that are left, and ranges for their headers.

Tasks open what the refs name, by URI or local path, as far as the file systems of
PyArrow reach. Every ref is opened by one task, however many samples share it,
and no file that is not referred to is opened or listed.
"""

from __future__ import annotations

from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.skew import HOT_ROWS
from colloquy.sources.images import attach_image_bytes

#: Bytes of the first read, and of later ones while a header goes on.
FIRST_READ, NEXT_READ = 64, 32
#: Rows and bytes of one Arrow batch of contents.
BATCH_BYTES = 16 << 20
_HEADER = "ref string, head binary, reads int, bytes_read bigint, error string"


def _open(ref: str):
    from pyarrow import fs

    if "://" in ref or ref.startswith("file:"):
        system, path = fs.FileSystem.from_uri(ref.replace("file:///", "file:/").replace("file:/", "file:///"))
    else:
        system, path = fs.LocalFileSystem(), ref
    return system.open_input_file(path)


def distinct_refs(plan: DataFrame, ref: str = "ref") -> DataFrame:
    """Every ref once, in ranges of their order, so that a task's files are neighbours."""
    refs = plan.where(F.col(ref).isNotNull()).select(F.col(ref).cast("string").alias("ref")).distinct()
    return refs.repartitionByRange("ref").sortWithinPartitions("ref")


def fetch_images(refs: DataFrame, opener=_open) -> DataFrame:
    """``(ref, content, error)`` of distinct ``ref`` rows; what cannot be read has its error and no content."""

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for ref in batch.column("ref").to_pylist():
                try:
                    with opener(ref) as file:
                        rows.append((ref, file.read(), None))
                        held += len(rows[-1][1])
                except OSError as error:
                    rows.append((ref, None, str(error)[:200]))
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return refs.select("ref").mapInArrow(run, "ref string, content binary, error string")


def _batch(rows) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.large_binary(), pa.string()))]
    return pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.binary()), columns[2]], names=["ref", "content", "error"])


def attach_fetched(
    plan: DataFrame, ref: str = "ref", spread: str = "pos", hot_rows: int = HOT_ROWS, opener=_open
) -> DataFrame:
    """``plan`` with the ``content`` of what it refers to: fetched late, once a ref, joined with hot refs split."""
    images = fetch_images(distinct_refs(plan, ref), opener).select(F.col("ref").alias(ref), "content")
    return attach_image_bytes(plan, images, ref, spread, hot_rows)


def header_scanner() -> Generator[tuple[int, int], bytes, bytes]:
    """Asks for ``(offset, length)`` ranges, is sent their bytes, and returns a short file with the same header.

    The ranges it is sent may be shorter at the end of a file. The result is read as an
    image file of its own: what stands before the size (APP segments of a JPEG, pixel
    data before a TIFF directory) is left out.
    """
    head = yield 0, FIRST_READ
    if head[:3] == b"\xff\xd8\xff":
        return (yield from _jpeg_frame(head))
    if head[:4] in (b"II*\0", b"MM\0*"):
        return (yield from _tiff_directory(head))
    return head


def _jpeg_frame(head: bytes) -> Generator[tuple[int, int], bytes, bytes]:
    """The start marker and the frame header's segment."""
    at, base = 2, 0  # ``head`` holds the file from ``base`` on
    while True:
        if at - base + 9 > len(head):
            base, head = at, (yield at, NEXT_READ)
            if len(head) < 4:
                return b"\xff\xd8\xff"
        part = head[at - base :]
        if part[0] != 0xFF:
            return b"\xff\xd8\xff"
        marker = part[1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # no segment
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return b"\xff\xd8" + part[:9]
        elif marker in (0xD9, 0xDA):  # ends without a frame header
            return b"\xff\xd8\xff"
        else:
            at += 2 + int.from_bytes(part[2:4])


def _tiff_directory(head: bytes) -> Generator[tuple[int, int], bytes, bytes]:
    """The file's first directory behind a header that points to it."""
    order = "little" if head[:2] == b"II" else "big"
    start = int.from_bytes(head[4:8], order)
    if len(head) < 8 or start < 8:
        return head[:8]
    count = yield start, 2
    if len(count) < 2:
        return head[:8]
    entries = yield start + 2, 12 * int.from_bytes(count, order)
    return head[:4] + (8).to_bytes(4, order) + count + entries


def read_headers(refs: DataFrame, opener=_open) -> DataFrame:
    """``(ref, head, reads, bytes_read, error)`` of distinct ``ref`` rows, by ranged reads.

    ``head`` is a few bytes (a TIFF's directory at most) from which ``image_dimensions`` gets format and size, so no whole
    image reaches a worker.
    """

    def run(batches):
        for batch in batches:
            rows = [_scan(ref, opener) for ref in batch.column("ref").to_pylist()]
            types = (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.string())
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["ref", "head", "reads", "bytes_read", "error"]
            )

    return refs.select("ref").mapInArrow(run, _HEADER)


def _scan(ref: str, opener) -> tuple:
    reads, size = 0, 0
    try:
        with opener(ref) as file:
            scanner = header_scanner()
            offset, length = next(scanner)
            while True:
                data = file.read_at(length, offset)
                reads, size = reads + 1, size + len(data)
                try:
                    offset, length = scanner.send(data)
                except StopIteration as done:
                    return ref, done.value, reads, size, None
    except OSError as error:
        return ref, None, reads, size, str(error)[:200]
