"""Whether an image file is whole, by walking its containers; no pixel is decoded.

A walk ends at the format's end mark or says what is wrong at which byte. PNG chunks
carry checksums, so any changed bit is found; the others are found cut off, or
changed where their structure is. Bytes after the end mark are allowed, as viewers do.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import column


def png_fault(data: bytes) -> str | None:
    """Chunks with their CRC-32, the header first, image data among them, up to IEND."""
    at, end, seen = 8, len(data), []
    while at + 12 <= end:
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        last = at + 8 + size
        if last + 4 > end:
            return f"cut off at {at}"
        if zlib.crc32(memoryview(data)[at + 4 : last]) != int.from_bytes(data[last : last + 4]):
            return f"checksum at {at}"
        if (kind == b"IHDR") != (not seen):
            return f"header at {at}"
        if kind == b"IEND":
            return None if b"IDAT" in seen else "no image data"
        if kind not in seen:
            seen.append(kind)
        at = last + 4
    return f"cut off at {at}"


def gif_fault(data: bytes) -> str | None:
    """Blocks of data sub-blocks up to the trailer."""
    end = len(data)
    if end < 13:
        return f"cut off at {end}"

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    at, images = 13 + table(data[10]), 0
    while at < end:
        mark = data[at]
        if mark == 0x3B:
            return None if images else "no image data"
        if mark == 0x21:
            at += 2
        elif mark == 0x2C and at + 11 <= end:
            at += 10 + table(data[at + 9]) + 1
            images += 1
        else:
            return f"block at {at}"
        while at < end and data[at]:
            at += 1 + data[at]
        at += 1
    return f"cut off at {min(at, end)}"


def jpeg_fault(data: bytes) -> str | None:
    """Marker segments, with the coded data between scans skipped, up to the end of the image."""
    at, end, frame, scans = 2, len(data), False, 0
    while at + 2 <= end:
        if data[at] != 0xFF:
            return f"marker at {at}"
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark == 0xD9:
            return None if frame and scans else "no image data"
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
        elif mark == 0:
            return f"marker at {at}"
        else:
            size = int.from_bytes(data[at + 2 : at + 4])
            if at + 2 + size > end:
                return f"cut off at {at}"
            if size < 2:
                return f"segment at {at}"
            frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
            at += 2 + size
            if mark == 0xDA:
                scans += 1
                while True:  # coded data: up to a mark that is neither stuffing nor a restart
                    at = data.find(b"\xff", at)
                    if at < 0 or at + 1 >= end:
                        return f"cut off at {end}"
                    if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
                        break
                    at += 2
    return f"cut off at {min(at, end)}"


def webp_fault(data: bytes) -> str | None:
    """Chunks that fill what the container announces, image data among them."""
    end = 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        return f"cut off at {len(data)}"
    at, image = 12, False
    while at + 8 <= end:
        image |= data[at : at + 4] in (b"VP8 ", b"VP8L", b"ANMF")
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1) // 2 * 2
    return None if image and at == end else f"chunk at {min(at, end)}" if image else "no image data"


def bmp_fault(data: bytes) -> str | None:
    """Pixel rows of an uncompressed file, or the size that it announces."""
    if len(data) < 26:
        return f"cut off at {len(data)}"
    n = lambda a, b, signed=False: int.from_bytes(data[a:b], "little", signed=signed)
    start, old = n(10, 14), n(14, 18) == 12
    width, height, depth = (n(18, 20), n(20, 22), n(24, 26)) if old else (n(18, 22, True), abs(n(22, 26, True)), n(28, 30))
    if not start:
        return "no image data"
    if old or n(30, 34) in (0, 3):
        need = start + (width * depth + 31) // 32 * 4 * height
    else:
        need = start + n(34, 38)
    return None if need <= len(data) else f"cut off at {len(data)}"


def tiff_fault(data: bytes) -> str | None:
    """The first directory, and the strips or tiles that it names, inside the file."""
    order = "little" if data[:2] == b"II" else "big"
    n = lambda a, size: int.from_bytes(data[a : a + size], order)
    start = n(4, 4)
    if start < 8 or start + 2 > len(data) or start + 2 + 12 * n(start, 2) > len(data):
        return "directory"
    values = {}
    for at in range(start + 2, start + 2 + 12 * n(start, 2), 12):
        tag, kind, count = n(at, 2), n(at + 2, 2), n(at + 4, 4)
        if tag in (273, 279, 324, 325) and kind in (3, 4):
            size = {3: 2, 4: 4}[kind]
            place = at + 8 if size * count <= 4 else n(at + 8, 4)
            if place + size * count > len(data):
                return f"cut off at {len(data)}"
            values[tag] = [n(place + i * size, size) for i in range(count)]
    starts, sizes = values.get(273, values.get(324)), values.get(279, values.get(325))
    if not starts or not sizes or len(starts) != len(sizes):
        return "no image data"
    return None if all(a + b <= len(data) for a, b in zip(starts, sizes)) else f"cut off at {len(data)}"


_WALKS = (
    (b"\x89PNG\r\n\x1a\n", png_fault),
    (b"GIF87a", gif_fault),
    (b"GIF89a", gif_fault),
    (b"\xff\xd8\xff", jpeg_fault),
    (b"BM", bmp_fault),
    (b"II*\0", tiff_fault),
    (b"MM\0*", tiff_fault),
)


def fault_of(data: bytes | None) -> str | None:
    if not data:
        return "empty"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return webp_fault(data)
    walk = next((f for mark, f in _WALKS if data.startswith(mark)), None)
    return walk(data) if walk else "unknown format"


@F.pandas_udf(T.StringType())
def _faults(content: pd.Series) -> pd.Series:
    return pd.Series([fault_of(c) for c in content], index=content.index, dtype=object)


def image_fault(content: Column | str) -> Column:
    """NULL for a whole file, else what is wrong with it; files go to Arrow-batched helpers."""
    return _faults(column(content))
