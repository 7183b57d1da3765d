"""Image headers: format and size without decoding any pixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import column

_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def image_format(content: Column | str) -> Column:
    """``png``, ``gif``, ``jpeg``, ``bmp``, ``webp`` or ``tiff`` by magic bytes, NULL for anything else."""
    head = F.hex(F.substring(column(content), 1, 16))
    return (
        F.when(head.startswith("89504E470D0A1A0A") & (F.substring(head, 25, 8) == "49484452"), "png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
    )


def _wide(*hex_bytes: Column) -> Column:
    return F.conv(F.concat(*hex_bytes), 16, 10).try_cast("bigint")


def _number(*hex_bytes: Column) -> Column:
    """NULL where the bytes are missing or say more than an image can measure."""
    return _wide(*hex_bytes).try_cast("int")


def _little(content: Column, first: int | Column, n: int) -> Column:
    """``n`` bytes from the 1-based place ``first``, least significant byte first."""
    at = F.lit(first) if isinstance(first, int) else first
    return _wide(*[F.hex(F.substring(content, at + i, F.lit(1))) for i in reversed(range(n))])


def _bmp_size(c: Column) -> tuple[Column, Column]:
    """32-bit sides, a negative height meaning top-down rows; 16-bit ones in the oldest header."""
    old = _little(c, 15, 4) == 12
    signed = lambda v: F.when(v >= 1 << 31, (1 << 32) - v).otherwise(v)
    return F.when(old, _little(c, 19, 2)).otherwise(_little(c, 19, 4)), F.when(old, _little(c, 21, 2)).otherwise(
        signed(_little(c, 23, 4))
    )


def _webp_size(c: Column) -> tuple[Column, Column]:
    """By the first chunk: lossy, lossless or extended."""
    chunk = F.hex(F.substring(c, 13, 4))
    packed = _little(c, 22, 4)
    low = lambda v, bits: v.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    lossy = (chunk == "56503820") & (F.hex(F.substring(c, 24, 3)) == "9D012A")
    lossless = (chunk == "5650384C") & (F.hex(F.substring(c, 21, 1)) == "2F")

    def side(at: int, shift: int, extended: int) -> Column:
        return (
            F.when(lossy, low(_little(c, at, 2), 14))
            .when(lossless, low(F.shiftright(packed, shift), 14) + 1)
            .when(chunk == "56503858", _little(c, extended, 3) + 1)
        )

    return side(27, 0, 25), side(29, 14, 28)


def _tiff_size(c: Column) -> tuple[Column, Column]:
    """The first directory's entries 256 and 257, two or four bytes wide, in the file's byte order."""
    little = F.hex(F.substring(c, 1, 2)) == "4949"

    def number(at: Column, n: int) -> Column:
        big = _wide(F.hex(F.substring(c, at, F.lit(n))))
        return F.when(little, _little(c, at, n)).otherwise(big)

    start = number(F.lit(5), 4)
    inside = (start > 0) & (start < F.octet_length(c))
    at = F.when(inside, start).otherwise(F.lit(0)).cast("int")
    entries = F.when(inside, F.coalesce(number(at + 1, 2), F.lit(0))).otherwise(F.lit(0)).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.greatest(entries - 1, F.lit(0))), lambda i: at + 3 + 12 * i)

    def side(tag: int) -> Column:
        found = F.filter(places, lambda p: (number(p, 2) == tag) & (entries > 0))
        place = F.get(found, 0)
        return F.when(number(place + 2, 2) == 3, number(place + 8, 2)).otherwise(number(place + 8, 4))

    return side(256), side(257)


def _jpeg_reader():
    """The helper for JPEG rows. It is a closure, so tasks get it with the query and need no import."""

    def size_of(data: bytes | None):
        """Walk the marker segments up to the frame header."""
        at, end = 2, len(data or b"")
        while at + 9 <= end:
            if data[at] != 0xFF:
                return None
            marker = data[at + 1]
            if marker == 0xFF:  # fill byte
                at += 1
            elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without a segment
                at += 2
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
            elif marker in (0xD9, 0xDA):  # end of image or start of scan before any frame header
                return None
            else:
                at += 2 + int.from_bytes(data[at + 2 : at + 4])
        return None

    def sizes_of(content: pd.Series) -> pd.DataFrame:
        sizes = [size_of(c) or (None, None) for c in content]
        return pd.DataFrame(sizes, columns=["width", "height"], index=content.index).astype("Int32")

    return F.pandas_udf(sizes_of, _SIZE)


_jpeg_sizes = _jpeg_reader()


def image_size(content: Column | str, jpeg: bool = True) -> Column:
    """``STRUCT<width, height>`` from the header, NULL fields where there is none.

    All headers but those of JPEG are read by built-in expressions. With ``jpeg``
    the bytes of JPEG rows (and only those) go to an Arrow-batched helper. A field
    that is missing, cut off or out of range is NULL.
    """
    c = column(content)
    kind = image_format(c)

    def byte(i: int) -> Column:
        return F.hex(F.substring(c, i, 1))

    bmp, webp, tiff = _bmp_size(c), _webp_size(c), _tiff_size(c)

    def read(png: Column, gif: Column, field: str) -> Column:
        side = ("width", "height").index(field)
        out = F.when(kind == "png", png).when(kind == "gif", gif)
        for name, sizes in (("bmp", bmp), ("webp", webp), ("tiff", tiff)):
            out = out.when(kind == name, sizes[side].try_cast("int"))
        return out.when(kind == "jpeg", _jpeg_sizes(F.when(kind == "jpeg", c))[field]) if jpeg else out

    return F.struct(
        read(_number(F.hex(F.substring(c, 17, 4))), _number(byte(8), byte(7)), "width").alias("width"),
        read(_number(F.hex(F.substring(c, 21, 4))), _number(byte(10), byte(9)), "height").alias("height"),
    )
