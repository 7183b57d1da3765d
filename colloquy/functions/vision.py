"""Visual tokens that an image of a given size will take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import fixed
from colloquy.functions.text import bind, column

GRID = [(h, w) for h in fixed.GRID_EDGES for w in fixed.GRID_EDGES]


def best_resolution(width: Column | str, height: Column | str, grid=GRID) -> Column:
    """``STRUCT<h, w>`` of the grid: most usable pixels, then least waste, then first listed.

    All numbers are whole and far below 2**53, so doubles hold them exactly;
    cell areas are constants and each cell's scale is taken once.
    """
    cells = F.expr(
        "array("
        + ", ".join(
            f"named_struct('h', {gh}D, 'w', {gw}D, 'area', {gh * gw}D, 'first', {-i}D)"
            for i, (gh, gw) in enumerate(grid)
        )
        + ")"
    )

    def best(size: Column) -> Column:
        w, h = size["w"], size["h"]
        scaled = F.transform(
            cells, lambda c: F.struct(F.least(c["w"] / w, c["h"] / h).alias("s"), c.alias("c"))
        )
        usable = F.transform(
            scaled,
            lambda x: F.struct(
                F.least((F.floor(w * x["s"]) * F.floor(h * x["s"])).cast("double"), w * h).alias("usable"),
                x["c"].alias("c"),
            ),
        )
        rated = F.transform(
            usable,
            lambda x: F.struct(
                x["usable"].alias("usable"),
                (x["usable"] - x["c"]["area"]).alias("thrift"),
                x["c"]["first"].alias("first"),
                x["c"].alias("c"),
            ),
        )
        return F.array_max(rated)["c"]

    w, h = column(width).cast("double"), column(height).cast("double")
    cell = bind(
        bind(F.struct(w.alias("w"), h.alias("h")), best),
        lambda c: F.struct(c["h"].cast("int").alias("h"), c["w"].cast("int").alias("w")),
    )
    return F.when((w > 0) & (h > 0), cell)


def visual_tokens_anyres(width: Column | str, height: Column | str, max_tiles: int = 1, grid=GRID) -> Column:
    """Base view, un-padded tile grid and one row separator per grid row."""
    w, h = column(width).cast("bigint"), column(height).cast("bigint")
    side = fixed.TILE_PATCHES

    def count(cell: Column) -> Column:
        ch = (cell["h"] / fixed.TILE_EDGE).cast("bigint") * side
        cw = (cell["w"] / fixed.TILE_EDGE).cast("bigint") * side
        # Whole-number division: equal to the rounded quotient for sides below 10 million.
        fit_h, fit_w = F.floor((h * cw) / w), F.floor((w * ch) / h)
        wide = w / h > cw / ch
        rows = F.when(wide, ch - 2 * F.floor((ch - fit_h) / 2)).otherwise(ch)
        cols = F.when(wide, cw).otherwise(cw - 2 * F.floor((cw - fit_w) / 2))
        return F.struct(rows.cast("bigint").alias("rows"), cols.cast("bigint").alias("cols"))

    def shrink(area: Column) -> Column:
        ratio = F.sqrt(area["rows"] * area["cols"] / F.lit(max_tiles * side * side))
        rows = F.when(ratio > 1.1, F.floor(area["rows"] / ratio)).otherwise(area["rows"])
        cols = F.when(ratio > 1.1, F.floor(area["cols"] / ratio)).otherwise(area["cols"])
        return (F.lit(fixed.BASE_VISUAL_TOKENS) + rows * cols + rows).cast("bigint")

    return bind(bind(best_resolution(w, h, grid), count), shrink)


def visual_tokens_dynamic(width: Column | str, height: Column | str) -> Column:
    """Sides rounded to whole cells, area kept within the pixel budget."""
    w, h = column(width).cast("double"), column(height).cast("double")
    edge = float(fixed.DYNAMIC_EDGE)
    low, high = float(fixed.DYNAMIC_MIN_AREA), float(fixed.DYNAMIC_MAX_AREA)

    def rounded(side: Column) -> Column:
        return F.greatest(F.lit(edge), F.bround(side / edge) * edge)

    area = rounded(w) * rounded(h)
    shrink, grow = F.sqrt(h * w / high), F.sqrt(F.lit(low) / (h * w))

    def fitted(side: Column) -> Column:
        return (
            F.when(area > high, F.greatest(F.lit(edge), F.floor(side / shrink / edge) * edge))
            .when(area < low, F.ceil(side * grow / edge) * edge)
            .otherwise(rounded(side))
        )

    return F.when((w > 0) & (h > 0), (fitted(w) * fitted(h) / (edge * edge)).cast("bigint"))
