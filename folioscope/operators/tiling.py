"""Image tiling and token layouts as arithmetic: aspect choice, tile boxes, counts of visual tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let


def target_ratios(least: int = 2, most: int = 32) -> list[tuple[int, int]]:
    """(columns, rows) whose product is within bounds, by area; equal areas by columns, then rows, so that ties are settled."""
    return sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most), key=lambda r: (r[0] * r[1], *r))


def closest_ratio(width: Column, height: Column, size: int = 640, least: int = 2, most: int = 32) -> Column:
    """(cols, rows) with the least difference of aspect; of equals the last one that the image's area fills by more than half."""
    ratios = target_ratios(least, most)
    w, h = width.cast("double"), height.cast("double")
    aspect = w / h
    candidates = F.array(*(F.struct(F.lit(i).alias("cols"), F.lit(j).alias("rows"), F.lit(i / j).alias("aspect")) for i, j in ratios))
    measured = let(aspect, lambda own: F.transform(candidates, lambda c: F.struct(F.abs(own - c["aspect"]).alias("off"), c["cols"].alias("cols"), c["rows"].alias("rows"))))
    fills = lambda c: w * h > 0.5 * size * size * c["cols"] * c["rows"]

    def choose(tied: Column) -> Column:
        later = F.filter(F.slice(tied, 2, F.greatest(F.lit(0), F.size(tied) - 1)), fills)
        return let(F.coalesce(F.try_element_at(later, F.lit(-1)), F.get(tied, 0)), lambda c: F.struct(c["cols"].alias("cols"), c["rows"].alias("rows")))

    closest = lambda all_of: let(F.array_min(F.transform(all_of, lambda c: c["off"])), lambda best: let(F.filter(all_of, lambda c: c["off"] == best), choose))
    return let(measured, closest)


def tile_boxes(cols: Column, rows: Column, size: int = 640, thumbnail: bool = False) -> Column:
    """Boxes of tiles, row by row; a thumbnail follows more than one."""
    boxes = F.transform(F.sequence(F.lit(0), cols * rows - 1), lambda k: F.array(k % cols * size, F.floor(k / cols).cast("int") * size, (k % cols + 1) * size, (F.floor(k / cols).cast("int") + 1) * size))
    return F.when(F.size(boxes) != 1, F.concat(boxes, F.array(F.array(*map(F.lit, (0, 0, size, size)))))).otherwise(boxes) if thumbnail else boxes


def square_ratio(width: Column, height: Column) -> Column:
    longer, shorter = F.greatest(width, height).cast("double"), F.least(width, height).cast("double")
    return 1 - (longer - shorter) / longer


def valid_tokens(width: Column, height: Column, local_tiles: Column, base: int = 1024, size: int = 640) -> Column:
    """Visual tokens that carry image content."""
    full = {1024: 256, 1280: 400}.get(base, 0)
    return (full * square_ratio(width, height)).cast("int") + (local_tiles * 100 if size == 640 else F.lit(0))


def queries_per_side(size: int, patch: int = 16, downsample: int = 4) -> int:
    return math.ceil(size // patch / downsample)


def layout_tokens(cols: Column, rows: Column, base: int = 1024, size: int = 640) -> Column:
    """Tokens of an image: the global view in rows with a newline each and a separator, then local views if it is tiled."""
    q, g = queries_per_side(size), queries_per_side(base)
    return F.lit((g + 1) * g + 1) + F.when((cols > 1) | (rows > 1), (q * cols + 1) * (q * rows)).otherwise(F.lit(0))


def layout_ids(cols: Column, rows: Column, token: int, base: int = 1024, size: int = 640) -> Column:
    return F.array_repeat(F.lit(token), layout_tokens(cols, rows, base, size))


def compression(output_tokens: Column, valid: Column) -> Column:
    return F.bround(output_tokens / valid, 2)


def window_tile(row: Column, col: Column, window: int) -> Column:
    """The window of a grid cell, and the cell's place inside it."""
    return F.struct(F.floor(row / window).alias("tile_row"), F.floor(col / window).alias("tile_col"), (row % window).alias("row"), (col % window).alias("col"))


def padded(extent: Column, window: int) -> Column:
    return F.ceil(extent / window) * window
