"""Patch grids, boxes, colours and image names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size of the number in a dataset's file names (fixed value).
NAME_DIGITS = 12


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def first_number(path: Column) -> Column:
    """Number in ``_000000000001.``, or else the first run of digits of the stem; null if none."""
    name = base_name(path)
    exact = F.nullif(F.regexp_extract(name, rf"_(\d{{{NAME_DIGITS}}})\.", 1), F.lit(""))
    return F.coalesce(exact, F.nullif(F.regexp_extract(stem(path), r"(\d+)", 1), F.lit(""))).cast("long")


def last_number(path: Column) -> Column:
    """Number in ``_000000000001`` before a dot or the end, or else the last run of digits of the stem."""
    exact = F.nullif(F.regexp_extract(base_name(path), rf"_(\d{{{NAME_DIGITS}}})(?:\.|$)", 1), F.lit(""))
    runs = F.regexp_extract_all(stem(path), F.lit(r"(\d+)"), 1)
    return F.coalesce(exact, F.get(runs, F.size(runs) - 1)).cast("long")


def row_of(patch: Column, width: int) -> Column:
    return F.floor(patch / width).cast("int")


def column_of(patch: Column, width: int) -> Column:
    return F.pmod(patch, F.lit(width)).cast("int")


def patch_box(width: Column, height: Column, row: Column, column: Column, grid_height: int, grid_width: int) -> Column:
    """Pixel box ``x0, y0, x1, y1`` of a patch; halves round to even, and a box is never empty."""
    x0 = F.bround(column * width / grid_width).cast("int")
    y0 = F.bround(row * height / grid_height).cast("int")
    x1 = F.greatest(x0 + 1, F.bround((column + 1) * width / grid_width).cast("int"))
    y1 = F.greatest(y0 + 1, F.bround((row + 1) * height / grid_height).cast("int"))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def heat(value: Column) -> Column:
    """Red, green and blue in 0..1: three tents over the unit interval."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))

    def tent(centre: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * v - centre)))

    return F.struct(tent(3.0).alias("red"), tent(2.0).alias("green"), tent(1.0).alias("blue"))


def mod_shard(index: Column, shards: int) -> Column:
    return F.pmod(index, F.lit(shards)).cast("int")


def contiguous_shard(index: Column, shards: int, total: int | Column) -> Column:
    """Shard s has rows ``total * s div shards`` up to that of the next shard."""
    return F.floor(((index + 1) * shards - 1) / total).cast("int")
