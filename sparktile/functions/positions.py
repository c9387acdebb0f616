"""Tile origins along one axis, and their inverse (which origins cover a pixel)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_geometry(patch_size: int, stride: int) -> None:
    if patch_size < 1 or stride < 1:
        raise ValueError(f"patch_size and stride must be at least 1, got {patch_size} and {stride}")


def tile_positions(length: Column, patch_size: int, stride: int) -> Column:
    """Every ``stride`` pixels, plus a last origin flush with the far edge."""
    check_geometry(patch_size, stride)
    last = length - patch_size
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    )


def covering_origins(pos: Column, length: Column, patch_size: int, stride: int) -> Column:
    """Origins of the tiles that contain ``pos``; turns pixel-in-tile into a generator, not a range join."""
    check_geometry(patch_size, stride)
    last = length - patch_size
    first_k = F.greatest(F.lit(0), F.ceil((pos - patch_size + 1) / F.lit(stride))).cast("int")
    last_k = F.floor(F.least(pos, last) / F.lit(stride)).cast("int")
    regular = F.when(
        first_k <= last_k,
        F.sequence(first_k * stride, last_k * stride, F.lit(stride)),
    ).otherwise(F.array().cast("array<int>"))
    flush = F.when(pos >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, flush)))


def debug_positions(length: Column, patch_size: int) -> Column:
    """Non-overlapping origins that cover the axis, the last cell possibly short."""
    check_geometry(patch_size, patch_size)
    return F.sequence(F.lit(0), length - 1, F.lit(patch_size))
