"""Column functions on single pixel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ITU-R 601-2 luma weights in 16-bit fixed point, for r, g, b.
LUMA_WEIGHTS, LUMA_SHIFT = (19595, 38470, 7471), 16


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit.cast("double")))


def binarize_mask(value: Column, threshold: int = 127) -> Column:
    """Masks compare strictly: value > threshold."""
    return (value > threshold).cast("double")


def threshold_mask(prob: Column, threshold: float = 0.5) -> Column:
    """Predictions compare inclusively: prob >= threshold, as 0/255."""
    return F.when(prob >= threshold, 255).otherwise(0)


def prob_to_u8(prob: Column) -> Column:
    return F.floor(prob * 255.0).cast("int")


def clip_u8(value: Column) -> Column:
    """Round half up, then clamp to the byte range."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(value + 0.5).cast("int")))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey value of a colour, rounded half up."""
    total = sum((v.cast("long") * w for v, w in zip((r, g, b), LUMA_WEIGHTS)), F.lit(1 << (LUMA_SHIFT - 1)))
    return F.shiftright(total, LUMA_SHIFT).cast("int")


def overlay_rgb(r: Column, g: Column, b: Column, mask: Column) -> tuple[Column, Column, Column]:
    """Green tint where mask > 127; other pixels pass through."""
    painted = mask > 127

    def half(v: Column) -> Column:
        return F.floor(v * 0.5).cast("int")

    return (
        F.when(painted, half(r)).otherwise(r),
        F.when(painted, F.least(F.lit(255), half(g) + 128)).otherwise(g),
        F.when(painted, half(b)).otherwise(b),
    )
