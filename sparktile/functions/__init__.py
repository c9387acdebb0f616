from .paths import extension, file_name, stem
from .pixels import (
    binarize_mask,
    clip_u8,
    luma,
    overlay_rgb,
    prob_to_u8,
    sigmoid,
    threshold_mask,
)
from .positions import covering_origins, debug_positions, tile_positions

__all__ = [
    "extension", "file_name", "stem", "binarize_mask", "clip_u8", "luma", "overlay_rgb",
    "prob_to_u8", "sigmoid", "threshold_mask", "covering_origins", "debug_positions",
    "tile_positions",
]
