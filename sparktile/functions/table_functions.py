"""Tile origins for SQL: ``SELECT ... FROM images, LATERAL tile_positions(width, height, 256, 128)``.

The table function is a Python worker's loop over the tiles of a row. Plans in DataFrames use ``tile_grid``, whose generators stay
in generated code; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .positions import check_geometry


def _origins(length: int, patch_size: int, stride: int) -> list[int]:
    last = length - patch_size
    return [0] if last <= 0 else sorted({*range(0, last + 1, stride), last})


class TilePositions:
    """Rows y0, x0 of every tile of one image; with ``corners => true`` also y1, x1, its last row and column inside the image.

    Arguments: width, height, patch_size, stride and, constant, corners. A null size gives no rows; a patch size or stride
    below 1 fails, while the query is analysed if they are constant.
    """

    @staticmethod
    def analyze(width: AnalyzeArgument, height: AnalyzeArgument, patch_size: AnalyzeArgument, stride: AnalyzeArgument, corners: AnalyzeArgument | None = None) -> AnalyzeResult:
        if patch_size.isConstantExpression and stride.isConstantExpression:
            check_geometry(patch_size.value, stride.value)
        if corners is not None and not (corners.isConstantExpression and corners.dataType == BooleanType()):
            raise ValueError("corners must be true or false")
        names = ["y0", "x0"] + (["y1", "x1"] if corners is not None and corners.value else [])
        schema = StructType()
        for name in names:
            schema = schema.add(name, IntegerType())
        return AnalyzeResult(schema)

    def eval(self, width: int, height: int, patch_size: int, stride: int, corners: bool = False) -> Iterator[tuple]:
        if width is None or height is None:
            return
        check_geometry(patch_size, stride)
        columns = _origins(width, patch_size, stride)
        for y in _origins(height, patch_size, stride):
            for x in columns:
                yield (y, x, min(y + patch_size, height) - 1, min(x + patch_size, width) - 1) if corners else (y, x)


def register_table_functions(spark: SparkSession) -> SparkSession:
    """Make ``tile_positions`` known to this session's SQL."""
    spark.udtf.register("tile_positions", udtf(TilePositions))
    return spark
