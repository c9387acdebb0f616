"""Running aggregates along an ordered log without gathering one group in one task.

The log of a group is cut into blocks of ``step`` consecutive order values. Blocks are scanned
side by side; what precedes a block comes from a second, much shorter scan over block totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = 1024


def best_before(df: DataFrame, group: list[str], order: str, value: str, mode: str = "max", out: str = "best_before", step: int = STEP) -> DataFrame:
    """Add the largest (or smallest) non-null value among strictly earlier rows of the group."""
    agg, both = (F.max, F.greatest) if mode == "max" else (F.min, F.least)
    cut = df.withColumn("_block", F.floor(F.col(order) / F.lit(step)).cast("long"))
    totals = cut.groupBy(*group, "_block").agg(agg(value).alias("_v"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, "_block", agg("_v").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", agg(value).over(inside))
    # null keys are groups like others; greatest and least skip nulls, so a missing side leaves the other
    keys = [*group, "_block"]
    side = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_carry")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(side, same, "left").withColumn(out, both("_local", "_carry")).drop("_block", "_local", "_carry", *[f"_k{i}" for i in range(len(keys))])
