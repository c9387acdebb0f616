"""Leakage-free grouped splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stem
from ..functions.ranking import ranged_index, shuffled_index


def distinct_groups(df: DataFrame, id_col: str = "source_id", order_col: str | None = None) -> DataFrame:
    """Distinct ids with ``ord``, the smallest value of ``order_col`` (the id itself by default)."""
    return df.groupBy(F.col(id_col).alias("source_id")).agg(F.min(order_col or id_col).alias("ord"))


def shuffle_groups(groups: DataFrame, seed: int = 42) -> DataFrame:
    """Add idx, a permutation fixed by ``seed`` and the ids alone."""
    return shuffled_index(groups, ["source_id"], seed)


def assign_folds(groups: DataFrame, n_splits: int, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Add fold = position % n_splits, so fold sizes differ by at most one."""
    ranked = shuffle_groups(groups, seed) if shuffle else ranged_index(groups, ["ord", "source_id"])
    return ranked.select("source_id", (F.col("idx") % n_splits).cast("int").alias("fold"))


def check_folds(groups: DataFrame, n_splits: int) -> None:
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    have = groups.count()
    if have < n_splits:
        raise ValueError(f"{n_splits} folds need at least as many groups, found {have}")


def expand_folds(folds: DataFrame, n_splits: int) -> DataFrame:
    """fold, source_id, role for every (group, fold) pair: val in its own fold, train in the others."""
    mine = folds.withColumnRenamed("fold", "_own")
    every = mine.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return every.select(
        "fold", "source_id", F.when(F.col("fold") == F.col("_own"), "val").otherwise("train").alias("role")
    )


def kfold_splits(groups: DataFrame, n_splits: int, shuffle: bool = True, seed: int = 42) -> DataFrame:
    check_folds(groups, n_splits)
    return expand_folds(assign_folds(groups, n_splits, shuffle, seed), n_splits)


def resolve_ids(groups: DataFrame, val_ids) -> DataFrame:
    """val_id, source_id for every distinct id asked for; source_id is null where no group has that name or stem.

    ``val_ids`` is a Python list or a frame with a ``val_id`` column.
    """
    if isinstance(val_ids, DataFrame):
        wanted = val_ids.select(F.col("val_id").cast("string")).distinct()
    else:
        wanted = groups.sparkSession.createDataFrame([(str(v),) for v in val_ids], "val_id string").distinct()
    text = F.col("source_id").cast("string")
    # Of groups with one stem the last in input order is meant; an id equal to a stem yields to it.
    names = groups.select("source_id", "ord", F.explode(F.array(
        F.struct(text.alias("val_id"), F.lit(0).alias("by_stem")),
        F.struct(stem(text).alias("val_id"), F.lit(1).alias("by_stem")),
    )).alias("n")).select("source_id", "ord", "n.*")
    lookup = names.groupBy("val_id").agg(F.max_by("source_id", F.struct("by_stem", "ord", text)).alias("source_id"))

    return wanted.join(lookup, "val_id", "left")


def unknown_ids(groups: DataFrame, val_ids) -> DataFrame:
    """val_id of every id that names no group, as a lazy frame."""
    return resolve_ids(groups, val_ids).where(F.col("source_id").isNull()).select("val_id")


def manual_split(groups: DataFrame, val_ids) -> DataFrame:
    """One fold whose val groups are named by id or by stem (a stem wins over an equal id).

    Runs checks: raises for an empty list, for unknown ids (all of them are named; see ``unknown_ids`` for a frame of
    them) and when nothing is left to train on.
    """
    resolved = resolve_ids(groups, val_ids)
    got = resolved.agg(
        F.count("*").alias("wanted"), F.count_if(F.col("source_id").isNull()).alias("unknown"), F.count_distinct("source_id").alias("val")
    ).first()
    if not got.wanted:
        raise ValueError("a manual split needs at least one validation id")
    if got.unknown:
        names = resolved.where(F.col("source_id").isNull()).select("val_id").orderBy("val_id")
        shown = ", ".join(str(r.val_id) for r in names.toLocalIterator())
        raise ValueError(f"{got.unknown} validation ids are not in the dataset: {shown}")
    if got.val == groups.count():
        raise ValueError("no training groups are left after the manual split")

    val = resolved.select("source_id").distinct().withColumn("_val", F.lit(True))
    return groups.join(val, "source_id", "left").select(
        F.lit(0).alias("fold"), "source_id", F.when(F.col("_val"), "val").otherwise("train").alias("role")
    )


def apply_split(records: DataFrame, splits: DataFrame) -> DataFrame:
    """Each record once per fold with its role. Best applied to image rows, before tiling: there no source_id is a hot
    join key. Adaptive execution broadcasts the splits when their measured size allows."""
    return records.join(splits, "source_id")


def fold_summary(tiles: DataFrame, splits: DataFrame) -> DataFrame:
    """Images and tiles per fold and role.

    Tiles are first counted per image (map-side), so the join with the splits sees one row per
    image. Images whose tiles were all filtered away still count as images.
    """
    per_image = tiles.groupBy("source_id").agg(F.count("*").alias("_tiles"))
    joined = splits.join(per_image, "source_id", "left")

    def count(role):
        return F.count_if(F.col("role") == role)

    def total(role):
        return F.sum(F.when(F.col("role") == role, F.coalesce("_tiles", F.lit(0))).otherwise(0)).cast("long")

    return joined.groupBy("fold").agg(
        count("train").alias("train_images"), count("val").alias("val_images"),
        total("train").alias("train_tiles"), total("val").alias("val_tiles"),
    )
