import pytest
from pyspark.sql import functions as F

from sparktile.operators import splits
from sparktile.plans.jobs import Config, make_splits


@pytest.fixture
def groups(spark):
    ids = [f"scan {i}.tif" for i in range(23)] * 3
    return splits.distinct_groups(spark.createDataFrame([(i,) for i in ids], "source_id string"))


@pytest.mark.parametrize("shuffle", [True, False])
def test_kfold_invariants(groups, shuffle):
    rows = splits.kfold_splits(groups, 4, shuffle).collect()
    everyone = {r.source_id for r in groups.collect()}
    sizes = []
    for fold in range(4):
        val = {r.source_id for r in rows if r.fold == fold and r.role == "val"}
        train = {r.source_id for r in rows if r.fold == fold and r.role == "train"}
        assert not val & train and val | train == everyone
        sizes.append(len(val))
    assert sum(sizes) == 23 and max(sizes) - min(sizes) <= 1


def test_shuffle_depends_on_seed_only(groups):
    a, b, c = (sorted(splits.assign_folds(g, 4, True, s).collect()) for g, s in ((groups, 1), (groups.repartition(5), 1), (groups, 2)))
    assert a == b != c


def test_kfold_errors(groups):
    for n in (1, 24):
        with pytest.raises(ValueError):
            splits.kfold_splits(groups, n)


def test_manual_split_by_name_or_stem(groups):
    rows = splits.manual_split(groups, ["scan 3", "scan 7.tif", "scan 7"]).collect()
    assert {r.source_id for r in rows if r.role == "val"} == {"scan 3.tif", "scan 7.tif"}
    assert len(rows) == 23 and {r.fold for r in rows} == {0}


def test_stem_goes_before_equal_name(spark):
    g = splits.distinct_groups(spark.createDataFrame([("a",), ("a.png",), ("b.png",)], "source_id string"))
    rows = splits.manual_split(g, ["a"]).collect()
    assert {r.source_id for r in rows if r.role == "val"} == {"a.png"}


def test_manual_split_errors(groups):
    with pytest.raises(ValueError, match="at least one"):
        splits.manual_split(groups, [])
    with pytest.raises(ValueError, match="nobody, nothing"):
        splits.manual_split(groups, ["nothing", "scan 3", "nobody"])
    with pytest.raises(ValueError, match="no training"):
        splits.manual_split(groups, [f"scan {i}" for i in range(23)])


def test_fold_summary_counts_images_without_tiles(spark, groups):
    roles = splits.manual_split(groups, ["scan 3", "scan 4"])
    tiles = spark.createDataFrame([("scan 3.tif",)] * 5 + [("scan 1.tif",)] * 2, "source_id string")
    r = splits.fold_summary(tiles, roles).first()
    assert (r.train_images, r.val_images, r.train_tiles, r.val_tiles) == (21, 2, 2, 5)


def test_split_modes(groups):
    assert make_splits(groups, Config(split_mode="kfold", n_splits=3)).agg(F.count_distinct("fold")).first()[0] == 3
    with pytest.raises(ValueError, match="split mode"):
        make_splits(groups, Config(split_mode="random"))


def test_every_unknown_id_is_named(spark):
    groups = splits.distinct_groups(spark.createDataFrame([("a.png",), ("b.png",)], "source_id string"))
    wrong = [f"x{i}" for i in range(50)]
    assert {r.val_id for r in splits.unknown_ids(groups, ["a", *wrong]).collect()} == set(wrong)
    with pytest.raises(ValueError) as error:
        splits.manual_split(groups, ["a", *wrong])
    assert all(w in str(error.value) for w in wrong)
