"""Documents cut at any byte: the same elements as a JSON parser, and one document over many tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparktile.sources import coco
from sparktile.sources.json_ranges import array_elements, range_index

NASTY = ['"', "\\", "\\\\", '\\"', "{", "}", "[", "]", ":", ",", "é", "\U0001f600", "images", '"images":[{', "\n", "\\u0022", ""]


def text(rng):
    return "".join(rng.choice(NASTY) for _ in range(rng.randrange(5)))


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind == 5:
        return {text(rng) + str(i): value(rng, depth + 1) for i in range(rng.randrange(3))}
    return [text(rng), rng.randrange(99), None, 1.5][kind]


def document(rng):
    out = [("info", {"images": [{"id": -1}], "x": value(rng)}), ("licenses", [value(rng) for _ in range(2)])]
    for name in ("images", "annotations", "categories"):
        out.append((name, [{"id": i, text(rng) + "k": value(rng), "images": value(rng)} for i in range(rng.randrange(7))]))
    rng.shuffle(out)
    return dict(out)


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 100_000])
def test_elements_equal_the_parsers(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    docs = {}
    for i in range(12 if range_bytes > 1 else 2):
        docs[f"d {i}.json"] = doc = document(rng)
        body = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")]))
        (tmp_path / f"d {i}.json").write_bytes(body.encode())
    (tmp_path / "empty.json").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    index = range_index(files, ["images", "annotations", "categories"], range_bytes)
    for name in ("images", "annotations", "categories"):
        got = {}
        for r in sorted(array_elements(index, name, 5).collect(), key=lambda r: r.pos):
            got.setdefault(r.path.rsplit("/", 1)[-1], []).append(json.loads(r.text))
        assert got == {k: d[name] for k, d in docs.items() if d[name]}


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    n = 20_000
    doc = {"images": [{"id": i, "file_name": f"{i}.jpg", "width": 4, "height": 4} for i in range(n)], "categories": [{"id": 1, "name": "a"}]}
    doc["annotations"] = [{"image_id": i, "category_id": 1, "segmentation": [[0, 0, 1, 1, i % 7, 2]]} for i in range(n)]
    for below in ("annotations", "images/default"):
        (tmp_path / "one batch" / below).mkdir(parents=True)
    (tmp_path / "one batch" / coco.DOCUMENT).write_text(json.dumps(doc))
    (tmp_path / "one batch" / coco.IMAGES / "0.jpg").write_bytes(b"x")
    (tmp_path / "no images" / "annotations").mkdir(parents=True)
    (tmp_path / "no images" / coco.DOCUMENT).write_text(json.dumps(doc))
    images, annotations, categories = coco.read_coco_exports(spark, str(tmp_path), range_bytes=100_000)
    assert images.count() == annotations.count() == n and categories.count() == 1
    assert {r.batch for r in images.select("batch").distinct().collect()} == {"one batch"}
    per_task = annotations.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) >= 6 and max(r["count"] for r in per_task) < n / 3
    assert images.agg(F.sum("image_id")).first()[0] == n * (n - 1) // 2
    assert [r.image_id for r in images.orderBy("pos").limit(50).collect()] == list(range(50))
    assert annotations.where("image_id = 5").first().segmentation == "[[0,0,1,1,5,2]]"


def test_image_folders_are_listed_by_tasks(spark, tmp_path):
    for batch, names in (("a b", ["x.jpg", "y 1.png", "z%20.tif"]), ("c", [])):
        folder = tmp_path / batch / "images" / "default"
        (folder / "below").mkdir(parents=True)
        (folder / "below" / "deep.jpg").write_bytes(b"-")
        for name in names:
            (folder / name).write_bytes(b"+")
    listed = coco.image_files(spark, str(tmp_path))
    assert "binaryfile" not in listed._jdf.queryExecution().toString().lower()
    got = sorted((r.batch, r.name, r.stem) for r in listed.collect())
    assert got == [("a b", "x.jpg", "x"), ("a b", "y 1.png", "y 1"), ("a b", "z%20.tif", "z%20")]
    flat = spark.read.format("binaryFile").load(f"{tmp_path}/*/{coco.IMAGES}").select("path").collect()
    assert sorted(r.path for r in listed.select("path").collect()) == sorted(r.path for r in flat)


def test_small_documents_share_tasks(spark):
    from sparktile.sources import json_ranges

    tiny = spark.range(200).selectExpr("cast(id as string) as path", "0L as start", "1000L as stop")
    assert json_ranges.spread_ranges(tiny).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = tiny.withColumn("stop", F.lit(json_ranges.RANGE_BYTES).cast("long"))
    assert json_ranges.spread_ranges(whole).rdd.getNumPartitions() == 200
    assert json_ranges.spread_ranges(tiny.limit(0)).rdd.getNumPartitions() == 1
