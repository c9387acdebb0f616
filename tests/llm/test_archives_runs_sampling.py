"""Archives, importance resampling and periodic runs: brute force, round trips, odd inputs."""

import gzip
import json
import math
import os
import random
from collections import Counter
from hashlib import sha1, sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktile.llm import archives
from sparktile.llm.archives import base32, read_archives, read_records, write_archives
from sparktile.llm.importance import feature_buckets, kth_key, resample
from sparktile.llm.periodic_runs import Places, may_repeat, periodic_runs, runs_of
from sparktile.session import scratch_path

# ---- periodic runs


def slow_runs(items, least):
    """By definition: every stretch with period q that cannot be extended, once, with its smallest period."""
    n, seen = len(items), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            first = i
            while i + q < n and items[i] == items[i + q]:
                i += 1
            if i - first + q >= max(least, 2 * q):
                seen.setdefault((first, i - first + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def slow_collapse(items, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(items) if i not in gone]


def odd_sequence(rng):
    n, letters = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 6])
    items = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        items = (items[: rng.randrange(1, n // 2 + 2)] * n)[:n]
    if n and rng.random() < 0.4:
        items[rng.randrange(n)] = 9
    return items


def test_runs_equal_brute_force():
    rng = random.Random(13)
    for _ in range(1500):
        items, least = odd_sequence(rng), rng.choice([2, 3, 5, 12])
        if not items:
            continue
        want, ids = slow_runs(items, least), np.array(items)
        assert runs_of(ids, least) == want
        assert not want or may_repeat(ids, np.array([len(items)]), least)[0]


def test_position_sets_stay_ordered():
    rng = random.Random(2)
    values = rng.sample(range(10**6), 9000)
    places, held = Places(values[0]), [values[0]]
    for x in values[1:]:
        if len(held) % 500 == 0:
            held.sort()
            smaller, larger = [y for y in held if y < x], [y for y in held if y > x]
            assert places.neighbours(x) == (smaller[-1] if smaller else -1, larger[0] if larger else -1)
        places.add(x)
        held.append(x)
    assert list(places) == sorted(values) and places.size == len(values) and len(places.blocks) > 3


def test_runs_of_segmentation_counts(spark):
    """Run lengths of an annotation's segmentation: nulls, empty lists, null items, repeated rows, clashing columns."""
    rng = random.Random(5)
    data = [(f"img{i}.png", odd_sequence(rng), "x", "x") for i in range(200)]
    data += [(None, [7] * 30, "x", "x"), ("none.png", None, "x", "x"), ("empty.png", [], "x", "x"), ("gaps.png", [None, 4] * 10, "x", "x"), data[3], data[3]]
    frame = spark.createDataFrame(data, "source_id string, counts array<long>, runs string, k0 string")
    got = Counter((r.source_id, r.n_items, tuple(map(tuple, r.runs)), tuple(r.collapsed)) for r in periodic_runs(frame.repartition(5)).collect())
    want = Counter()
    for key, items, *_ in data:
        found = slow_runs(items or [], 12)
        want[(key, len(items or []), tuple(found), tuple(slow_collapse(items or [], found)))] += 1
    assert got == want
    assert periodic_runs(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame, min_length=1)


def test_runs_of_texts(spark, monkeypatch):
    monkeypatch.setattr("sparktile.llm.periodic_runs.BYTES_AT_ONCE", 64)
    words = ["a", "é\u00a0b", "c,", "d\u2003e"]
    texts = [" ".join(words * 9) + "\n\tend", None, "", " \r\n", "x " * 400_000, "one two"]
    frame = spark.createDataFrame(list(enumerate(texts)), "source_id long, caption string")
    got = {r.source_id: r for r in periodic_runs(frame, "caption").collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 36, 4)] and got[0].collapsed == " ".join(words) + " end"
    assert [(got[i].n_items, got[i].runs, got[i].collapsed) for i in (1, 2, 3)] == [(0, [], "")] * 3
    assert [tuple(x) for x in got[4].runs] == [(0, 400_000, 1)] and got[4].collapsed == "x"
    assert got[5].runs == [] and got[5].collapsed == "one two"


# ---- importance resampling


def test_kth_key_by_random_pivots(spark):
    rng = random.Random(7)
    data = [(rng.choice([1, 1, 1, rng.randrange(300)]), rng.choice([None, "a", f"k{rng.randrange(40)}"])) for _ in range(2000)]
    frame = spark.createDataFrame(data, "worse long, source_id string").withColumn("absent", F.col("source_id").isNull().cast("int"))
    order = sorted((w, int(s is None), s or "") for w, s in data)
    for k in (1, 2, 777, 1400, 2000):
        worse, absent, key = kth_key(frame, ["worse", "absent", "source_id"], k, seed=k, pivots=4)
        assert (worse, absent, key or "") == order[k - 1]
    assert kth_key(frame, ["worse", "absent", "source_id"], 2001) is None


def slow_resample(records, target, percent, least, buckets, longest, seed):
    def features(value):
        return [" ".join(value[i : i + n]) for n in range(1, longest + 1) for i in range(len(value) - n + 1)]

    place = lambda f: crc32(f.encode()) % buckets
    s, t = Counter(place(f) for _, v in records for f in features(v)), Counter(place(f) for v in target for f in features(v))
    big, small = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for key, v in records:
        fs = features(v)
        weight = sum(math.floor(1000 * math.log((t[place(f)] + 1) * big / ((s[place(f)] + 1) * small))) for f in fs)
        h = int(sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(v)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or ""))
    drawn = able[: percent * len(able) // 100]
    return Counter([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in (Counter(out) - Counter(drawn)).elements()])


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_of_annotation_labels(spark, longest):
    """Images by the class names of their annotations: ties, repeated rows, null keys and lists, clashing columns."""
    rng = random.Random(longest)
    names = ["crack", "root", "vessel", "Cell wall", "stone", "naïve"]
    records = [(f"img{i}.png", [rng.choice(names) for _ in range(rng.randrange(0, 12))]) for i in range(400)]
    records += [records[0]] * 3 + [(None, ["root"] * 9), ("none.png", [])]
    target = [[rng.choice(names[:2]) for _ in range(6)] for _ in range(30)]
    rows = [(k, v if k != "none.png" else None, "x", "x") for k, v in records]
    frame = spark.createDataFrame(rows, "source_id string, labels array<string>, weight string, tie string")
    aim = spark.createDataFrame([(v,) for v in target], "labels array<string>")
    got = Counter(map(tuple, resample(frame.repartition(6), aim, percent=30, least=3, buckets=97, longest=longest, seed=5).collect()))
    assert got == slow_resample(records, target, 30, 3, 97, longest, 5)
    assert resample(frame.where("false"), aim).count() == 0
    assert {r.rank for r in resample(frame, aim.where("false"), least=99).collect()} == {None}


def test_features_of_long_texts(monkeypatch):
    monkeypatch.setattr("sparktile.llm.importance.SLICE", 10)
    text = "Ab cd-ef  gh1 é_ñ " * 20 + "x" * 35
    words = ["ab", "cd", "ef", "gh1", "é", "ñ"] * 20 + ["x" * 35]
    n, places = feature_buckets(text, 1000, 3)
    want = Counter(crc32(" ".join(words[i : i + k]).encode()) % 1000 for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert n == len(words) and Counter(places.tolist()) == want
    assert feature_buckets(None, 10, 1)[0] == 0 and feature_buckets("", 10, 2)[1].size == 0


# ---- archives


FILES = "source_id string, path string, content binary, digest string, shard string"


def some_files(n=120):
    rng = random.Random(3)
    body = lambda i: bytes(rng.randrange(256) for _ in range(300)) + str(i).encode()
    rows = [(f"img{i:03d}.png", f"/data/images/img {i}.png", b"same bytes" if i % 3 == 0 else body(i), "x", "x") for i in range(n)]
    return rows + [(None, None, b"same bytes", "x", "x"), ("zero.png", "/é\r\nX: 1", None, "x", "x"), ("zero2.png", "", b"", "x", "x"), rows[1], rows[1], ("img001.png", "/other", b"other", "x", "x")]


def local(path):
    return path.removeprefix("file:").replace("///", "/")


def test_archives_round_trip(spark):
    rows = some_files()
    frame = spark.createDataFrame(rows, FILES)
    path = scratch_path(spark, "archives")
    write_archives(frame.repartition(4), path, media="image/png", file_bytes=2000, least_shards=5)
    got = read_archives(spark, path).collect()
    last = {}
    for key, _, content, *_ in rows:
        if key is not None:
            last[content or b""] = max(key, last.get(content or b"", ""))
    want = Counter()
    for key, _, content, *_ in rows:
        body = content or b""
        first = last.get(body) in (None, key)
        want[(key, "response" if first else "revisit", base32(sha1(body).hexdigest()), len(body), None if first else last[body], body if first else None)] += 1
    as_row = lambda r: (r.source_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, None if r.content is None else bytes(r.content))
    assert Counter(map(as_row, got)) == want
    names = {r.archive for r in got}
    listed = json.load(open(f"{local(path)}/manifest.json"))["files"]
    assert {f["name"] for f in listed} == names == set(os.listdir(local(path))) - {"manifest.json"} and len(names) > 5
    assert sum(f["records"] for f in listed) == len(rows)
    for f in listed:  # every record opens alone, and files roll soon after the limit
        body = open(f"{local(path)}/{f['name']}", "rb").read()
        assert sha256(body).hexdigest() == f["sha256"] and len(body) == f["bytes"] < 2000 + 2000
        ids = [h["warc-record-id"] for h, _ in read_records(open(f"{local(path)}/{f['name']}", "rb"))]
        assert len(ids) == f["records"] + 1
        assert all("\r" not in h for h in ids)
    # the same records, laid out otherwise, give the same files
    again = scratch_path(spark, "archives")
    write_archives(frame.orderBy(F.rand(1)).repartition(9), again, media="image/png", file_bytes=2000, least_shards=5)
    assert set(os.listdir(again.removeprefix("file:"))) == set(os.listdir(local(path)))
    keys = [r.source_id for r in sorted(got, key=lambda r: r.archive) if r.source_id]
    assert sorted(keys) == [r.source_id for f in listed for r in got if r.archive == f["name"] and r.source_id]


def test_archives_small_contents_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a", b"xx"), (2, "b", b"xx"), (3, "c", b"longer"), (4, "d", b"longer")], "source_id long, path string, content binary")
    path = scratch_path(spark, "archives")
    write_archives(frame, path, least_bytes=3, least_shards=2)
    back = {r.source_id: (r.record_type, r.refers_to) for r in read_archives(spark, path, payload=False).collect()}
    assert back == {"1": ("response", None), "2": ("response", None), "3": ("revisit", "4"), "4": ("response", None)}
    write_archives(frame.where("false"), path)  # a later write takes the place of the earlier one
    assert read_archives(spark, path).count() == 0 and os.listdir(local(path)) == ["manifest.json"]


def test_failed_write_leaves_the_old_archives(spark):
    frame = spark.createDataFrame([(i, "p", f"text {i}".encode()) for i in range(50)], "source_id long, path string, content binary")
    path = scratch_path(spark, "archives")
    write_archives(frame, path, least_shards=3)
    before = sorted(os.listdir(local(path)))
    broken = frame.withColumn("path", F.when(F.col("source_id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.lit("q")))
    with pytest.raises(Exception):
        write_archives(broken, path, least_shards=3)
    staged = archives.ArchiveWriter({"folder": "file://" + local(path), "file_bytes": "100", "media": "m", "date": "d"})
    store, base = staged._store()
    store.create_dir(f"{base}/{staged.staging}")
    staged.abort([])
    assert sorted(os.listdir(local(path))) == before and read_archives(spark, path).count() == 50


def test_damage_is_found(tmp_path):
    body = archives.file_record("a", "/x", b"payload", base32(sha1(b"payload").hexdigest()), "m", "d")
    whole = gzip.decompress(body)
    file = tmp_path / "bad.warc.gz"
    file.write_bytes(gzip.compress(whole.replace(b"payload", b"paYload")))
    with pytest.raises(ValueError), open(file, "rb") as f:
        list(read_records(f))
