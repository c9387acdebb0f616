"""Committed files: PNGs from blocks equal to whole ones, replaced folders, failed jobs that leave no trace."""

import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktile.operators.kernels import png_bytes
from sparktile.sources import committed, files, headers


def test_checksums_add_up():
    rng = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 5), (5, 0), (100_000, 70_001), (1, 65_521)):
        a, b = (rng.integers(0, 256, k, dtype=np.uint8).tobytes() for k in (n, m))
        assert committed.add_checksums(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def blocks_of(spark, names, h, w, block):
    rows, rng, whole = [], np.random.default_rng(3), {}
    for name in names:
        prob, rgb = rng.random((h, w)).astype(np.float32), rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        mask = ((prob > 0.5) * 255).astype(np.uint8)
        whole[name] = (mask, rgb, np.floor(prob.astype(float) * 255).astype(np.uint8))
        for y in range(0, h, block):
            for x in range(0, w, block):
                at = np.s_[y : y + block, x : x + block]
                rows.append((name, w, h, y, x, *mask[at].shape, prob[at].tobytes(), mask[at].tobytes(), rgb[at].tobytes()))
    return spark.createDataFrame(rows, "stem string, width int, height int, y int, x int, h int, w int, prob binary, mask binary, overlay binary"), whole


@pytest.mark.parametrize("h,w,block", [(41, 30, 13), (5, 90, 32), (64, 64, 64)])
def test_rasters_from_blocks(spark, tmp_path, h, w, block):
    table, whole = blocks_of(spark, ["a b", "c"], h, w, block)
    out = str(tmp_path / "out")
    committed.write_block_rasters(table.repartition(9), out, ("mask", "overlay", "prob"))
    assert sorted(os.listdir(tmp_path)) == ["out"] and len(os.listdir(out)) == 6
    read = {r.source_id: r for r in files.read_images(spark, out).collect()}
    for name, layers in whole.items():
        for kind, want in zip(("mask", "overlay", "prob"), layers):
            got = np.frombuffer(bytes(read[f"{name}_{kind}.png"].data), np.uint8).reshape(want.shape)
            assert np.array_equal(got[..., ::-1] if kind == "overlay" else got, want)
    # the pixels' stream is one valid zlib stream, checksum included
    body = open(f"{out}/a b_mask.png", "rb").read()
    at, data = 8, b""
    while at < len(body):
        n, tag = struct.unpack(">I4s", body[at : at + 8])
        data += body[at + 8 : at + 8 + n] if tag == b"IDAT" else b""
        assert struct.unpack(">I", body[at + 8 + n : at + 12 + n])[0] == zlib.crc32(body[at + 4 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w + 1)
    assert (lines[:, 0] == 0).all() and np.array_equal(lines[:, 1:], whole["a b"][0])
    with pytest.raises(ValueError):
        committed.write_block_rasters(table, out, ("depth",))


def test_a_large_image_is_written_from_strips(spark, tmp_path):
    """12,000 x 16,000 (192 MB): no row holds more than a line of blocks."""
    h, w, block = 12_000, 16_000, 1000

    def paint(frames):
        for pdf in frames:
            for k in pdf.id:
                y, x = (int(v) * block for v in divmod(int(k), w // block))
                yy, xx = np.ogrid[y : y + block, x : x + block]
                yield pd.DataFrame({"stem": ["big"], "width": w, "height": h, "y": y, "x": x, "h": block, "w": block, "mask": [((yy // 100 + xx // 70) % 2 * 255).astype(np.uint8).tobytes()]})

    table = spark.range(0, h * w // block**2, 1, 8).mapInPandas(paint, "stem string, width int, height int, y int, x int, h int, w int, mask binary")
    committed.write_block_rasters(table, str(tmp_path / "out"), ("mask",))
    size = headers.read_headers(spark, str(tmp_path / "out")).first()
    assert (size.width, size.height, size.channels) == (w, h, 1)
    body, unpack, at, line, n = open(tmp_path / "out" / "big_mask.png", "rb").read(), zlib.decompressobj(), 8, b"", 0
    xx = np.arange(w) // 70
    while at < len(body):
        k, tag = struct.unpack(">I4s", body[at : at + 8])
        line += unpack.decompress(body[at + 8 : at + 8 + k]) if tag == b"IDAT" else b""
        full = len(line) // (w + 1)
        got = np.frombuffer(line, np.uint8, full * (w + 1)).reshape(full, w + 1)
        if full:
            assert np.array_equal(got[:, 1:], (np.arange(n, n + full)[:, None] // 100 + xx) % 2 * 255)
        line, n, at = line[full * (w + 1) :], n + full, at + 12 + k
    assert n == h and unpack.eof


def test_replacing_and_adding(spark, tmp_path):
    out = str(tmp_path / "deep" / "out")
    first = spark.createDataFrame([(f"{i}.bin", bytes([i]) * i) for i in range(30)] + [("none.bin", None)], "out_name string, content binary")
    committed.write_files(first.repartition(5), out)
    assert len(os.listdir(out)) == 31 and open(f"{out}/7.bin", "rb").read() == b"\x07" * 7 and os.path.getsize(f"{out}/none.bin") == 0
    more = spark.createDataFrame([("7.bin", b"new"), ("x.png", png_bytes(np.zeros((2, 3))))], "out_name string, content binary")
    committed.write_files(more, out)
    assert len(os.listdir(out)) == 32 and open(f"{out}/7.bin", "rb").read() == b"new"
    committed.write_files(more, out, replace=True)
    assert sorted(os.listdir(out)) == ["7.bin", "x.png"]
    committed.write_files(more.where("false"), out, replace=True)
    assert os.listdir(out) == [] and os.listdir(tmp_path / "deep") == ["out"]


@pytest.mark.parametrize("replace", [False, True])
def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path, replace):
    out = str(tmp_path / "out")
    frame = spark.range(0, 40, 1, 8).select(F.format_string("%d.bin", "id").alias("out_name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    committed.write_files(frame, out)
    broken = frame.withColumn("content", F.when(F.col("out_name") == "39.bin", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"changed")))
    with pytest.raises(Exception, match="lost"):
        committed.write_files(broken, out, replace=replace)
    assert sorted(os.listdir(out)) == sorted(f"{i}.bin" for i in range(40)) and open(f"{out}/3.bin").read() == "3"
    assert os.listdir(tmp_path) == ["out"]
