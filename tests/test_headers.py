"""Sizes from headers: every format against files written here, few bytes read, broken files told."""

import os
import struct
import zlib

import numpy as np
import pytest

from sparktile.operators.kernels import png_bytes
from sparktile.sources import files, headers


def bmp(w, h):
    return b"BM" + struct.pack("<IHHI", 54 + 3 * w * h, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h, 1, 24, 0, 0, 0, 0, 0, 0) + b"\0" * (3 * w * h)


def old_bmp(w, h):
    return b"BM" + struct.pack("<IHHI", 26, 0, 0, 26) + struct.pack("<IHHHH", 12, w, h, 1, 32)


def jpeg(w, h, extra=0, channels=3, sof=0xC0):
    parts = b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", 65535) + b"\xff\xc0" * 32766 + b"x" for _ in range(extra))
    parts += b"\xff\xc4" + struct.pack(">H", 5) + b"abc" + b"\xff\xff\xff" + bytes([sof])
    return parts + struct.pack(">HBHHB", 8 + 3 * channels, 8, h, w, channels) + b"\0" * 3 * channels + b"\xff\xda" + b"\0" * 9000


def tiff(w, h, end="<", big=False, late=0, kind=4):
    form = {3: "H", 4: "I", 16: "Q"}[kind]
    tags = [(256, kind, w), (257, kind, h), (258, 3, 8), (277, 3, 3)]
    value = lambda k, v: struct.pack(end + {3: "H", 4: "I", 16: "Q"}[k], v).ljust(8 if big else 4, b"\0")
    if big:
        head = (b"II" if end == "<" else b"MM") + struct.pack(end + "HHHQ", 43, 8, 0, 16 + late)
        rows = b"".join(struct.pack(end + "HHQ", t, k, 1) + value(k, v) for t, k, v in tags)
        return head + b"p" * late + struct.pack(end + "Q", len(tags)) + rows
    head = (b"II" if end == "<" else b"MM") + struct.pack(end + "HI", 42, 8 + late)
    rows = b"".join(struct.pack(end + "HHI", t, k, 1) + value(k, v) for t, k, v in tags)
    return head + b"p" * late + struct.pack(end + "H", len(tags)) + rows


GOOD = {
    "a b.png": (png_bytes(np.random.default_rng(0).integers(0, 256, (700, 900, 3))), (900, 700, 3)), "grey.PNG": (png_bytes(np.zeros((3, 5))), (5, 3, 1)),
    "c.bmp": (bmp(60, 41), (60, 41, 3)), "old.bmp": (old_bmp(7, 9), (7, 9, 4)),
    "d.jpg": (jpeg(640, 480), (640, 480, 3)), "e.JPEG": (jpeg(65535, 1, extra=3, channels=1, sof=0xC2), (65535, 1, 1)),
    "f.tif": (tiff(320, 200), (320, 200, 3)), "g.tiff": (tiff(321, 201, ">", late=100_001), (321, 201, 3)),
    "h.tif": (tiff(90_000, 80_000, "<", big=True, late=77, kind=16), (90_000, 80_000, 3)), "i.tif": (tiff(12, 13, ">", kind=3), (12, 13, 3)),
}
BAD = {
    "empty.png": b"", "text.png": b"not an image", "cut.png": GOOD["a b.png"][0][:20], "cut.jpg": jpeg(5, 5, extra=1)[:3000], "scan.jpg": b"\xff\xd8\xff\xda\0\2" + b"x" * 99,
    "cut.tif": tiff(5, 5, late=50)[:60], "none.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 0, 4, 8, 2, 0, 0, 0) + struct.pack(">I", zlib.crc32(b"")),
}


@pytest.fixture()
def folder(tmp_path):
    for name, body in ({n: b for n, (b, _) in GOOD.items()} | BAD | {"notes.txt": b"x"}).items():
        (tmp_path / name).write_bytes(body)
    os.mkdir(tmp_path / "below.png")
    return str(tmp_path)


def test_sizes_of_all_formats(spark, folder):
    exts = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
    got = {r.source_id: r for r in headers.read_headers(spark, folder, exts, files_per_task=4).collect()}
    assert set(got) == set(GOOD) | set(BAD)
    for name, (body, size) in GOOD.items():
        assert (got[name].width, got[name].height, got[name].channels) == size, name
        assert got[name].stem == name.rsplit(".", 1)[0]
    for name in BAD:
        assert (got[name].width, got[name].height, got[name].channels) == (-1, -1, -1), name
    # pixels, metadata blocks and what stands before a late directory are not read
    assert all(r.bytes_read <= 6 * headers.CHUNK for r in got.values())
    assert got["a b.png"].bytes_read <= headers.CHUNK < len(GOOD["a b.png"][0]) / 1000


def test_one_file_and_no_files(spark, folder, tmp_path):
    one = headers.read_headers(spark, f"{folder}/a b.png").collect()
    assert [(r.source_id, r.width, r.height) for r in one] == [("a b.png", 900, 700)]
    os.mkdir(tmp_path / "none")
    assert headers.read_headers(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "_x.png").write_bytes(b"")
    with pytest.raises(ValueError, match="_x.png"):
        headers.read_headers(spark, str(tmp_path / "none"))


def test_records_from_headers(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(png_bytes(np.zeros((i + 1, 9))))
    (tmp_path / "broken.png").write_bytes(b"zz")
    found = headers.read_headers(spark, str(tmp_path))
    listed = files.list_images(spark, str(tmp_path)).select("source_id")
    assert sorted(tuple(r) for r in files.image_records(listed, found, drop_invalid=True).collect()) == [(f"{i}.png", 9, i + 1) for i in range(3)]
    with pytest.raises(Exception, match="unreadable image broken.png"):
        files.image_records(listed, found).collect()
    decoded = {r.source_id: (r.width, r.height) for r in files.read_images(spark, str(tmp_path)).collect()}
    assert decoded == {r.source_id: (r.width, r.height) for r in found.collect()}
