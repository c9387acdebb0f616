"""Image sizes from file headers: a data source that reads the first bytes of each file and never its pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import stem
from ..operators.pairing import IMAGE_EXTENSIONS
from .files import hadoop_path, refuse_hidden
from .sinks import store_uri

FORMAT, CHUNK, FILES_PER_TASK = "raster_headers", 1024, 500
# Tags of the size in TIFF directories, and JPEG markers that start no frame or carry no length.
TIFF_WIDTH, TIFF_HEIGHT, TIFF_SAMPLES = 256, 257, 277
NO_FRAME, NO_LENGTH = {0xC4, 0xC8, 0xCC}, {0x01, *range(0xD0, 0xD9)}
PNG_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}


class Peek:
    """Random access that fetches a chunk at a time and counts what it fetched."""

    def __init__(self, file):
        self.file, self.length, self.chunks, self.read = file, file.size(), {}, 0

    def __call__(self, at: int, n: int) -> bytes:
        if at + n > self.length:
            raise ValueError("the file ends within its header")
        out = b""
        for k in range(at // CHUNK, (at + n - 1) // CHUNK + 1):
            if k not in self.chunks:
                self.chunks[k] = self.file.read_at(min(CHUNK, self.length - k * CHUNK), k * CHUNK)
                self.read += len(self.chunks[k])
            out += self.chunks[k]
        return out[at % CHUNK : at % CHUNK + n]


def _png(peek: Peek) -> tuple[int, int, int]:
    if peek(12, 4) != b"IHDR":
        raise ValueError("no image header")
    width, height, _, colour = struct.unpack(">IIBB", peek(16, 10))
    return width, height, PNG_CHANNELS[colour]


def _bmp(peek: Peek) -> tuple[int, int, int]:
    if struct.unpack("<I", peek(14, 4))[0] == 12:
        width, height, _, bits = struct.unpack("<HHHH", peek(18, 8))
    else:
        width, height, _, bits = struct.unpack("<iiHH", peek(18, 12))
    return width, abs(height), 4 if bits == 32 else 3


def _jpeg(peek: Peek) -> tuple[int, int, int]:
    at = 2
    while True:
        if peek(at, 1) != b"\xff":
            raise ValueError("no marker where one must be")
        marker = peek(at + 1, 1)[0]
        if marker == 0xFF:  # fill bytes may stand before a marker
            at += 1
        elif marker in NO_LENGTH:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in NO_FRAME:
            height, width, channels = struct.unpack(">HHB", peek(at + 5, 5))
            return width, height, channels
        elif marker in (0xD9, 0xDA):
            raise ValueError("no frame before the pixels")
        else:
            at += 2 + struct.unpack(">H", peek(at + 2, 2))[0]


def _tiff(peek: Peek) -> tuple[int, int, int]:
    end = "<" if peek(0, 2) == b"II" else ">"
    big = struct.unpack(end + "H", peek(2, 2))[0] == 43
    count, entry, value = ("Q", 20, 12) if big else ("H", 12, 8)
    at = struct.unpack(end + ("Q" if big else "I"), peek(8 if big else 4, 8 if big else 4))[0]
    n = struct.unpack(end + count, peek(at, struct.calcsize(count)))[0]
    at += struct.calcsize(count)
    found = {TIFF_SAMPLES: 1}
    for k in range(n):
        tag, kind = struct.unpack(end + "HH", peek(at + k * entry, 4))
        if tag in (TIFF_WIDTH, TIFF_HEIGHT, TIFF_SAMPLES) and kind in (3, 4, 16):
            form = {3: "H", 4: "I", 16: "Q"}[kind]
            found[tag] = struct.unpack(end + form, peek(at + k * entry + value, struct.calcsize(form)))[0]
    return found[TIFF_WIDTH], found[TIFF_HEIGHT], found[TIFF_SAMPLES]


def header(peek: Peek) -> tuple[int, int, int]:
    """(width, height, channels); ValueError and the like for what is no image of a known kind."""
    start = peek(0, min(8, peek.length))
    if start == b"\x89PNG\r\n\x1a\n":
        return _png(peek)
    if start[:2] == b"\xff\xd8":
        return _jpeg(peek)
    if start[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return _tiff(peek)
    if start[:2] == b"BM":
        return _bmp(peek)
    raise ValueError("no known image")


@dataclass
class Files(InputPartition):
    names: list[str]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.exts = options["folder"], tuple(e for e in options.get("exts", "").split(",") if e)
        self.single = options.get("single") == "true"
        self.per_task = int(options.get("files_per_task", FILES_PER_TASK))

    def partitions(self) -> list[Files]:
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(self.folder)
        if self.single:
            return [Files([""])]
        found = store.get_file_info(pafs.FileSelector(base))
        names = sorted(i.base_name for i in found if i.type == pafs.FileType.File)
        names = [n for n in names if not self.exts or n.lower().endswith(self.exts)]
        return [Files(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(self.folder)
        rows = []
        for name in partition.names:
            path = f"{base}/{name}" if name else base
            with store.open_input_file(path) as file:
                peek = Peek(file)
                try:
                    width, height, channels = header(peek)
                    if width < 1 or height < 1:
                        raise ValueError("no pixels")
                except (ValueError, KeyError, struct.error):
                    width = height = channels = -1
            rows.append((name or path.rsplit("/", 1)[-1], width, height, channels, peek.read))
        if rows:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["source_id", "width", "height", "channels", "bytes_read"])


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source_id string, width int, height int, channels int, bytes_read long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def read_headers(spark: SparkSession, path: str, exts=IMAGE_EXTENSIONS, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """source_id, stem, width, height, channels and bytes_read of the image files of a folder (or of one file, whatever its
    extension): PNG, JPEG, TIFF (also the 64-bit form) and BMP.

    Only headers are fetched, in chunks of 1 KB, so a task opens ``files_per_task`` files and moves a few KB for each; names are
    listed once by the driver. A file of another kind, or one that ends within its header, has width, height and channels -1:
    ``image_records`` raises on it or leaves it out. Hidden names make the listing fail, as they do for the other readers.
    """
    fs, where = hadoop_path(spark, path)
    single = fs.exists(where) and fs.getFileStatus(where).isFile()
    if not single:
        refuse_hidden(spark, path)
    spark.dataSource.register(HeaderSource)
    options = {"folder": store_uri(spark, path), "exts": ",".join(e.lower() for e in exts or ()), "single": str(single).lower(), "files_per_task": files_per_task}
    rows = spark.read.format(FORMAT).options(**options).load()
    return rows.select("source_id", stem(F.col("source_id")).alias("stem"), "width", "height", "channels", "bytes_read")
