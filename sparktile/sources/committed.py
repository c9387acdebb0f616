"""Files written as one commit: staged by tasks, put in place by the driver, gone without a trace when the job fails.

Rows carry files or pieces of files.  A PNG of any size is put together from strips that were compressed apart: each strip is a
run of deflate blocks that ends on a byte, so a writer only appends them and adds up their checksums.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .sinks import store_uri

FORMAT = "committed_files"
ADLER = 65521  # fixed value: modulus of the checksum at the end of a zlib stream
LAYERS = {"mask": (np.uint8, 1), "overlay": (np.uint8, 3), "prob": (np.float32, 1)}


def chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def add_checksums(first: int, second: int, length: int) -> int:
    """Adler-32 of two byte strings laid end to end, from those of each and the length of the second."""
    a, b = first & 0xFFFF, first >> 16
    c, d = second & 0xFFFF, second >> 16
    return (b + d + length * (a - 1)) % ADLER << 16 | (a + c - 1) % ADLER


def strip(lines: np.ndarray) -> tuple[bytes, int, int]:
    """(deflate blocks, Adler-32, length) of image lines (H, W, C), each behind a zero filter byte."""
    raw = np.concatenate([np.zeros((lines.shape[0], 1), np.uint8), lines.reshape(lines.shape[0], -1)], 1).tobytes()
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    return pack.compress(raw) + pack.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """Rows (name, seq, piece, adler, length, width, height, channels), the pieces of a file one after the other; a null width
    marks a file that is its pieces as they are."""

    def __init__(self, options: dict):
        self.folder, self.replace = options["folder"], options["replace"] == "true"
        self.job = uuid.uuid4().hex

    def _paths(self):
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(self.folder)
        base = base.rstrip("/")
        above, _, name = base.rpartition("/")
        return store, base, f"{above}/_staged-{name}-{self.job}", f"{above}/_parts-{name}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, _, staged, parts = self._paths()
        for folder in (staged, parts):
            store.create_dir(folder, recursive=True)
        names, out, now = [], None, None

        def finish():
            if out is not None:
                if now["width"] is not None:
                    out.write(chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + chunk(b"IEND", b""))
                out.close()
                store.move(part, f"{staged}/{now['name']}")  # a repeated task puts the same bytes there
                if not self.replace:  # else the folder is moved as a whole
                    names.append(now["name"])

        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                png = row["width"] is not None
                if now is None or row["name"] != now["name"] or not png:
                    finish()
                    now, part, adler = row, f"{parts}/{uuid.uuid4().hex}", 1
                    out = store.open_output_stream(part, compression=None)
                    if png:
                        head = struct.pack(">IIBBBBB", row["width"], row["height"], 8, 2 if row["channels"] == 3 else 0, 0, 0, 0)
                        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", b"\x78\x9c"))
                if png:
                    out.write(chunk(b"IDAT", row["piece"]))
                    adler = add_checksums(adler, row["adler"], row["length"])
                else:
                    out.write(row["piece"])
        finish()
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, base, staged, parts = self._paths()
        store.create_dir(staged, recursive=True)
        if self.replace:
            old = f"{staged}-old"
            if self._there(store, base):
                store.move(base, old)
            store.move(staged, base)
            self._drop(store, old)
        else:
            store.create_dir(base, recursive=True)
            names = sorted({n for m in messages if m for n in m.names})
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda n: store.move(f"{staged}/{n}", f"{base}/{n}"), names))
        self._drop(store, staged)
        self._drop(store, parts)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, staged, parts = self._paths()
        self._drop(store, staged)
        self._drop(store, parts)

    @staticmethod
    def _there(store, path: str) -> bool:
        from pyarrow import fs as pafs

        return store.get_file_info(path).type != pafs.FileType.NotFound

    def _drop(self, store, path: str) -> None:
        if self._there(store, path):
            store.delete_dir(path)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, seq int, piece binary, adler long, length long, width int, height int, channels int"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def _write(rows: DataFrame, path: str, replace: bool) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.write.format(FORMAT).options(folder=store_uri(spark, path), replace=str(replace).lower()).mode("append").save()


def write_files(files: DataFrame, path: str, name: str = "out_name", replace: bool = False) -> None:
    """Action: one file per row (``name``, content) into ``path``; with ``replace`` these files take the place of the folder.

    Nothing is seen under ``path`` before all files are written: tasks write to folders beside it, which the driver renames.  If
    the job fails, the folder is as it was. Of rows with one name one stays.
    """
    none = [F.lit(None).cast(k).alias(c) for c, k in (("adler", "long"), ("length", "long"), ("width", "int"), ("height", "int"), ("channels", "int"))]
    _write(files.select(F.col(name).alias("name"), F.lit(0).alias("seq"), F.coalesce("content", F.lit(b"")).alias("piece"), *none), path, replace)


def write_block_rasters(blocks: DataFrame, path: str, kinds: Sequence[str] = ("mask", "overlay"), name: str = "stem", replace: bool = False) -> None:
    """Action: <name>_<kind>.png for every image of a table of rendered blocks, as one commit; images may be of any size.

    Lines of blocks are joined and compressed apart, in as many tasks as there are lines of blocks; what then goes to the one
    task of a file is compressed strips in order, and that task holds one of them. ``prob`` is truncated to 255 * p. An empty
    table writes no file (and with ``replace`` leaves an empty folder).
    """
    kinds = list(kinds)
    unknown = set(kinds) - set(LAYERS)
    if unknown:
        raise ValueError(f"kinds must be among {tuple(LAYERS)}, got {sorted(unknown)}")

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["x"])
        first, out = rows[0], []
        for kind in kinds:
            form, c = LAYERS[kind]
            lines = np.concatenate([np.frombuffer(r[kind], form).reshape(r["h"], r["w"], c) for r in rows], 1)
            if kind == "prob":
                lines = np.floor(lines.astype(float) * 255.0).astype(np.uint8)
            piece, adler, length = strip(lines)
            out.append({"name": f"{first['name']}_{kind}.png", "seq": first["y"], "piece": piece, "adler": adler, "length": length, "width": first["width"], "height": first["height"], "channels": c})
        return pa.Table.from_pylist(out, schema=arrow)

    longs = {"adler": pa.int64(), "length": pa.int64(), "name": pa.string(), "piece": pa.binary()}
    arrow = pa.schema([pa.field(c, longs.get(c, pa.int32())) for c in ("name", "seq", "piece", "adler", "length", "width", "height", "channels")])
    rows = blocks.select(F.col(name).alias("name"), "width", "height", "y", "x", "h", "w", *kinds)
    strips = rows.groupBy("name", "y").applyInArrow(join, FileSink({}).schema())
    files = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _write(strips.repartition(files, "name").sortWithinPartitions("name", "seq"), path, replace)
