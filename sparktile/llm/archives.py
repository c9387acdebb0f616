"""WARC archives of files: a deterministic sharded writer and its reader.

Records are files as Spark's ``binaryFile`` source lists them (``path``, ``content``) with the project's key ``source_id``: image
and mask files go into archives as they are, web pages with their address as ``path``.

Method.  Records are range-sorted into shards whose bounds follow from the records alone; a shard rolls to the next file when
the compressed size is reached.  All headers are written anew and both digests recomputed.  Tasks write under private names in
a staging folder; when all have ended, the driver renames the files of the attempts that counted and writes a manifest, which
the reader goes by.  Equal records in equal shards give equal bytes, so file names carry a digest of their bytes and a rerun
gives the same names.
"""

from __future__ import annotations

import gzip
import json
import math
import uuid
import zlib
from base64 import b16decode, b32encode
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import sha1, sha256
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.functions import arrow_udf

from ..session import scratch_path
from ..sources.sinks import task_folder

FORMAT, MANIFEST = "warc_archives", "manifest.json"
FILE_BYTES, SHARD_BYTES, LEAST_SHARDS, KEYS_PER_SHARD = 256 << 20, 512 << 20, 32, 64
# Names of the archive format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# an id is quoted, so an asterisk is free to stand for null
NO_ID = "*"


def base32(hex_digest: str) -> str:
    return b32encode(b16decode(hex_digest, casefold=True)).decode()


def record_name(source_id, digest: str) -> str:
    return f"<urn:record:{NO_ID if source_id is None else quote(str(source_id), safe='')}:{digest}>"


def id_of(name: str) -> str | None:
    key = name.strip("<>").split(":")[2]
    return None if key == NO_ID else unquote(key)


def frame(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record with its length and block digest, as a gzip member of its own."""
    lines = [*headers, ("WARC-Block-Digest", "sha1:" + base32(sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def file_record(source_id, path: str | None, content: bytes, digest: str, media: str, date: str, original=None) -> bytes:
    """A response with its payload, or a revisit of ``original`` (source_id, path) with the headers of the response alone."""
    name = record_name(source_id, digest)
    address = lambda at, key: quote(at, safe="%/:=&?~#+!$,;'@()*[]") if at else key.strip("<>")  # noqa: E731  header lines are ASCII without breaks
    headers = [
        ("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date),
        ("WARC-Target-URI", address(path, name)), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if original is not None:
        first = record_name(original["source_id"], digest)
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", first), ("WARC-Refers-To-Target-URI", address(original["path"], first)), ("WARC-Refers-To-Date", date)]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {media}\r\nContent-Length: {len(content)}\r\n\r\n".encode()
    return frame(headers, http + (content if original is None else b""))


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of a compressed archive, one at a time; fails on a block that is not its digest's."""
    with gzip.GzipFile(fileobj=stream) as lines:
        while line := lines.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            headers = {}
            while (line := lines.readline().rstrip(b"\r\n")):
                key, _, value = line.decode().partition(":")
                headers[key.strip().lower()] = value.strip()
            block = lines.read(int(headers["content-length"]))
            if headers.get("warc-block-digest", (want := "sha1:" + base32(sha1(block).hexdigest()))) != want:
                raise ValueError(f"damaged record {headers.get('warc-record-id')}")
            yield headers, block


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Rolling:
    """Archives of one task: a new file for each shard and whenever the compressed size is reached."""

    def __init__(self, folder: str, staging: str, limit: int, date: str):
        from pyarrow import fs as pafs

        self.store, self.base = pafs.FileSystem.from_uri(folder)
        self.staging, self.limit, self.date, self.files = staging, limit, date, []
        self.out, self.shard, self.part = None, None, 0

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append(self.now | {"sha256": self.digest.hexdigest()})
            self.out = None

    def add(self, shard: int, body: bytes, source_id) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.out is None:
            self.now = {"shard": shard, "part": self.part, "staged": f"{self.staging}/{uuid.uuid4().hex}", "bytes": 0, "records": 0, "first": None if source_id is None else str(source_id)}
            self.out, self.digest = self.store.open_output_stream(f"{self.base}/{self.now['staged']}"), sha256()
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{shard}:{self.part}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")]
            self._write(frame(about, b"format: WARC File Format 1.1\r\n"))
        self._write(body)
        self.now["records"] += 1
        if self.now["bytes"] >= self.limit:
            self.close()
            self.part += 1

    def _write(self, body: bytes) -> None:
        self.out.write(body)
        self.digest.update(body)
        self.now["bytes"] += len(body)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.limit, self.media, self.date = options["folder"], int(options["file_bytes"]), options["media"], options["date"]
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs as pafs

        return pafs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = self._store()
        store.create_dir(f"{base}/{self.staging}", recursive=True)
        rolling = Rolling(self.folder, self.staging, self.limit, self.date)
        for batch in iterator:
            for shard, source_id, path, content, digest, original in zip(*[batch.column(c) for c in ("shard", "source_id", "path", "content", "digest", "original")]):
                key = source_id.as_py()
                body = file_record(key, path.as_py(), content.as_py(), base32(digest.as_py()), self.media, self.date, original.as_py())
                rolling.add(shard.as_py(), body, key)
        rolling.close()
        return Written(rolling.files)

    def commit(self, messages: list[Written | None]) -> None:
        """Rename what the tasks that counted have staged, then put the manifest in place; only then do older files go."""
        store, base = self._store()
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["shard"], f["part"]))
        for f in files:
            f["name"] = f"part-{f['shard']:05d}-{f['part']:04d}-{f['sha256'][:16]}.warc.gz"
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: store.move(f"{base}/{f['staged']}", f"{base}/{f['name']}"), files))
        keep = {f["name"] for f in files} | {MANIFEST}
        body = json.dumps({"files": [{k: f[k] for k in ("name", "bytes", "records", "sha256", "first")} for f in files]}, indent=1)
        with store.open_output_stream(f"{base}/{self.staging}-manifest") as out:
            out.write(body.encode())
        store.move(f"{base}/{self.staging}-manifest", f"{base}/{MANIFEST}")
        from pyarrow import fs as pafs

        for info in store.get_file_info(pafs.FileSelector(base)):
            if info.type == pafs.FileType.File and info.base_name.endswith(".warc.gz") and info.base_name not in keep:
                store.delete_file(info.path)
        self._unstage(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._unstage(*self._store())

    def _unstage(self, store, base: str) -> None:
        from pyarrow import fs as pafs

        if store.get_file_info(f"{base}/{self.staging}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.staging}")


@dataclass
class Archive(InputPartition):
    name: str


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.payload = options["folder"], options.get("payload", "true") == "true"

    def partitions(self) -> list[Archive]:
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{base}/{MANIFEST}") as f:
            return [Archive(x["name"]) for x in json.loads(f.read())["files"]] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        if not partition.name:
            return
        store, base = pafs.FileSystem.from_uri(self.folder)
        rows, size = [], 0
        with store.open_input_stream(f"{base}/{partition.name}", compression=None) as stream:
            for headers, block in read_records(stream):
                if headers["warc-type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                digest, kept = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"] == "response"
                if kept and base32(sha1(payload).hexdigest()) != digest:
                    raise ValueError(f"damaged payload in {headers['warc-record-id']}")
                refers = headers.get("warc-refers-to")
                rows.append((
                    id_of(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"], digest, int(fields["Content-Length"]),
                    id_of(refers) if refers else None, partition.name, payload if kept and self.payload else None,
                ))
                size += len(payload)
                if len(rows) == 1000 or size >= 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _ARROW)], names=[n for n, _ in _FIELDS])
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _ARROW)], names=[n for n, _ in _FIELDS])


_FIELDS = (
    ("source_id", "string"), ("address", "string"), ("record_type", "string"), ("payload_digest", "string"), ("payload_bytes", "long"),
    ("refers_to", "string"), ("archive", "string"), ("content", "binary"),
)
_ARROW = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t] for _, t in _FIELDS]


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in _FIELDS)

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def shard_bounds(narrow: DataFrame, shards: int) -> list[tuple]:
    """The keys (null flag, source_id, tie) at which shards 1, 2, ... start, so that each holds about the same bytes.

    Taken from about ``KEYS_PER_SHARD`` keys a shard, picked by a hash of the key: the bounds depend on the records alone, and
    the driver reads that many narrow rows at most, give or take chance, whatever the input.  Shards 1, 2, ... may be empty.
    """
    n = narrow.count()
    share = min(1.0, shards * KEYS_PER_SHARD / n) if n else 1.0
    picked = narrow.where(F.pmod(F.xxhash64("source_id", "tie"), F.lit(1 << 30)) < F.lit(share) * (1 << 30))
    keys = picked.groupBy(F.col("source_id").isNull().alias("absent"), "source_id", "tie").agg(F.sum("n_bytes").alias("n"))
    rows, total, bounds, upto = keys.orderBy("absent", "source_id", "tie").collect(), 0, [], 0
    total = sum(r.n + 1 for r in rows)
    for r in rows:
        if len(bounds) + 1 < shards and upto * shards >= total * (len(bounds) + 1):
            bounds.append((r.absent, 0 if r.absent else r.source_id, r.tie))
        upto += r.n + 1
    return bounds


def write_archives(
    files: DataFrame, path: str, least_bytes: int = 0, media: str = "application/octet-stream", date: str = "1970-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS,
) -> None:
    """Action: writes (source_id, path, content) as compressed archives with a manifest into folder ``path``.

    Of files with equal contents of at least ``least_bytes`` bytes, the one with the largest source_id is a response; the
    others revisit it and store no payload.  Smaller ones are all responses.  Shards hold about ``shard_bytes`` of content, but
    there are ``least_shards`` at least; files roll at ``file_bytes`` compressed.  A task holds one record and one batch.

    A failed or repeated task leaves only staged files, which no reader sees; a folder that was written before keeps its old
    manifest until the new one is in place.

    A null content is empty; a null path stands for the record's own name; addresses are percent-escaped where a header needs
    it.  Null ids come last and are responses only where no equal content has an id.  Rows that share the largest id and the
    content are all responses; rows that share an id are sorted by a hash of path and content, so that a frequent id spreads
    over shards (wholly equal rows stay in one).  An empty table gives a manifest without files.  Other columns are ignored.
    """
    spark = files.sparkSession
    content = F.coalesce("content", F.lit(b""))
    rows = files.select("source_id", "path", content.alias("content"), F.sha1(content).alias("digest"), F.length(content).cast("long").alias("n_bytes"))
    rows = rows.withColumn("tie", F.xxhash64("path", "digest"))
    narrow_path, twice_path = scratch_path(spark, "archive-keys"), scratch_path(spark, "archive-repeats")
    rows.drop("content").write.parquet(narrow_path)
    narrow = spark.read.parquet(narrow_path)
    largest = F.max(F.when(F.col("source_id").isNotNull(), F.struct("source_id", "path"))).alias("original")
    same = narrow.where(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes").agg(largest, F.count("*").alias("n"))
    same.where("n > 1").select(F.col("digest").alias("d"), F.col("n_bytes").alias("b"), "original").write.parquet(twice_path)
    shards = max(least_shards, math.ceil((narrow.agg(F.sum("n_bytes")).first()[0] or 0) / shard_bytes))
    bounds = spark.sparkContext.broadcast(shard_bounds(narrow, shards))

    @arrow_udf("int")
    def shard_of(source_id: pa.Array, tie: pa.Array) -> pa.Array:
        keys = ((x is None, 0 if x is None else x, t) for x, t in zip(source_id.to_pylist(), tie.to_pylist()))
        return pa.array([bisect_right(bounds.value, k) for k in keys], type=pa.int32())

    twice = spark.read.parquet(twice_path)
    joined = rows.join(twice, (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("b")), "left")
    first = F.col("original").isNull() | F.col("source_id").eqNullSafe(F.col("original.source_id"))
    judged = joined.select(
        shard_of("source_id", "tie").alias("shard"), "source_id", "path", "content", "digest", F.when(~first, F.col("original")).alias("original"), "tie"
    )
    laid = judged.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("source_id").asc_nulls_last(), "tie", "path")
    spark.dataSource.register(ArchiveSource)
    options = {"folder": task_folder(spark, path), "file_bytes": file_bytes, "media": media, "date": date}
    laid.drop("tie").write.format(FORMAT).options(**options).mode("append").save()


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives that the manifest names, one task a file: source_id (as text), address, record_type,
    payload_digest (base32 SHA-1), payload_bytes, refers_to, archive and content (null for revisits, or without ``payload``).

    Digests are checked; a damaged record fails the job.
    """
    spark.dataSource.register(ArchiveSource)
    options = {"folder": task_folder(spark, path), "payload": str(payload).lower()}
    return spark.read.format(FORMAT).options(**options).load()
