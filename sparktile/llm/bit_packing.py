"""Token-id output: ids in the fewest bits their vocabulary needs, in blocks that can be read alone.

The project's records hold class ids and run lengths rather than text tokens; ``pack_ids`` / ``unpack_ids`` serve those as
well (a mask's classes, the ``counts`` of a run-length segmentation).  The file writer takes any texts keyed by
``source_id``.

File format: Parquet rows called pages.  A page holds whole documents in order; ``payload`` is a sequence of blocks of
``BLOCK`` ids, ``bits`` per id, least significant bit first, every block starting on a byte; ``block_offsets[k]`` is the
byte where block k starts.  ``doc_starts[d]`` is the index in the page of the first id of document ``source_ids[d]``.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

BLOCK = 1024
KNOWN_PIECES = 600_000
KNOWN_LENGTH = 18  # longer pieces hardly come back
BYTES_AT_ONCE = 8 << 20
PIECES_AT_ONCE = 1 << 14


def bits_for(vocab_size: int) -> int:
    """Fewest bits that hold every id of the vocabulary, 1 to 32."""
    if not 1 <= vocab_size <= 1 << 32:
        raise ValueError(f"vocab_size must be within 1 and 2**32, got {vocab_size}")
    return max(1, (vocab_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Blocks of ``BLOCK`` ids, ``bits`` each, little bit order; the last block may be short. Fails on ids that need more bits."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, ids.size, 64 * BLOCK):  # BLOCK * bits is a multiple of 8, so chunks join without gaps
        part = ids[at : at + 64 * BLOCK]
        each = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        out.append(np.packbits(each.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def block_offsets(n_ids: int, bits: int) -> list[int]:
    """Byte at which each block starts."""
    return list(range(0, -(-n_ids // BLOCK) * BLOCK * bits // 8, BLOCK * bits // 8))


def unpack_ids(payload: bytes, bits: int, first: int, last: int, offsets: np.ndarray | list[int] | None = None) -> np.ndarray:
    """Ids [first, last): touches only the blocks that hold them."""
    if last <= first:
        return np.zeros(0, dtype="<u4")
    block = first // BLOCK
    start = block * BLOCK * bits // 8 if offsets is None else int(offsets[block])
    stop = start + ((last - block * BLOCK) * bits + 7) // 8
    raw = np.frombuffer(payload, dtype=np.uint8, count=min(stop, len(payload)) - start, offset=start)
    skip, n = first - block * BLOCK, last - first
    if bits in (8, 16, 32):
        return raw[skip * bits // 8 : (skip + n) * bits // 8].view(f"<u{bits // 8}").astype("<u4")
    raw = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    at = np.arange(skip, skip + n, dtype=np.int64) * bits
    byte = at >> 3
    word = np.zeros(n, dtype=np.uint64)
    for k in range(5):  # an id of up to 32 bits touches at most five bytes
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


# what a byte is part of, as far as that is certain from ASCII, Latin letters U+00C0 to U+017F and Cyrillic ones U+0400 to U+047F
UNSURE, LETTER, DIGIT, MARK, APOSTROPHE, BLANK = range(6)
BYTE_CLASS = np.zeros(256, dtype=np.uint8)
BYTE_CLASS[33:127] = MARK
BYTE_CLASS[ord("'")] = APOSTROPHE
BYTE_CLASS[48:58] = DIGIT
BYTE_CLASS[65:91] = BYTE_CLASS[97:123] = LETTER
BYTE_CLASS[9:14] = BYTE_CLASS[32] = BLANK
LETTER_LEADS = np.zeros(256, dtype=bool)
LETTER_LEADS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
BYTE_CLASS[LETTER_LEADS] = LETTER
# CUT_BETWEEN[8 * class before + class after]
CUT_BETWEEN = np.zeros(48, dtype=bool)
for _before, _after in ((LETTER, (DIGIT, MARK, APOSTROPHE, BLANK)), (DIGIT, (LETTER, MARK, APOSTROPHE, BLANK)), (MARK, (LETTER, DIGIT, BLANK)), (APOSTROPHE, (BLANK,))):
    CUT_BETWEEN[[8 * _before + k for k in _after]] = True
WIDE_BLANKS = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def cut_places(data: np.ndarray) -> np.ndarray:
    """Per byte of UTF-8 texts whether the byte-level regular expression surely ends a pre-token before it.

    A pre-token is a run of letters, of digits or of other visible characters, with at most one space (or, as in ``'s``, one
    apostrophe) before it, or white space; what follows white space may change it, what follows a visible character does not.
    """
    kind = BYTE_CLASS[data]
    lead = np.flatnonzero(LETTER_LEADS[data])
    signs = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))  # the times and division signs
    kind[lead + 1] = LETTER
    kind[lead[signs]] = kind[lead[signs] + 1] = UNSURE
    cut = np.zeros(data.size, dtype=bool)
    cut[1:] = CUT_BETWEEN[8 * kind[:-1] + kind[1:]]
    # other characters of several bytes are visible unless listed
    at = np.flatnonzero((kind[1:] == BLANK) & (data[:-1] >= 0x80) & (kind[:-1] == UNSURE)) + 1
    one, two, three = (data[at - k].astype(np.int64) for k in (1, 2, 3))
    blank = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | np.isin(three << 16 | two << 8 | one, WIDE_BLANKS)
    cut[at[~blank]] = True
    return cut


class PieceEncoder:
    """Encodes texts with a ``tokenizers`` file; remembers the ids of pieces it has seen.

    With the byte-level regular expression, a text's ids are those of its pieces cut at ``cut_places``, but never inside an
    added token's content.  Texts are cut and their pieces numbered some megabytes at a time, so that only the distinct pieces
    of these become Python strings and only those not seen before go to the library.  Other tokenizers encode whole texts.
    """

    _made: dict[str, "PieceEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_piece = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            and not spec.get("truncation") and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        )
        self.added = [t["content"].encode() for t in added]
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _raw(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), PIECES_AT_ONCE):
            found = self.tokenizer.encode_batch_fast(texts[at : at + PIECES_AT_ONCE], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in found]
        return out

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(self.known.get, pieces))
        gaps = [i for i, x in enumerate(found) if x is None]
        new = [pieces[i] for i in gaps]
        learnt = self._raw(new)
        for i, x in zip(gaps, learnt):
            found[i] = x
        if len(self.known) < KNOWN_PIECES:
            self.known.update((p, x) for p, x in zip(new, learnt) if len(p) <= KNOWN_LENGTH)
        return found

    def _encode_bytes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin at ``starts`` in ``data`` (the last entry is its end), and how many ids each has."""
        if not data.size:
            return np.zeros(0, dtype="<u4"), np.zeros(starts.size - 1, dtype=np.int64)
        cut = cut_places(data)
        whole = data.tobytes()
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                at = whole.find(token, at + 1)
        cut[starts[:-1][starts[:-1] < data.size]] = True
        places = np.append(np.flatnonzero(cut), data.size)
        pieces = pa.LargeStringArray.from_buffers(places.size - 1, pa.py_buffer(places), pa.py_buffer(whole)).dictionary_encode()
        found, which = self._look_up(pieces.dictionary.to_pylist()), pieces.indices.to_numpy()
        # int32 holds them all: a text has fewer bytes than that and no more ids than bytes
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[which]
        ends = np.cumsum(each, dtype=np.int32)
        take = np.repeat(first[which] - (ends - each), each)
        take += np.arange(take.size, dtype=np.int32)
        ids = np.frombuffer(b"".join(found), dtype="<u4")[take]
        before = np.append(ends - each, ends[-1])[np.searchsorted(places, starts)]
        return ids, np.diff(before).astype(np.int64)

    def encode_array(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In turn for some of the texts (no nulls): their ids, and how many ids each text has."""
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return
        _, places, data = texts.buffers()
        offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, side="right")) - 1)
            if self.by_piece:
                yield self._encode_bytes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            else:
                raw = self._raw(texts[at:to].to_pylist())
                yield np.frombuffer(b"".join(raw), dtype="<u4"), np.array([len(x) // 4 for x in raw], dtype=np.int64)
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for ids, counts in self.encode_array(pa.array(texts, pa.large_string())):
            out += [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
        return out


def page_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("bits", T.IntegerType()),
        T.StructField("n_ids", T.LongType()), T.StructField("source_ids", T.ArrayType(id_type)),
        T.StructField("doc_starts", T.ArrayType(T.LongType())), T.StructField("block_offsets", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ])


def write_token_pages(
    records: DataFrame, path: str, tokenizer_file: str, vocab_size: int, end_id: int | None = None,
    ids_per_page: int = 1 << 20, partitions: int | None = None,
) -> None:
    """Action: encode the texts of (source_id, text) and write them as pages, in ascending ``source_id`` order.

    Method: fixed-width bit packing in the minimum bits of ``vocab_size`` (raised by ``end_id`` if that is larger), with
    block offsets for random access.  Texts are dealt by ranges of the id, one range a shard, so a shard is one task and
    encodes each text once; the payload is never shuffled.  ``partitions`` (default: the session's shuffle partitions) is
    the number of ranges.

    Null text is an empty text; null ids come first; rows with equal ids are kept, ordered by a hash of their text.
    """
    bits = bits_for(max(vocab_size, (end_id or 0) + 1))
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select("source_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("source_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("source_id", "text")
    tail = np.array([] if end_id is None else [end_id], dtype="<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        encoder = PieceEncoder.of(tokenizer_file)
        shard, page = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list[pa.Array] = []
        counts: list[int] = []
        size = 0

        def one_list(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def flush() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            starts = list(accumulate((n + tail.size for n in counts), initial=0))[:-1]
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "page": pa.array([page], pa.int32()), "bits": pa.array([bits], pa.int32()),
                "n_ids": pa.array([whole.size], pa.int64()), "source_ids": one_list(pa.concat_arrays(keys)),
                "doc_starts": one_list(pa.array(starts, pa.int64())), "block_offsets": one_list(pa.array(block_offsets(whole.size, bits), pa.int64())),
                "payload": pa.array([pack_ids(whole, bits)], pa.binary()),
            })

        for batch in batches:
            names, row = batch.column("source_id"), 0
            for part, part_counts in encoder.encode_array(batch.column("text")):
                first, at = row, 0
                for n in part_counts.tolist():
                    ids += (part[at : at + n], tail)
                    counts.append(n)
                    row, at, size = row + 1, at + n, size + n
                    if size >= ids_per_page:
                        keys.append(names[first:row])
                        yield flush()
                        page, first, size, ids, keys, counts = page + 1, row, 0, [], [], []
                keys.append(names[first:row])
        if counts:
            yield flush()

    dealt.mapInArrow(pack, page_schema(records.schema["source_id"].dataType)).write.option("compression", "zstd").parquet(path)


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document: source_id, shard, page, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.

    Unpacks every payload; starts come from per-page counts: a running sum inside each shard plus one over shard totals
    (one row a shard).
    """
    pages = spark.read.parquet(path)
    id_type = pages.schema["source_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("source_id", id_type),
        T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                shard, page, bits, n_ids, payload = (row[c].as_py() for c in ("shard", "page", "bits", "n_ids", "payload"))
                raw = unpack_ids(payload, bits, 0, n_ids, row["block_offsets"].values.to_numpy()).tobytes()
                starts = np.append(row["doc_starts"].values.to_numpy(), n_ids)
                n, places = starts.size - 1, starts.tolist()
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(n, shard, dtype=np.int32)), "page": pa.array(np.full(n, page, dtype=np.int32)),
                    "source_id": row["source_ids"].values, "at": pa.array(starts[:-1]), "n_tokens": pa.array(np.diff(starts)),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(places, places[1:])], pa.int64()),
                })

    # a page is a large row: a few at a time
    docs = pages.select("shard", "page", "bits", "n_ids", "source_ids", "doc_starts", "block_offsets", "payload").mapInArrow(unpack, schema)
    sizes = pages.select("shard", "page", "n_ids")
    before = Window.partitionBy("shard").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = sizes.withColumn("in_shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    totals = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    shards = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = in_shard.join(shards, "shard").select("shard", "page", (F.col("before") + F.col("in_shard")).alias("page_start"))
    return docs.join(starts, ["shard", "page"]).select(
        "source_id", "shard", "page", (F.col("page_start") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
