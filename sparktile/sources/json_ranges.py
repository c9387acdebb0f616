"""Large JSON documents read by many tasks: the elements of top-level arrays, found per byte range.

A range cannot tell alone whether it starts inside a string, nor how deep.  So each is first summed up for both cases: how many
quotes it has, how far it moves the depth, and which keys it holds at which relative depth.  A running sum over the ranges of a
document composes these into every range's true start, and then each range is read on its own: it gives the elements that begin
in it and reads on only to the end of the last one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .sinks import open_store

RANGE_BYTES, LOOK_BACK, READ_ON, MOST_TASKS = 16 << 20, 1 << 16, 1 << 20, 10_000
QUOTE, BACKSLASH, COLON, OPEN, CLOSE = b'"'[0], b"\\"[0], b":"[0], b"{"[0], b"}"[0]
_STEP = np.zeros(256, np.int8)
_STEP[[OPEN, b"["[0]]], _STEP[[CLOSE, b"]"[0]]] = 1, -1
_SEEN = (_STEP != 0) | (np.arange(256) == COLON)


def quotes_of(buf: np.ndarray) -> np.ndarray:
    """Places of quotes that no backslash escapes; the buffer must not start within a run of backslashes."""
    quotes, back = np.flatnonzero(buf == QUOTE), np.flatnonzero(buf == BACKSLASH)
    if not back.size:
        return quotes
    ends = np.flatnonzero(np.append(np.diff(back) > 1, True))
    size = np.diff(np.append(-1, ends))  # of each run of backslashes
    last = back[ends]
    k = np.searchsorted(last, quotes - 1)
    before = (k < last.size) & (last[np.minimum(k, last.size - 1)] == quotes - 1)
    return quotes[~(before & (size[np.minimum(k, last.size - 1)] % 2 == 1))]


class Scan:
    """Structure of ``buf`` from ``begin`` on; what stands before is only looked at for keys and escapes."""

    def __init__(self, buf: bytes, begin: int):
        self.raw = np.frombuffer(buf, np.uint8)
        self.buf, self.begin = buf, begin
        self.quotes = quotes_of(self.raw)
        self.inside = self.quotes[self.quotes >= begin]
        self.marks = np.flatnonzero(_SEEN[self.raw[begin:]]) + begin
        self.rank = np.searchsorted(self.inside, self.marks)

    def outside(self, in_string: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, relative depth after each) of brackets and colons outside of strings."""
        at = self.marks[(self.rank + in_string) % 2 == 0]
        return at, np.cumsum(_STEP[self.raw[at]], dtype=np.int64)

    def key(self, colon: int) -> str:
        k = int(np.searchsorted(self.quotes, colon))
        return self.buf[self.quotes[k - 2] + 1 : self.quotes[k - 1]].decode("utf-8", "replace") if k >= 2 else ""

    def summary(self, in_string: int, wanted: Sequence[str]) -> tuple[int, list]:
        """(change of depth, [(relative depth, {last: key, wanted: [...]})] of keys that may be at the top)."""
        at, depth = self.outside(in_string)
        colons = self.raw[at] == COLON
        places, depths = at[colons], depth[colons]
        sizes = {len(w.encode()) for w in wanted}
        k = np.searchsorted(self.quotes, places)
        long = np.where(k >= 2, self.quotes[np.maximum(k - 1, 0)] - self.quotes[np.maximum(k - 2, 0)] - 1, -1) if self.quotes.size else np.full(k.size, -1)
        out = []
        for d in np.unique(depths[depths <= 1]).tolist():
            here = depths == d
            likely = places[here & np.isin(long, list(sizes))]
            names = {self.key(int(p)) for p in likely} & set(wanted)
            out.append((d, {"last": self.key(int(places[here][-1])), "wanted": sorted(names)}))
        return (int(depth[-1]) if depth.size else 0), out


def _fetch(file, start: int, stop: int) -> tuple[bytes, int]:
    """Bytes up to ``stop`` with enough before ``start`` to see keys and escapes; how many those are."""
    look = min(start, LOOK_BACK)
    while True:
        buf = file.read_at(stop - start + look, start - look)
        if look == start or buf[:1] != b"\\":
            return buf, look
        look = min(start, 2 * look)


def range_index(documents: DataFrame, wanted: Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Action: (path, length) of documents to one row per byte range, with the true state at its start, stored under
    ``spark.checkpoint.dir``: path, start, stop, length, in_string, depth, inherited (the top-level key in force), held (those of
    ``wanted`` that begin in it).

    Every byte is read once, by a task per few ranges. The running sums go over a document's ranges (6,000 for 100 GB), not its
    bytes.
    """
    spark, names = documents.sparkSession, list(wanted)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                store, path = open_store(r["path"])
                with store.open_input_file(path) as file:
                    scan = Scan(*_fetch(file, r["start"], r["stop"]))
                (out_by, out_keys), (in_by, in_keys) = (scan.summary(s, names) for s in (0, 1))
                rows.append(r | {"quotes": scan.inside.size, "out_by": out_by, "in_by": in_by, "out_keys": out_keys, "in_keys": in_keys})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kind = "map<int, struct<last: string, wanted: array<string>>>"
    keys = pa.map_(pa.int32(), pa.struct([("last", pa.string()), ("wanted", pa.list_(pa.string()))]))
    longs = ["start", "stop", "length", "quotes", "out_by", "in_by"]
    arrow = pa.schema([("path", pa.string()), *[(n, pa.int64()) for n in longs], ("out_keys", keys), ("in_keys", keys)])
    step = F.lit(range_bytes).cast("long")
    ranges = documents.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + step, F.col("length")).alias("stop"), "length")
    listed = scratch_path(spark, "json-ranges")
    ranges.write.parquet(listed)
    summed = spread_ranges(spark.read.parquet(listed)).mapInArrow(
        sum_up, "path string, " + ", ".join(f"{n} long" for n in longs) + f", out_keys {kind}, in_keys {kind}"
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = summed.withColumn("in_string", F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0)).cast("int"))
    inside = F.col("in_string") == 1
    state = state.withColumn("by", F.when(inside, F.col("in_by")).otherwise(F.col("out_by"))).withColumn("keys", F.when(inside, F.col("in_keys")).otherwise(F.col("out_keys")))
    state = state.withColumn("depth", F.coalesce(F.sum("by").over(before), F.lit(0)).cast("int"))
    top = F.try_element_at("keys", 1 - F.col("depth"))
    state = state.withColumn("top", top["last"]).withColumn("held", F.coalesce(top["wanted"], F.array().cast("array<string>")))
    path = scratch_path(spark, "json-index")
    state.withColumn("inherited", F.last("top", ignorenulls=True).over(before)).select(
        "path", "start", "stop", "length", "in_string", "depth", "inherited", "held"
    ).write.parquet(path)
    return spark.read.parquet(path)


def spread_ranges(ranges: DataFrame) -> DataFrame:
    """One task per ``RANGE_BYTES``, but as many as the ranges of a small input allow, up to ``MOST_TASKS``: the rows are tiny, what
    they stand for is not."""
    rows, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    least = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt in turn: by hash some tasks would have several ranges, others none
    return ranges.repartition(min(MOST_TASKS, max(1, min(rows, max(least, size // RANGE_BYTES)))))


def array_elements(index: DataFrame, name: str, range_bytes: int = READ_ON) -> DataFrame:
    """(path, pos, text): the objects of the top-level array ``name``; ``pos`` is the byte where one begins, in list order.

    Lazy. Only ranges that hold such elements are read, each by itself; a task holds one range and the end of its last element.
    Spark guesses the size of the result from the few rows of the index: store the result, or hint its joins, before it is joined.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = open_store(r["path"])
                with store.open_input_file(path) as file:
                    buf, look = _fetch(file, r["start"], r["stop"])
                    found = list(_elements(file, buf, look, r, name, range_bytes))
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    columns = [pa.array([r["path"]] * len(part)), pa.array([p for p, _ in part], pa.int64()), pa.array([x for _, x in part], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "pos", "text"])

    hits = index.where((F.col("inherited") == name) | F.array_contains("held", name))
    return spread_ranges(hits).mapInArrow(read, "path string, pos long, text string")


def _elements(file, buf: bytes, look: int, r: dict, name: str, more: int) -> Iterator[tuple[int, str]]:
    scan = Scan(buf, look)
    at, depth = scan.outside(r["in_string"])
    depth = depth + r["depth"]
    byte = scan.raw[at]
    tops = at[(byte == COLON) & (depth == 1)]
    keys = [r["inherited"], *[scan.key(int(p)) for p in tops]]
    opens, closes = at[(byte == OPEN) & (depth == 3)], at[(byte == CLOSE) & (depth == 2)]
    upto = np.searchsorted(closes, opens)
    for begin, k, key in zip(opens.tolist(), upto.tolist(), np.searchsorted(tops, opens).tolist()):
        if keys[key] != name:
            continue
        text = buf[begin : closes[k] + 1] if k < closes.size else _rest(file, buf[begin:], r["stop"], r["length"], more)
        yield r["start"] - look + begin, text.decode("utf-8", "replace")


def _rest(file, text: bytes, at: int, length: int, more: int) -> bytes:
    """The element that begins ``text``, read on past the range until its bracket closes."""
    while True:
        scan = Scan(text, 0)
        places, depth = scan.outside(0)
        ends = places[depth == 0]
        if ends.size:
            return text[: ends[0] + 1]
        if at >= length:
            return text
        step = min(max(more, len(text)), length - at)
        text, at = text + file.read_at(step, at), at + step


def json_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """path and length of the files of a pattern; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")
