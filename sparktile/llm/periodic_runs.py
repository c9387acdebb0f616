"""Periodic runs in sequences: descending-LCP union of suffix classes over ordered position sets.

The project's own sequences are the ``counts`` of run-length segmentations (a grating, a comb of vessels or a scanner's stripes
give lengths that repeat) and the class ids along a tile row; texts are read as sequences of words.

Method.  Neighbours in suffix order are united in descending order of their common prefix (Kruskal on a path).  Every class
keeps its positions in order; the smaller class is laid into the larger, and places that become neighbours at a distance of at
most the common prefix start a stretch with that period.  Such a distance is always the smallest period, and a run's first place
and the one a period later become neighbours exactly when the level reaches the run's length less its period; so the stretches
that cannot be extended to the left are the runs, each once.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS_AT_ONCE = 1 << 19
BYTES_AT_ONCE = 1 << 20
BLOCK = 1024
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Places:
    """Positions in ascending order, in blocks, so that one more costs little in large sets."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, place: int):
        self.blocks, self.firsts, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def _block(self, place: int) -> int:
        return max(bisect_left(self.firsts, place) - 1, 0) if len(self.firsts) > 1 else 0

    def neighbours(self, place: int) -> tuple[int, int]:
        """The next smaller and larger members, -1 if there is none."""
        k = self._block(place)
        block = self.blocks[k]
        i = bisect_left(block, place)
        after = block[i] if i < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return (block[i - 1] if i else -1), after

    def add(self, place: int) -> None:
        k = self._block(place)
        block = self.blocks[k]
        insort(block, place)
        self.firsts[k] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts[k : k + 1] = [block[0], block[BLOCK]]


def suffix_ranks(ids: np.ndarray) -> np.ndarray:
    """Rank of the suffix at each place, by prefix doubling; only groups that still hold equal prefixes are sorted again."""
    n = ids.size
    rank = np.searchsorted(np.sort(ids), ids).astype(np.int64)  # a group's members share the rank of its first
    active = np.argsort(rank, kind="stable")
    length = 1
    first = True
    while active.size:
        if not first:
            second = np.where(active + length < n, rank[np.minimum(active + length, n - 1)] + 1, 0)
            key = rank[active] * (n + 2) + second
            order = np.argsort(key, kind="stable")
            active, key = active[order], key[order]
            old = rank[active]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.concatenate([[True], old[1:] != old[:-1]])
            at = np.arange(active.size)
            rank[active] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))
            length *= 2
        first = False
        r = rank[active]
        same = np.concatenate([[False], r[1:] == r[:-1], [False]])
        active = active[same[1:] | same[:-1]]
    return rank


def common_prefixes(ids: list[int], rank: list[int], order: list[int]) -> list[int]:
    """Common prefix of the suffix at each rank with the one before, in time linear in the places."""
    n, out, same = len(ids), [0] * len(ids), 0
    for place, r in enumerate(rank):
        if not r:
            same = 0
            continue
        other = order[r - 1]
        most = n - max(place, other)
        while same < most and ids[place + same] == ids[other + same]:
            same += 1
        out[r] = same
        if same:
            same -= 1
    return out


def runs_of(ids: np.ndarray, min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_length`` items and two periods, by start, then period.

    ``ids`` may hold several sequences one after the other if these share no id.
    """
    least = -(-min_length // 2)  # of length >= min_length and >= 2 * period, at least half recurs one period later
    rank = suffix_ranks(ids)
    order = np.empty_like(rank)
    order[rank] = np.arange(rank.size)
    words, by_rank = ids.tolist(), order.tolist()
    prefixes = common_prefixes(words, rank.tolist(), by_rank)
    lcp = np.array(prefixes)
    edges = np.flatnonzero(lcp >= least)
    parent: dict[int, int] = {}
    members: dict[int, Places] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x] = x
            members[x] = Places(by_rank[x])
            return x
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for r in edges[np.argsort(-lcp[edges], kind="stable")].tolist():
        level = prefixes[r]
        small, large = root(r - 1), root(r)
        if members[small].size > members[large].size:
            small, large = large, small
        inside, moved = members[large], members.pop(small)
        last, pairs, places = -1, [], list(moved)
        for i, place in enumerate(places):
            before, after = inside.neighbours(place)
            if before > last:  # nothing of the smaller class lies between
                pairs.append((before, place))
            if after >= 0 and (i + 1 == len(places) or places[i + 1] > after):
                pairs.append((place, after))
            last = place
        for place in places:
            inside.add(place)
        parent[small] = large
        for a, b in pairs:
            period = b - a
            if period <= level and period + level >= min_length and (a == 0 or words[a - 1] != words[b - 1]):
                found.append((a, period + level, period))
    return sorted(found, key=lambda x: (x[0], x[2]))


def may_repeat(ids: np.ndarray, ends: np.ndarray, min_length: int) -> np.ndarray:
    """For each sequence of ``ids`` that stops at ``ends``: False only if it surely has no run.

    From a run's first place on, as many places as its length less its period (and less a gram) start a gram of half
    ``min_length`` items that recurs, the first of them at most one period later.
    """
    n, gram = ids.size, -(-min_length // 2)
    hashed = np.zeros(n, dtype=np.uint64)
    for k in range(min(gram, n)):
        hashed[: n - k] = (hashed[: n - k] ^ ids[k:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = np.sort((hashed >> bits << bits) | np.arange(n, dtype=np.uint64))
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    again = (key[1:] >> bits) == (key[:-1] >> bits)
    ahead = np.zeros(n, dtype=np.int64)
    ahead[place[:-1][again]] = np.diff(place)[again]
    stops = np.flatnonzero(ahead == 0)
    at = np.arange(n)
    stretch = np.append(stops, n)[np.searchsorted(stops, at)] - at
    hits = np.flatnonzero((ahead > 0) & (stretch >= np.maximum(1, ahead - gram + 1)))
    out = np.zeros(ends.size, dtype=bool)
    out[np.searchsorted(ends, hits, side="right")] = True
    return out


def interned(value) -> tuple[np.ndarray, list]:
    """A text's words or an array's items as (ids, vocabulary); long texts are cut into words piece by piece."""
    known: dict = {}
    ids = array("q")
    if isinstance(value, str):
        data, at = value.encode("utf-8", "surrogatepass"), 0
        while at < len(data):
            end = at + BYTES_AT_ONCE
            if end < len(data):
                space = _SPACE.search(data, end)
                end = space.start() if space else len(data)
            ids.extend([known.setdefault(w, len(known)) for w in data[at:end].split()])
            at = end
    elif value is not None:
        ids.extend([known.setdefault(x, len(known)) for x in value])
    return np.frombuffer(ids, dtype=np.int64), list(known)


def collapsed(ids: np.ndarray, vocabulary: list, runs: list[tuple[int, int, int]], text: bool):
    """The items outside of what runs hold after their first period."""
    drop = np.zeros(ids.size + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = [vocabulary[i] for i in ids[np.cumsum(drop[:-1]) == 0].tolist()]
    return b" ".join(kept).decode("utf-8", "surrogatepass") if text else kept


def periodic_runs(records: DataFrame, sequence: str = "counts", keys: Sequence[str] = ("source_id",), min_length: int = 12) -> DataFrame:
    """``keys`` and ``sequence`` (a run-length segmentation's ``counts`` or another array, or a text) to the keys with ``n_items``,
    ``runs`` (array of start, length, period, by start, then period) and ``collapsed``.

    A run is a stretch with smallest period q of at least ``min_length`` items and 2 * q that no neighbouring item extends
    with period q.  ``collapsed`` is the sequence without the items that a run holds after its first q; arrays keep their type, a
    text's words (separated by the space and ``\\t`` to ``\\r``) are joined by one space.

    No shuffle: each sequence is judged alone, in the task that reads it, in memory in proportion to the longest sequence.
    Sequences without recurring stretches are passed on after one sort of hashed grams; the rest is sorted by suffixes.

    A null sequence has no items, no runs and an empty result; a null item of an array equals other nulls.  Repeated rows and
    rows that share a key are judged one by one; null keys are kept; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    kind = records.schema[sequence].dataType
    text = isinstance(kind, T.StringType)
    if min_length < 2:
        raise ValueError(f"min_length must be at least 2, got {min_length}")
    names = [f"k{i}" for i in range(len(keys))]
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([
        *[T.StructField(n, records.schema[k].dataType) for n, k in zip(names, keys)],
        T.StructField("n_items", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", kind),
    ])

    run_arrow = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def judge(batch: pa.RecordBatch, read: list[tuple[np.ndarray, list]]) -> pa.RecordBatch:
        sizes = np.array([ids.size for ids, _ in read], dtype=np.int64)
        every, ends = np.concatenate([np.zeros(0, np.int64), *_apart(read)]), np.cumsum(sizes)
        runs: list[list] = [[] for _ in read]
        chosen = np.flatnonzero(may_repeat(every, ends, min_length)) if every.size else []
        if len(chosen):
            starts, at = ends - sizes, np.cumsum(sizes[chosen])
            for start, length, period in runs_of(np.concatenate([every[starts[i] : ends[i]] for i in chosen]), min_length):
                k = int(np.searchsorted(at, start, side="right"))
                runs[chosen[k]].append((start - int(at[k] - sizes[chosen[k]]), length, period))
        kept = [collapsed(ids, vocabulary, r, text) for (ids, vocabulary), r in zip(read, runs)]
        found = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs], type=run_arrow)
        columns = [*[batch.column(n) for n in names], pa.array(sizes), found, pa.array(kept, type=batch.schema.field("value").type)]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "n_items", "runs", "collapsed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, read, size = 0, [], 0
            for i, value in enumerate(batch.column("value")):
                read.append(interned(value.as_py()))
                size += read[-1][0].size
                if size >= ITEMS_AT_ONCE or i + 1 == batch.num_rows:
                    yield judge(batch.slice(first, i + 1 - first), read)
                    first, read, size = i + 1, [], 0

    rows = records.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(sequence).alias("value"))
    return rows.mapInArrow(find, schema).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n_items", "runs", "collapsed")


def _apart(read: list[tuple[np.ndarray, list]]) -> Iterator[np.ndarray]:
    """Ids of several sequences such that no two share one."""
    base = 0
    for ids, vocabulary in read:
        yield ids + base
        base += len(vocabulary)
