"""Best-fit packing into sequences of several permitted lengths (operator 9).

Documents are dealt evenly into groups of a stated size; a group is packed on its own,
longest piece first.  A piece goes to the open bin with the least room that holds it.  If
none does, a bin is opened; at the end every bin shrinks to the least permitted length
that holds its contents.  Which length to open is chosen jointly: a group is packed once
by the least cost for each unit of room and once with each permitted length preferred,
and the packing whose shrunk bins cost least in all is kept.  Groups are all of one size,
so any part of the input that shares a key or a length is spread over all of them, and
the bins left half full at the end of a group do not grow with the input.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (2048, 4096, 8192, 16384)
GROUP = 20_000


def sequence_cost(capacity: int, start: int = 512, span: int = 16384) -> float:
    """Cost of training on one sequence: a fixed part, a part for each token, attention's square."""
    return start + capacity + capacity * capacity / span


def best_fit(lengths: Sequence[int], capacities: Sequence[int], opens: Callable[[int], int]) -> tuple[np.ndarray, list[int]]:
    """The bin of each piece and the contents of each bin, for pieces in descending length."""
    where, used = np.empty(len(lengths), np.int64), []
    rooms: list[int] = []  # distinct amounts of room, ascending
    bins: dict[int, list[int]] = {}  # open bins by room
    for k, length in enumerate(lengths):
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            used[b] += length
        else:
            b, room = len(used), opens(length)
            used.append(length)
        where[k] = b
        left = room - length
        if left:
            if left not in bins:
                insort(rooms, left)
                bins[left] = []
            bins[left].append(b)
    return where, used


def pack_group(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the pieces (descending) and each bin's final capacity, by the cheapest way to open bins."""
    caps = sorted(capacities)
    unit = {c: cost(c) / c for c in caps}

    def least_unit(length: int) -> int:
        return min((c for c in caps if c >= length), key=unit.get)

    def preferred(want: int) -> Callable[[int], int]:
        return lambda length: max(want, caps[bisect_left(caps, length)])

    best = None
    for opens in (least_unit, *map(preferred, caps)):
        where, used = best_fit(lengths, caps, opens)
        final = np.array(caps, np.int64)[np.searchsorted(caps, used)]
        total = sum(cost(int(c)) * n for c, n in zip(*np.unique(final, return_counts=True), strict=True))
        if best is None or total < best[0]:
            best = (total, where, final)
    return best[1], best[2]


def pack(df: DataFrame, length_col: str = "n_tokens", id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES,
         group: int = GROUP, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """``doc_id, piece, length, bin_id, bin_offset, capacity`` for every piece of every document.

    A document longer than the largest capacity is cut into pieces of that size and a
    rest.  A null, zero or negative length needs no room: its one row has length 0 and a null
    bin.  Repeated rows are packed each on its own; a null id is carried along.
    """
    largest = max(capacities)
    size = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    lengths = df.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"))
    pieces = lengths.select("doc_id", "size", F.explode(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(size - 1) div {largest}"), F.lit(0)))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(largest), F.col("size") - F.col("piece") * largest).cast("long").alias("length"))
    groups = max(1, -(-lengths.count() // group))
    dealt = pieces.repartition(groups).sortWithinPartitions(F.desc("length"), "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        length = rows["length"].to_numpy()
        full = int((length > 0).sum())  # the empty ones come last
        where, final = pack_group(length[:full].tolist(), capacities, cost)
        order = np.argsort(where, kind="stable")
        offset = np.zeros(full, np.int64)
        if full:
            before = np.cumsum(length[:full][order]) - length[:full][order]
            first = np.r_[True, np.diff(where[order]) > 0]
            offset[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), full]))
        none = np.arange(len(length)) >= full
        pad = np.zeros(len(length) - full, np.int64)
        base = TaskContext.get().partitionId() << 33
        columns = (np.r_[where + base, pad], np.r_[offset, pad], np.r_[final[where] if full else pad[:0], pad])
        out = pa.table([rows["doc_id"], rows["piece"], rows["length"], *(pa.array(c.astype(np.int64), mask=none) for c in columns)],
                       names=["doc_id", "piece", "length", "bin_id", "bin_offset", "capacity"])
        yield from out.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, "doc_id long, piece long, length long, bin_id long, bin_offset long, capacity long")


def byte_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` for a byte-level model: UTF-8 bytes of the text (null: none) and an end mark."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("n_tokens"))
