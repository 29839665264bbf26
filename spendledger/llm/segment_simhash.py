"""Near-duplicate documents by SimHash and a grid of segment counts (operator 12).

A fingerprint of 64 bits is cut into 32 segments of two bits; the ones in each segment
make a point with 32 coordinates of 0 to 2.  A changed bit moves one coordinate by one,
so the Manhattan distance of two points never exceeds the Hamming distance of their
fingerprints, and fingerprints within the radius have points within it.

The points are joined in grids of fewer dimensions.  The coordinates are dealt to groups;
two points within radius r differ in r groups at most, so with g groups they share a cell
of the grid over some g - r of them.  Each grid takes one set of groups.  In a cell the
pairs whose Manhattan distance is within the radius are confirmed on the fingerprints.

A cell gives the links of a spanning forest of its near fingerprints, fewer than it has
rows, never all its pairs.  A cell with more rows than a block is dealt as pairs of
blocks, so no task holds more than two blocks of one cell.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendledger.llm.common import documents, materialise, words_of
from spendledger.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
SEGMENT_BITS = 2
SEGMENTS = 64 // SEGMENT_BITS
#: Rows of a cell that one task compares with as many others.
BLOCK = 2048
#: Rows up to which the members of a cell are compared neighbour by neighbour over a whole batch.
SMALL = 12
_EVEN = 0x5555_5555_5555_5555


def fingerprint(text: str) -> int:
    """Bits that more than half of the shingles' hashes have; 0 without a word."""
    words = words_of(text, lower=True)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(SHINGLE, len(words))
    begins = np.r_[0, ends[:-1] + 1][:len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends[size - 1:].tolist(), strict=True)), np.uint64, len(begins))
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k:k + 8192].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row (``fp`` as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The ones of each two-bit segment, in the segment's place: 0, 1 and 2 as the bits 00, 01 and 11."""
    even = np.uint64(_EVEN)
    a, b = fp & even, (fp >> np.uint64(1)) & even
    return (a | b) | ((a & b) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of points: their codes differ in as many bits as the counts are apart."""
    return np.bitwise_count(a ^ b)


def _segment_counts(fp: Column) -> Column:
    """``segment_counts`` as a column."""
    even = F.lit(_EVEN).cast("long")
    a, b = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def groups_for(n: int, radius: int) -> int:
    """The number of groups: two more than the radius, and further ones while a cell would hold over 4,096 of ``n`` fingerprints.

    A coordinate carries 1.5 bits where fingerprints are even.  More groups only make the cells
    finer; every pair within the radius shares a cell for any number.
    """
    return next((g for g in range(radius + 2, 12) if n < 4096 * 2 ** (1.5 * (g - radius) * (SEGMENTS // g))), 12)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def grids(groups: int, radius: int) -> list[int]:
    """The mask of each grid's coordinates."""
    edges = [SEGMENTS * k // groups for k in range(groups + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(masks[g] for g in kept) for kept in combinations(range(groups), groups - radius)]


def forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over the near members of one cell (places in ``fp``).

    Each member is compared once with those not reached yet.
    """
    points = segment_counts(fp)
    rest, left, right = np.arange(len(fp)), [], []
    while len(rest) > 1:
        waiting, rest = [int(rest[0])], rest[1:]
        while waiting and len(rest):
            u = waiting.pop()
            near = np.flatnonzero(manhattan(points[rest], points[u]) <= radius)
            near = near[np.bitwise_count(fp[rest[near]] ^ fp[u]) <= radius]
            if len(near):
                found = rest[near].tolist()
                left += [u] * len(found)
                right += found
                waiting += found
                rest = np.delete(rest, near)
    return left, right


def cell_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the cells of rows that are sorted by cell: places of the linked rows."""
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[begin, len(cell)])
    small = np.repeat(size <= SMALL, size)
    points, left, right = segment_counts(fp), [], []
    for lag in range(1, min(SMALL, int(size.max(initial=0)))):
        a = np.flatnonzero((cell[lag:] == cell[:-lag]) & small[lag:])
        a = a[manhattan(points[a], points[a + lag]) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= radius]
        left.append(a)
        right.append(a + lag)
    for b, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        x, y = forest(fp[b:b + n], radius)
        left.append(np.array(x, np.int64) + b)
        right.append(np.array(y, np.int64) + b)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left + none), np.concatenate(right + none)


def near_links(classes: DataFrame, radius: int = RADIUS, groups: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that join all fingerprints within the radius (``classes``: fp, vertex), none of another pair."""
    groups = groups or groups_for(classes.count(), radius)
    point = _segment_counts(F.col("fp"))
    keys = F.array(*(F.xxhash64(F.lit(t), F.col("point").bitwiseAND(F.lit(_signed(m)).cast("long"))) for t, m in enumerate(grids(groups, radius))))
    cells = classes.select("fp", "vertex", point.alias("point")).select("fp", "vertex", F.explode(keys).alias("cell"))
    large = materialise(cells.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > block), "large-cells")
    # A large cell's rows go to blocks, and each block meets every block, itself included.
    blocks = F.ceil(F.col("rows") / block).cast("int")
    dealt = cells.join(large, "cell").withColumns({"_n": blocks, "_own": F.pmod(F.xxhash64("fp"), blocks).cast("int")}).select(
        "fp", "vertex", "cell", "_own", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other")).select(
        "fp", "vertex", F.xxhash64("cell", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("cell"))
    rows = cells.join(large, "cell", "left_anti").select("fp", "vertex", "cell").unionByName(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(fp: np.ndarray, vertex: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
            a, b = cell_links(cell, fp.view(np.uint64), radius)
            return pa.record_batch([pa.array(vertex[a]), pa.array(vertex[b])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy() for k in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[2], now[2][-1]))  # the last cell may go on in the next batch
            if last:
                yield links(*(x[:last] for x in now))
            held = [x[last:] for x in now]
        if held is not None:
            yield links(*held)

    found = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` of every document.

    Documents are linked when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable, the own one included.  A null, empty or
    blank text has the fingerprint zero and is linked like any other.  Rows of one id are
    one document: what any of its texts is near to is joined.  A row without an id is
    linked with nothing: its ``component_id`` is null and it is kept.  An empty table
    gives no row.
    """
    made = materialise(fingerprints(documents(docs, id_col, text_col)), "fingerprints")
    classes = materialise(made.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("vertex")), "classes")
    placed = materialise(made.join(classes, "fp"), "placed")
    # Several fingerprints of one id: their classes are joined.
    several = placed.groupBy("doc_id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b")).where("a < b").select("doc_id", "a")
    own = placed.join(several, "doc_id").select("a", F.col("vertex").alias("b")).distinct()
    reached = components(near_links(classes, radius).unionByName(own)).withColumnRenamed("component", "component_id")
    linked = placed.where("doc_id IS NOT NULL").join(reached, "vertex", "left").select(
        "doc_id", "fp", F.coalesce("component_id", "vertex").alias("component_id"))
    alone = made.where("doc_id IS NULL").select("doc_id", "fp", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
