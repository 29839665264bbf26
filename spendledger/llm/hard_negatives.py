"""Hard negatives by a multiway tree of split points (operator 13).

Scores are inner products of whole-number vectors.  Every row gets one more coordinate,
which brings all rows to the same length M; then a score is a distance,
``|a - x|**2 = |a|**2 + M**2 - 2 * score``, and a window of scores is an annulus around the
anchor.

Each node of the tree has up to 16 split points, and a row belongs to the nearest one.
For every two of them, i and j, the node stores the least and the greatest distance of
point i to the rows under j.  A subtree is left out when for some split point the
distances that the annulus permits do not meet that range, or when the annulus lies beyond
the plane that parts it from a sibling.  What is left is compared in full, so results are
exact whatever the tree looks like.

The split points are fitted to a bounded sample (``SAMPLE`` rows, the least by a hash of the id); the
leaves and ranges come from all rows.  Rows lie in the order of their leaves and are cut into chunks
of equal size, so a leaf that holds a third of all rows is many chunks.  Anchors are
dealt to blocks.  Each task takes one block past a span of chunks, one chunk at a time,
and keeps the best rows of each anchor.  A first pass over each anchor's own chunk gives
the scores that the annuli start from.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendledger.llm.common import materialise, row_numbers

BRANCHES, LEAF_ROWS, MOST_LEVELS = 16, 512, 3
#: Rows that the split points are chosen from, and numbers in them.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 22
#: Rows of a chunk, anchors of a block, chunks that a task takes one after the other, scores made at once.
CHUNK, BLOCK, SPAN, CELLS = 2048, 1024, 64, 1 << 20
#: Components reach this far and vectors are this long at most, so that scores are exact.
LARGEST, LONGEST = 2048, 32_768
_NONE = -(1 << 61)


def quantised(embeddings: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label",
              vector_col: str = "embedding") -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, components as ``floor(scale * x)``.

    Rows with a null id, label, vector or component, with one that is not finite, or beyond
    ``LARGEST`` or ``LONGEST`` take no part.
    """
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) >= LARGEST))
    good = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & (F.size(x) <= LONGEST) & ~odd)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                       F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("vector"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, values = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    if (size == dims).all():
        return values.reshape(len(size), dims).astype(np.int32)
    out = np.zeros((len(size), dims), np.int32)
    out[np.arange(dims) < size[:, None]] = values
    return out


@dataclass
class Node:
    points: np.ndarray
    #: The first leaf of each child, and the first one behind the last child.
    leaves: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)  # node number, or -1 for a leaf
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Tree:
    """Split points in the space of one more coordinate, with distance ranges between siblings."""

    def __init__(self, sample: np.ndarray, most: float, levels: int):
        self.most, self.nodes, self.leaf_count = most, [], 0
        self._grow(self.lift(sample), levels)
        self.starts = np.zeros(self.leaf_count + 1, np.int64)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))]

    def _grow(self, sample: np.ndarray, levels: int) -> int:
        number = len(self.nodes)
        node = Node(self._split_points(sample))
        self.nodes.append(node)
        nearest = self.distances(node, sample).argmin(axis=1) if len(sample) else np.zeros(0, np.int64)
        for j in range(len(node.points)):
            node.leaves.append(self.leaf_count)
            mine = sample[nearest == j]
            if levels > 1 and len(mine) > BRANCHES:
                node.children.append(self._grow(mine, levels - 1))
            else:
                node.children.append(-1)
                self.leaf_count += 1
        node.leaves.append(self.leaf_count)
        node.low = np.full((len(node.points), len(node.points)), np.inf)
        node.high = np.full((len(node.points), len(node.points)), -np.inf)
        return number

    @staticmethod
    def _split_points(sample: np.ndarray) -> np.ndarray:
        """Greedily, the candidate farthest from those chosen already."""
        some = np.unique(sample[:3 * BRANCHES].astype(np.float32), axis=0).astype(np.float64)
        if not len(some):
            return np.zeros((1, sample.shape[1]))
        chosen, gap = [0], ((some - some[0]) ** 2).sum(axis=1)
        while len(chosen) < min(BRANCHES, len(some)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((some - some[chosen[-1]]) ** 2).sum(axis=1))
        return some[chosen]

    def distances(self, node: Node, lifted: np.ndarray, square: np.ndarray | float | None = None) -> np.ndarray:
        """Distances of lifted rows (of squared length ``most``, unless given) to a node's points."""
        p = node.points
        own = self.most if square is None else square
        return np.sqrt(np.maximum((p * p).sum(axis=1) + np.reshape(own, (-1, 1)) - 2 * (lifted @ p.T), 0))

    def place(self, vectors: np.ndarray, seen=lambda *_: None) -> np.ndarray:
        """The leaf of each row; ``seen`` gets each node's number, its distances and the child of each row."""
        lifted, out = self.lift(vectors), np.zeros(len(vectors), np.int64)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            number, rows = waiting.pop()
            if not len(rows):
                continue
            node = self.nodes[number]
            apart = self.distances(node, lifted[rows])
            nearest = apart.argmin(axis=1)
            seen(number, apart, nearest)
            for j, child in enumerate(node.children):
                mine = rows[nearest == j]
                if child < 0:
                    out[mine] = node.leaves[j]
                else:
                    waiting.append((child, mine))
        return out

    def reached(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which leaves (columns) may hold rows in some score window of each anchor; windows are ``low`` to ``high``."""
        a = anchors.astype(np.float64)
        square = (a * a).sum(axis=1)
        flat = np.c_[a, np.zeros(len(a))]
        total = square[:, None] + self.most
        slack = 1e-4 * (np.sqrt(self.most) + np.sqrt(square)[:, None]) + 1e-4
        inner = np.sqrt(np.maximum(total - 2.0 * high, 0)) - slack
        outer = np.sqrt(np.maximum(total - 2.0 * low, 0)) + slack
        open_ = (low <= high) & (2.0 * low <= total + 1)
        out = np.zeros((len(a), self.leaf_count), bool)
        waiting = [(0, open_)]
        while waiting:
            number, alive = waiting.pop()
            node = self.nodes[number]
            apart = self.distances(node, flat, square)
            between = np.sqrt(np.maximum(((node.points[:, None] - node.points) ** 2).sum(axis=2), 1e-12))
            for j, child in enumerate(node.children):
                # Least and greatest distance of each split point to rows of the annulus.
                least = np.maximum(apart[:, None, :] - outer[:, :, None], inner[:, :, None] - apart[:, None, :])
                meets = ((apart[:, None, :] + outer[:, :, None] >= node.low[:, j]) & (least <= node.high[:, j])).all(axis=2)
                beyond = (apart[:, [j]] ** 2 - apart ** 2) / (2 * between[j])  # how far the anchor is behind the plane to each sibling
                meets &= beyond.max(axis=1, initial=-np.inf, where=np.arange(len(node.points)) != j)[:, None] <= outer
                meets &= alive
                if child < 0:
                    out[:, node.leaves[j]] = meets.any(axis=1)
                elif meets.any():
                    waiting.append((child, meets))
        return out


def _fit(rows: DataFrame) -> tuple[Tree, int] | None:
    """A tree fitted to the sample, and the length of the vectors; None for an empty table."""
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda t, v: t + v.cast("long") * v)
    r = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"), F.max(square).alias("most")).first()
    if not r["n"]:
        return None
    levels = next((k for k in range(1, MOST_LEVELS) if BRANCHES**k * LEAF_ROWS >= r["n"]), MOST_LEVELS)
    dims = max(1, r["dims"])
    wanted = max(64, min(SAMPLE, 4 * BRANCHES ** (levels + 1), SAMPLE_NUMBERS // dims))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "vector").limit(wanted).select("vector").toArrow()
    return Tree(matrix(sample["vector"], dims), float(r["most"]), levels), dims


def _measure(tree: Tree, ordered: DataFrame, dims: int) -> None:
    """Fill in the ranges and the rows before each leaf, from all rows."""
    shared = ordered.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}

        def seen(number: int, apart: np.ndarray, nearest: np.ndarray) -> None:
            for j in np.unique(nearest).tolist():
                mine = apart[nearest == j]
                had = found.get((number, j))
                low, high = mine.min(axis=0), mine.max(axis=0)
                found[number, j] = [low, high, len(mine)] if had is None else [
                    np.minimum(had[0], low), np.maximum(had[1], high), had[2] + len(mine)]

        for batch in batches:
            shared.value.place(matrix(batch.column(0), dims), seen)
        if found:
            yield pa.record_batch(
                [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()),
                 pa.array([v[0].tolist() for v in found.values()], pa.list_(pa.float64())),
                 pa.array([v[1].tolist() for v in found.values()], pa.list_(pa.float64())),
                 pa.array([v[2] for v in found.values()], pa.int64())], names=["node", "child", "low", "high", "n"])

    parts = ordered.select("vector").mapInArrow(run, "node int, child int, low array<double>, high array<double>, n long")
    each = parts.select("node", "child", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x"))
    # One figure for each two siblings: bounded by the tree.
    table = each.groupBy("node", "child", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.sum("n").alias("n")).toArrow()
    counts = np.zeros(tree.leaf_count, np.int64)
    for number, j, i, low, high, n in zip(*(table[c].to_pylist() for c in ("node", "child", "i", "low", "high", "n")), strict=True):
        node = tree.nodes[number]
        node.low[i, j], node.high[i, j] = low, high
        if node.children[j] < 0:
            counts[node.leaves[j]] = n
    tree.starts = np.r_[0, np.cumsum(counts)]


def _placed(rows: DataFrame, tree: Tree, dims: int) -> DataFrame:
    """``rows`` in the order of their leaves, numbered from 0."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.place(matrix(batch.column("vector"), dims))
            yield pa.record_batch([*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    marked = rows.mapInArrow(run, "vec_id long, label long, vector array<int>, anchor boolean, leaf long")
    return row_numbers(marked, "leaf", "vec_id", "label", name="leaves")


def _chunks(ordered: DataFrame, dims: int) -> DataFrame:
    """``chunk, ids, labels, vectors``: the rows of each chunk as bytes, in order."""
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("row_no")
        return pa.table({"chunk": group["chunk"][:1], "ids": [group["vec_id"].to_numpy().tobytes()],
                         "labels": [group["label"].to_numpy().tobytes()], "vectors": [matrix(group["vector"], dims).tobytes()]})

    dealt = ordered.select(F.floor(F.col("row_no") / CHUNK).alias("chunk"), "row_no", "vec_id", "label", "vector")
    return materialise(dealt.groupBy("chunk").applyInArrow(pack, "chunk long, ids binary, labels binary, vectors binary"), "chunks")


_BLOCK = "block long, rows binary, labels binary, vectors binary, low binary, high binary, least binary"


def _blocks(anchors: DataFrame, dims: int, windows: int) -> DataFrame:
    """Anchors of each block as bytes; ``windows`` score windows each (arrays low, high, least; shorter ones are filled with empty windows)."""
    def full(column: pa.ChunkedArray, n: int, empty: int) -> np.ndarray:
        out = np.full((n, windows), empty, np.int64)
        for row, values in zip(out, column.to_pylist(), strict=True):
            row[:len(values or ())] = values or ()
        return out

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("seat")
        n = group.num_rows
        return pa.table({
            "block": group["block"][:1], "rows": [group["row_no"].to_numpy().tobytes()], "labels": [group["label"].to_numpy().tobytes()],
            "vectors": [matrix(group["vector"], dims).tobytes()], "low": [full(group["low"], n, 0).tobytes()],
            "high": [full(group["high"], n, -1).tobytes()], "least": [full(group["least"], n, 0).tobytes()]})

    dealt = anchors.select(F.floor(F.col("seat") / BLOCK).alias("block"), "seat", "row_no", "label", "vector", "low", "high", "least")
    return materialise(dealt.groupBy("block").applyInArrow(pack, _BLOCK), "blocks")


def _numbers(value: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _pairs(blocks: DataFrame, tree: Tree, dims: int, windows: int, home: bool) -> DataFrame:
    """``block, chunk, mask``: the chunks each block has to see, and for which of its anchors.

    ``home``: each anchor's own chunk; else all other chunks with a leaf that its annuli reach.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(tree)

    def visits(rows: np.ndarray, reached: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        starts, at, mask = shared.value.starts, -1, None
        for leaf in np.flatnonzero(reached.any(axis=0) & (np.diff(starts) > 0)).tolist():
            for chunk in range(starts[leaf] // CHUNK, (starts[leaf + 1] - 1) // CHUNK + 1):
                if chunk == at:
                    mask = mask | reached[:, leaf]
                    continue
                if mask is not None:
                    yield at, mask
                at, mask = chunk, reached[:, leaf]
        if mask is not None:
            yield at, mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: int, made: list[tuple[int, bytes]]) -> pa.RecordBatch:
            chunk, mask = zip(*made, strict=True)
            return pa.record_batch([pa.array([block] * len(made), pa.int64()), pa.array(chunk, pa.int64()), pa.array(mask, pa.binary())],
                                   names=["block", "chunk", "mask"])

        for batch in batches:
            for k in range(batch.num_rows):
                block, rows = batch.column(0)[k].as_py(), _numbers(batch.column(1)[k])
                own = rows // CHUNK
                if home:
                    todo = ((c, own == c) for c in np.unique(own).tolist())
                else:
                    vectors = _numbers(batch.column(3)[k], np.int32).reshape(-1, dims)
                    low, high, least = (_numbers(batch.column(c)[k]).reshape(-1, windows) for c in (4, 5, 6))
                    reached = np.concatenate([shared.value.reached(vectors[s:s + 256], np.maximum(low, least)[s:s + 256], high[s:s + 256])
                                              for s in range(0, len(rows), 256)])
                    todo = ((c, m & (own != c)) for c, m in visits(rows, reached))
                made = []
                for chunk, mask in todo:
                    if mask.any():
                        made.append((chunk, np.packbits(mask).tobytes()))
                    if len(made) == 1024:
                        yield out(block, made)
                        made = []
                if made:
                    yield out(block, made)

    return materialise(blocks.mapInArrow(run, "block long, chunk long, mask binary"), "visits")


class Best:
    """The best rows of each anchor and window of one block, while its chunks pass by."""

    def __init__(self, head: dict, first_seat: int, dims: int, windows: int, keep: int, same: bool):
        self.first_seat, self.windows, self.keep, self.same = first_seat, windows, keep, same
        self.rows, self.labels = _numbers(head["rows"]), _numbers(head["labels"])
        self.vectors = _numbers(head["vectors"], np.int32).reshape(-1, dims).astype(np.float64)
        low, self.high, least = (_numbers(head[c]).reshape(-1, windows) for c in ("low", "high", "least"))
        self.least = np.maximum(low, least)
        self.pool = [np.zeros(0, np.int64)] * 3  # place (anchor and window), score, id
        self.fresh: list[list[np.ndarray]] = []

    def pass_by(self, first: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, mask: np.ndarray) -> None:
        """Take in a chunk whose first row has the number ``first``."""
        asked, columns = np.flatnonzero(mask), vectors.astype(np.float64).T
        step = max(1, CELLS // len(ids))
        for k in range(0, len(asked), step):
            a = asked[k:k + step]
            score = (self.vectors[a] @ columns).astype(np.int64)
            fits = (self.labels[a][:, None] == labels) == self.same
            if self.same:
                own = self.rows[a] - first
                here = np.flatnonzero((own >= 0) & (own < len(ids)))
                fits[here, own[here]] = False
            fits &= (score >= self.least[a].min(axis=1, keepdims=True)) & (score <= self.high[a].max(axis=1, keepdims=True))
            i, j = np.nonzero(fits)
            s, i = score[i, j], a[i]
            for w in range(self.windows):
                in_window = (s >= self.least[i, w]) & (s <= self.high[i, w])
                self.fresh.append([i[in_window] * self.windows + w, s[in_window], ids[j[in_window]]])
            if sum(len(x[0]) for x in self.fresh) > CELLS // 4:
                self.settle()
        self.settle()

    def settle(self) -> None:
        """Keep the best of each place: higher scores first, then smaller ids; what cannot enter any more is told by ``least``."""
        if not any(len(x[0]) for x in self.fresh):
            self.fresh = []
            return
        place, score, ids = (np.concatenate(x) for x in zip(self.pool, *self.fresh, strict=True))
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        rank = np.arange(len(place)) - np.repeat(first, np.diff(np.r_[first, len(place)]))
        last = rank == self.keep - 1
        flat = self.least.reshape(-1)
        flat[place[last]] = np.maximum(flat[place[last]], score[last])
        stays = rank < self.keep
        self.pool, self.fresh = [place[stays], score[stays], ids[stays]], []

    def result(self) -> pa.RecordBatch:
        place, score, ids = self.pool
        return pa.record_batch([pa.array(self.first_seat + place // self.windows), pa.array((place % self.windows).astype(np.int32)),
                                pa.array(score), pa.array(ids)], names=["seat", "w", "score", "id"])


def _search(pairs: DataFrame, blocks: DataFrame, chunks: DataFrame, dims: int, windows: int, keep: int, same: bool) -> DataFrame:
    """``seat, w, score, id``: rows of the chunks seen that may be among the best ``keep`` of an anchor's window."""
    spark = pairs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    span = F.lit(min(SPAN, max(1, pairs.count() // (4 * tasks))))  # how the work is dealt, not what is done
    seen = pairs.withColumn("span", F.floor(F.col("chunk") / span))
    none = F.lit(None).cast("binary")
    heads = seen.select("block", "span").distinct().join(blocks, "block").select(
        "block", "span", F.lit(-1).cast("long").alias("chunk"), none.alias("mask"), none.alias("ids"),
        "rows", "labels", "vectors", "low", "high", "least")
    bodies = seen.join(chunks, "chunk").select(
        "block", "span", "chunk", "mask", "ids", none.alias("rows"), "labels", "vectors", none.alias("low"), none.alias("high"), none.alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                chunk = row["chunk"].as_py()
                if chunk < 0:
                    if best is not None:
                        yield best.result()
                    best = Best(row, row["block"].as_py() * BLOCK, dims, windows, keep, same)
                    continue
                ids = _numbers(row["ids"])
                mask = np.unpackbits(_numbers(row["mask"], np.uint8), count=len(best.rows)).astype(bool)
                best.pass_by(chunk * CHUNK, ids, _numbers(row["labels"]), _numbers(row["vectors"], np.int32).reshape(len(ids), dims), mask)
        if best is not None:
            yield best.result()

    dealt = heads.unionByName(bodies).repartition(tasks, "block", "span").sortWithinPartitions("block", "span", "chunk")
    return dealt.mapInArrow(run, "seat long, w int, score long, id long")


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("seat", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


@contextmanager
def _few_rows_a_batch(spark: SparkSession, rows: int = 16) -> Iterator[None]:
    """A row here is a chunk or a block of some hundred kilobytes, so Arrow batches hold few of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _best(anchors: DataFrame, chunks: DataFrame, tree: Tree, dims: int, windows: int, keep: int, same: bool) -> DataFrame:
    """``seat, w, rank, score, id``: the best ``keep`` rows in each score window of each anchor."""
    first_blocks = _blocks(anchors.withColumn("least", F.col("low")), dims, windows)
    with _few_rows_a_batch(chunks.sparkSession):
        near = materialise(_ranked(_search(_pairs(first_blocks, tree, dims, windows, True), first_blocks, chunks, dims, windows, keep, same), keep), "near")
    # From here a row has to reach the last of the ones found, if there are enough.
    reach = near.where(F.col("rank") == keep).groupBy("seat").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("_reach"))
    least = F.transform("low", lambda v, w: F.coalesce(F.try_element_at(F.col("_reach"), w), v))
    blocks = _blocks(anchors.join(reach, "seat", "left").withColumn("least", least), dims, windows)
    with _few_rows_a_batch(chunks.sparkSession):
        rest = _search(_pairs(blocks, tree, dims, windows, False), blocks, chunks, dims, windows, keep, same)
        return materialise(_ranked(near.drop("rank").unionByName(rest.select("seat", "w", "score", "id")), keep), "best")


_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank`` (``vectors``: vec_id, label, vector of whole numbers).

    An anchor is a row for which ``anchor`` holds.  Its positives are the best other rows
    of its label; for each, the negatives are the best rows of other labels whose score is
    between ``low`` and ``high`` percent of the positive's.  Higher scores come first,
    then smaller ids.  A vector that is shorter than the longest counts as ending in
    zeros.  Rows with the same id are rows of their own: an anchor's twin is one of its
    other rows, and twin anchors give their results twice.  A positive with no row in its
    window gives none, and so does an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "vector", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    fitted = _fit(rows)
    if fitted is None:
        return spark.createDataFrame([], _RESULT)
    tree, dims = fitted
    ordered = _placed(rows, tree, dims)
    _measure(tree, ordered, dims)
    chunks = _chunks(ordered, dims)
    asked = ordered.where("anchor").select(F.col("row_no").alias("_row"), "vec_id", "label", "vector")
    seats = row_numbers(asked, "_row", name="anchors").withColumnRenamed("row_no", "seat").withColumnRenamed("_row", "row_no")
    everything = F.array(F.lit(_NONE).cast("long"))
    found = _best(seats.withColumns({"low": everything, "high": F.array(F.lit(-_NONE).cast("long"))}), chunks, tree, dims, 1, positives, True)
    listed = found.groupBy("seat").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    # Whole-number bounds of the windows: the score times 100 lies between the percentages of the positive's.
    shares = seats.join(listed, "seat").withColumns({
        "low": F.transform("p", lambda x: -_floored(-x["score"] * low)), "high": F.transform("p", lambda x: _floored(x["score"] * high))})
    shares = materialise(shares, "windows")
    mined = _best(shares.drop("p"), chunks, tree, dims, positives, negatives, False)
    named = shares.select("seat", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("w", "x"))
    return named.join(mined.select("seat", "w", F.col("rank").alias("_rank"), F.col("score").alias("negative_score"), F.col("id").alias("negative_id")), ["seat", "w"]).select(
        "anchor_id", F.col("x.id").alias("positive_id"), F.col("_rank").cast("int").alias("rank"), "negative_id",
        F.col("x.score").alias("positive_score"), "negative_score", F.col("x.rank").cast("int").alias("positive_rank"))


def _floored(hundredfold: Column) -> Column:
    """A long divided by 100, rounded down."""
    return F.call_function("div", hundredfold - F.pmod(hundredfold, F.lit(100)), F.lit(100))
