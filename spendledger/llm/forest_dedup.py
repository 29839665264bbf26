"""Near-duplicate documents by a MinHash LSH forest (operator 2).

A document is the set of its word shingles.  Its signature is 64 min-hashes; a tree of the
forest is an order of the signatures that starts at other min-hashes, four further for
each of the 16 trees.  Signatures with the same first four entries of a tree's order form
a region of it; sets as alike as 0.85 share a region of some tree but for 1 in 100,000.

1. Documents with equal sets are one class; from here on a class is one vertex.
2. In each region, the classes that follow each other in sorted order share the longest
   prefix; those pairs are verified on the full sets, and the links found are contracted
   to components.
3. Regions that still hold several components are compared in full between their
   components: small ones pair by pair, larger ones block against block inside a task,
   where a block pair gives at most one link for two components; the classes of the
   region's largest component are not compared with each other.
4. A region with too many classes for that is first cut at deeper prefixes, again and
   again, which joins most of it.  The links found are contracted, and then the whole
   region is compared as in step 3: the cuts save work and decide nothing.
5. The links of all rounds give the components.

Near copies that are alike enough are joined by their sorted neighbours in step 2 and
leave nothing for step 3; no step emits all pairs of a group.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendledger.llm.common import (
    bit_table,
    documents,
    in_table,
    materialise,
    mix,
    pow2_bits,
    rolling,
    word_hashes,
    words_of,
)
from spendledger.llm.components import components

TREES, ROOT = 16, 4
HASHES = TREES * ROOT
#: Trees whose sorted neighbours are verified first; the region step uses all.
CHAINED = 4
#: Depths at which a region may be cut, and the classes above which it is cut before it is compared in full.
DEPTHS, CROWD = (4, 6, 8, 12, 16), 4096
#: Classes of a region up to which its pairs are listed, and classes of a block beyond that.
PAIRED, BLOCK = 48, 512
#: Cells of a block's incidence matrix made at once.
CELLS = 1 << 24
_KEY_BYTES = 4 * DEPTHS[-1]

_MULTIPLY = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words (A-Z lower-cased); of the whole text if it has fewer."""
    words = words_of(text, lower=True)
    return np.unique(rolling(word_hashes(words), min(size, len(words)))) if words else np.zeros(0, np.uint64)


def signature(own: np.ndarray) -> bytes:
    """Min-hashes of a set as big-endian 32-bit integers, so that byte order is number order."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 1024):
        np.minimum(least, (own[k:k + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, sig = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), size)
                digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                n.append(len(own))
                high.append(int(digest[0]))
                low.append(int(digest[1]))
                sig.append(signature(own) if len(own) else None)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, high, low)), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "high", "low", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, high long, low long, sig binary")


def _neighbours(ordered: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of rows of one region that follow each other in a range-sorted table (``region, vertex``)."""
    from pyspark import TaskContext

    names = ["a", "b", "part", "region", "first"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, head = TaskContext.get().partitionId(), None, None
        for batch in batches:
            region, vertex = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(region):
                continue
            if last is not None:
                region, vertex = np.r_[last[0], region], np.r_[last[1], vertex]
            else:
                head = (int(region[0]), int(vertex[0]))
            last = (region[-1], vertex[-1])
            same = np.flatnonzero(region[1:] == region[:-1])
            none = np.zeros(len(same), np.int64)
            gone = np.ones(len(same), bool)
            yield pa.record_batch([pa.array(vertex[same]), pa.array(vertex[same + 1]), pa.array(none, mask=gone),
                                   pa.array(none, mask=gone), pa.array(gone, mask=gone)], names=names)
        if head is not None:
            ends = [(head[1], None, part, head[0], True), (int(last[1]), None, part, int(last[0]), False)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*ends, strict=True), kinds, strict=True)], names=names)

    made = materialise(ordered.select("region", "vertex").mapInArrow(run, "a long, b long, part long, region long, first boolean"), "neighbours")
    # The last row of a partition and the first of the next: two rows for each partition.
    ends = made.where("region IS NOT NULL").selectExpr(
        "first", "a", "region", "lag(a) OVER (ORDER BY part, NOT first) AS before",
        "lag(region) OVER (ORDER BY part, NOT first) AS before_region")
    return made.where("region IS NULL").select("a", "b").unionByName(
        ends.where("first AND region = before_region").select(F.col("before").alias("a"), F.col("a").alias("b")))


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("vertex").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("vertex").alias("b"), F.col("own").alias("own_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, vertices: DataFrame, size: int) -> DataFrame:
    """``vertex, own``: the full shingle sets of some documents.

    A bitmap of their ids, bounded in size, spares the other documents' sets; the join after it is exact.
    """
    hashed = vertices.select(F.xxhash64("vertex").alias("h"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bit_table(hashed, "h", pow2_bits(vertices.count(), 32, 28)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = in_table(bitmap.value, batch.column(2).to_numpy().view(np.uint64))
            some = batch.filter(pa.array(maybe))
            own = [shingles(t.as_py(), size).tobytes() for t in some.column(1)]
            yield pa.record_batch([some.column(0), pa.array(own, pa.binary())], names=["vertex", "own"])

    made = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "vertex long, own binary")
    return made.where(F.octet_length("own") > 0).join(vertices, "vertex", "left_semi").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices in slices of shingles."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle of one set adds to no intersection of two
    column = np.cumsum(shared) - 1
    keep = shared[shingle]
    doc, column = doc[keep], column[shingle[keep]]
    out, width = np.zeros((n, n), np.float32), max(1, CELLS // n)
    for k in range(0, int(shared.sum()), width):
        part = (column >= k) & (column < k + width)
        cells = np.zeros((n, min(width, int(shared.sum()) - k)), np.float32)
        cells[doc[part], column[part] - k] = 1
        out += cells @ cells.T
    return out.astype(np.int64)


def block_links(vertex: np.ndarray, component: np.ndarray, block: np.ndarray, sets: list[np.ndarray],
                percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks (or within one), one at most for each two components."""
    both = overlaps(sets)
    size = np.array([len(x) for x in sets], np.int64)
    linked = 100 * both >= percent * (size[:, None] + size - both)
    linked &= component[:, None] < component
    if block.min() != block.max():
        linked &= block[:, None] != block
    i, j = np.nonzero(linked)
    _, one = np.unique(np.stack([component[i], component[j]]), axis=1, return_index=True)
    return vertex[i[one]], vertex[j[one]]


def _with_hub(regions: DataFrame, rows: DataFrame) -> DataFrame:
    """``regions`` with the component that has most classes there (``hub``, ``hub_classes``)."""
    counts = rows.join(regions.select("region"), "region", "left_semi").groupBy("region", "component").agg(F.count("*").alias("n"))
    hubs = counts.groupBy("region").agg(F.max(F.struct("n", "component")).alias("x"))
    return regions.join(hubs.select("region", F.col("x.component").alias("hub"), F.col("x.n").alias("hub_classes")), "region")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of large regions (``rows``: region, classes, hub, hub_classes, vertex, component).

    Every two classes of different components meet.  The blocks of the hub come after the
    others and meet only those, so a class beside a large joined family costs one row for
    each of the family's blocks.
    """
    own, others = F.ceil(F.col("hub_classes") / BLOCK).cast("int"), F.ceil((F.col("classes") - F.col("hub_classes")) / BLOCK).cast("int")
    hub = F.col("component") == F.col("hub")
    h = F.xxhash64("vertex")
    block = F.when(hub, others + F.pmod(h, own)).otherwise(F.pmod(h, others)).cast("int")
    last = F.when(hub, others - 1).otherwise(others + own - 1)
    dealt = rows.select("region", "vertex", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other")).select(
        "region", "vertex", "component", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def run(group: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["own"]]
        a, b = block_links(*(group[c].to_numpy() for c in ("vertex", "component", "block")), own, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.join(sets, "vertex").select("region", "p", "q", "vertex", "component", "block", "own").groupBy(
        "region", "p", "q").applyInArrow(run, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with their components; a class without a link is its own."""
    known = labels.select(F.col("vertex").alias("_v"), F.col("component").alias("_c"))
    return materialise(members.join(known, F.col("vertex") == F.col("_v"), "left").select(
        "region", "vertex", "n", "key", F.coalesce("_c", "vertex").alias("component")), "regions")


def _open(rows: DataFrame) -> DataFrame:
    """``region, classes`` of the regions that hold several components."""
    return rows.groupBy("region").agg(
        F.count("*").alias("classes"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("region", "classes")


def _crossing(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, paired: int, crowd: int) -> DataFrame:
    """Links between classes of one region that no link has joined yet (``members``: region, vertex, n, key)."""
    rest = _labelled(members, labels)
    pairs, links, whole = None, None, None
    for depth in DEPTHS:
        if depth > DEPTHS[0]:
            rest = rest.withColumn("region", F.xxhash64("region", F.substring("key", 1, 4 * depth)))
        sizes = materialise(_open(rest), "region-sizes")
        most = (1 << 62) if depth == DEPTHS[-1] else crowd
        few = rest.join(sizes.where(F.col("classes") <= paired), "region", "left_semi")
        left = few.select("region", F.col("vertex").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
        right = few.select("region", F.col("vertex").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
        listed = left.join(right, "region").where(
            (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
            & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b")
        pairs = listed if pairs is None else pairs.unionByName(listed)
        many = sizes.where((F.col("classes") > paired) & (F.col("classes") <= most))
        found = _block_links(rest.join(_with_hub(many, rest), "region"), sets, percent)
        links = found if links is None else links.unionByName(found)
        crowded = sizes.where(F.col("classes") > most)
        if crowded.isEmpty():
            break
        rest = materialise(rest.join(crowded, "region", "left_semi"), "regions")
        whole = rest if whole is None else whole
    links = verify(_ordered_pairs(pairs), sets, percent).unionByName(links)
    if whole is None:
        return links
    # What the cuts have joined is contracted; between all other components the crowded regions are compared in full.
    links = materialise(links, "links")
    heads = whole.select("vertex", F.col("component").alias("_h")).distinct()
    joined = links.unionByName(heads.select(F.col("vertex").alias("a"), F.col("_h").alias("b")))
    left = _labelled(whole.drop("component"), components(joined))
    return links.unionByName(_block_links(left.join(_with_hub(_open(left), left), "region"), sets, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, paired: int = PAIRED, crowd: int = CROWD,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of
    ``size``-word shingles; ``component_id`` is the smallest id reachable and ``kept``
    says that it is the document's own.  A text of fewer words is one shingle; null,
    empty and blank texts have none and are linked with nothing.  Rows with the same id
    are one document, each text of which is compared.  A row without an id is linked with nothing: its
    ``component_id`` is null and it is kept.
    """
    plain = documents(docs, id_col, text_col)
    made = materialise(_signatures(plain, size), "signatures")
    live = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(live.groupBy("high", "low").agg(F.min("doc_id").alias("vertex")), "classes")
    placed = materialise(live.join(classes, ["high", "low"]).select("doc_id", "n_shingles", "vertex"), "classed")
    # Texts of one id: their classes are joined.
    several = placed.groupBy("doc_id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b")).where("a < b").select("doc_id", "a")
    own = placed.join(several, "doc_id").select("a", F.col("vertex").alias("b")).distinct()
    signed_classes = live.join(classes.select(F.col("vertex").alias("doc_id"), "high", "low"), ["doc_id", "high", "low"], "left_semi").select(
        F.col("doc_id").alias("vertex"), F.col("n_shingles").alias("n"), "sig")

    trees = F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sig", 16 * t + 1, 16)).alias("region")) for t in range(TREES)))
    rooted = signed_classes.select("vertex", F.explode(trees).alias("x")).select("vertex", "x.*").distinct()
    shared = rooted.groupBy("region").agg(F.min("vertex").alias("v1"), F.max("vertex").alias("v2")).where("v1 < v2").select("region")
    places = materialise(rooted.join(materialise(shared, "shared-regions"), "region", "left_semi"), "places")
    turned = F.substring(F.concat(F.expr("substring(sig, 16 * tree + 1)"), F.expr("substring(sig, 1, 16 * tree)")), 1, _KEY_BYTES)
    members = materialise(places.join(signed_classes, "vertex").select("tree", "region", "vertex", "n", turned.alias("key")), "members")
    sets = materialise(_sets(plain, places.select("vertex").distinct(), size), "sets")

    ordered = members.where(F.col("tree") < CHAINED).repartitionByRange("region", "key", "vertex").sortWithinPartitions("region", "key", "vertex")
    chained = materialise(verify(_ordered_pairs(_neighbours(ordered)), sets, percent), "links")
    first = components(chained)
    links = materialise(_crossing(members.select("region", "vertex", "n", "key"), first, sets, percent, paired, crowd), "links")
    # A component of the first round stands for its members: what is left to join are components.
    heads = first.select(F.col("vertex").alias("_v"), F.col("component").alias("_c"))

    def headed(df: DataFrame, column: str) -> DataFrame:
        return df.join(heads, F.col(column) == F.col("_v"), "left").withColumn(column, F.coalesce("_c", column)).drop("_v", "_c")

    second = components(headed(headed(links.unionByName(own), "a"), "b")).select(F.col("vertex").alias("_c"), F.col("component").alias("component_id"))
    reached = (
        classes.select("vertex").distinct().join(heads, F.col("vertex") == F.col("_v"), "left").select("vertex", F.coalesce("_c", "vertex").alias("_h"))
        .join(second, F.col("_h") == F.col("_c"), "left").select("vertex", F.coalesce("component_id", "_h").alias("component_id"))
    )
    linked = placed.join(materialise(reached, "reached"), "vertex").select("doc_id", "n_shingles", "component_id")
    alone = made.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
