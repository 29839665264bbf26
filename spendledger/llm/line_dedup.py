"""Drop lines that other documents hold too, with two Bloom filters in front (operator 4).

A line's key is the line without white space at both ends and with A-Z lower-cased.
Tasks build two filters over the keys of their documents: one of keys seen once, one of
keys seen a second time.  Merging two tasks' filters moves what is in both "once"
filters to "twice".  A key that two documents hold is in the final "twice" filter for
certain, so only keys found there are shuffled, as 128-bit hashes, to confirm the repeat
and to choose the smallest document.  The filter's size is fixed (``2**bits`` bits), which
bounds what is sent to tasks; as the input outgrows it more keys pass and the exact step
does more of the work, with the same result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendledger.llm.common import WHITE, documents, materialise

BITS = 28
LEAST = 10
SEGMENT = 18
FLUSH = 1 << 20
FAN = 512


def line_key(line: str, least: int = LEAST) -> bytes | None:
    """The key of a line, or None if it is too short to be compared."""
    bare = line.strip(WHITE)
    return bare.encode("utf-8", "surrogatepass").lower() if len(bare) >= least else None


def keys_of(text: str, least: int) -> set[bytes]:
    return {k for k in (line_key(x, least) for x in text.split("\n")) if k is not None}


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each hash, both in the hash's segment of the filter."""
    first = h & np.uint64((1 << bits) - 1)
    second = (first >> np.uint64(SEGMENT) << np.uint64(SEGMENT)) | (h >> np.uint64(40) & np.uint64((1 << SEGMENT) - 1))
    return first, second


def _hashes(keys: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _local(hashes: list[np.ndarray], bits: int, part: int) -> Iterator[dict]:
    """The filters of some documents, a row for each segment; positions while few, else a bitmap."""
    seen, times = np.unique(np.concatenate(hashes), return_counts=True)

    def by_segment(h: np.ndarray) -> dict[int, np.ndarray]:
        p = np.unique(np.concatenate(_probes(h, bits)))
        segment = (p >> np.uint64(SEGMENT)).astype(np.int64)
        cut = np.flatnonzero(np.diff(segment)) + 1
        low = (p & np.uint64((1 << SEGMENT) - 1)).astype("<u4")
        return {int(segment[i]): low[i:j] for i, j in zip([0, *cut], [*cut, len(p)], strict=True)} if len(p) else {}

    once, twice = by_segment(seen), by_segment(seen[times > 1])
    for s, p in once.items():
        yield {"segment": s, "part": part, "once": _pack(p), "twice": _pack(twice.get(s, p[:0]))}


_DENSE = (1 << SEGMENT) // 8


def _pack(positions: np.ndarray) -> bytes:
    if 4 * len(positions) < _DENSE:
        return positions.tobytes()
    bits = np.zeros(1 << SEGMENT, bool)
    bits[positions] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _bitmap(data: bytes) -> np.ndarray:
    if len(data) == _DENSE:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(1 << SEGMENT, bool)
    bits[np.frombuffer(data, "<u4")] = True
    return np.packbits(bits, bitorder="little")


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(_DENSE, np.uint8), np.zeros(_DENSE, np.uint8)
    for o, t in zip(rows["once"], rows["twice"], strict=True):
        o, t = _bitmap(o), _bitmap(t)
        twice |= t | (once & o)
        once |= o
    packed = [np.flatnonzero(np.unpackbits(x, bitorder="little")).astype("<u4") for x in (once, twice)]
    return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "part": [int(rows["part"].iloc[0])],
                         "once": [_pack(packed[0])], "twice": [_pack(packed[1])]})


_FILTER = "segment long, part long, once binary, twice binary"


def twice_seen(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """The merged filter of keys that two documents may hold: ``2**bits`` bits, whatever the input."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId(), [], 0
        shape = pa.schema([("segment", pa.int64()), ("part", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])
        for batch in batches:
            for value in batch.column(0):
                held.append(_hashes(keys_of(value.as_py(), least)))
                n += len(held[-1])
            if n >= FLUSH:
                yield pa.RecordBatch.from_pylist(list(_local(held, bits, part)), schema=shape)
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pylist(list(_local(held, bits, part)), schema=shape)

    local = docs.select("text").mapInArrow(build, _FILTER)
    # At most FAN filters meet in a group, and a filter's segment is 32 KiB at most.
    some = local.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("segment", "part").applyInPandas(_merge, _FILTER)
    merged = some.groupBy("segment").applyInPandas(_merge, _FILTER)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in merged.select("segment", "twice").toLocalIterator():
        out[r["segment"] * _DENSE:(r["segment"] + 1) * _DENSE] = _bitmap(bytes(r["twice"]))
    return out


def repeats(docs: DataFrame, bits: int = BITS, least: int = LEAST) -> DataFrame:
    """``doc_id, drop``: the key hashes that a document loses, for documents that lose any."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(twice_seen(docs, bits, least))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value

        def maybe(p: np.ndarray) -> np.ndarray:
            return (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            ids, high, low = [], [], []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = list(keys_of(value.as_py(), least))
                if doc_id is None or not keys:
                    continue
                first, second = _probes(_hashes(keys), bits)
                for at in np.flatnonzero(maybe(first) & maybe(second)):
                    h = _wide(keys[at])
                    ids.append(doc_id)
                    high.append(h[0])
                    low.append(h[1])
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, high, low)], names=["doc_id", "high", "low"])

    found = materialise(docs.mapInArrow(suspects, "doc_id long, high long, low long"), "line-suspects")
    twice = materialise(
        found.groupBy("high", "low").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .where("first_id < last_id").drop("last_id"),
        "line-repeats",
    )
    return (
        found.join(twice, ["high", "low"]).where("doc_id > first_id")
        .groupBy("doc_id").agg(F.collect_set(F.struct("high", "low")).alias("drop"))
    )


def _wide(key: bytes) -> tuple[int, int]:
    data = xxhash.xxh3_128_digest(key)
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def _without(text: str, drop: list[dict] | None, least: int) -> tuple[str, int, int]:
    """The text without the lines whose key hashes are in ``drop``, its lines before, and the lines gone."""
    lines = text.split("\n")
    if not drop:
        return text, len(lines), 0
    gone = {(x["high"], x["low"]) for x in drop}
    left = [x for x in lines if (k := line_key(x, least)) is None or _wide(k) not in gone]
    return "\n".join(left), len(lines), len(lines) - len(left)


def dedup_lines(docs: DataFrame, bits: int = BITS, least: int = LEAST,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept, n_lines, n_dropped`` of every document; ``kept`` is the text left.

    Null or empty text is one empty line.  Keys below ``least`` code points stay.  A line
    repeated inside the smallest document that holds it stays there each time.  Rows with
    the same id count as one document and lose the same lines; a row without an id loses
    none and takes none from others.
    """
    plain = documents(docs, id_col, text_col)
    joined = plain.join(repeats(plain, bits, least).withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_without(t.as_py(), d.as_py(), least) for t, d in zip(batch.column(1), batch.column(2), strict=True)]
            kept, n_lines, n_dropped = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=["doc_id", "kept", "n_lines", "n_dropped"])

    return joined.select("doc_id", "text", "drop").mapInArrow(rebuild, "doc_id long, kept string, n_lines long, n_dropped long")


def remove_lines(docs: DataFrame, bits: int = BITS, least: int = LEAST,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines dropped from their texts; all other columns stay as they are.

    A document that had words and has none left goes; one that had none stays.
    """
    names, at, schema = docs.columns, docs.columns.index(text_col), docs.schema
    lost = repeats(documents(docs, id_col, text_col), bits, least).select(F.col("doc_id").alias("__line_id"), F.col("drop").alias("__line_drop"))
    joined = docs.join(lost, F.col(id_col).cast("long") == F.col("__line_id"), "left").select(*names, "__line_drop")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], []
            for value, drop in zip(batch.column(at), batch.column(len(names)), strict=True):
                text = value.as_py()
                kept = text if text is None or not drop.is_valid else _without(text, drop.as_py(), least)[0]
                texts.append(kept)
                stay.append(kept is text or bool(kept.strip(WHITE)) or not text.strip(WHITE))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    return joined.mapInArrow(rebuild, schema)
