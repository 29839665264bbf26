"""Remove passages that an earlier document holds, found by difference-cover anchors (operator 3).

A difference cover D of period p has, for any two positions i and j, a shift k < p with
both i + k and j + k in D modulo p.  So two equal windows of ``width`` words share an
anchor: a run of ``width - p + 1`` words that begins, in both, at a cover position and
at the same place inside the window.  Anchors are hashed at cover positions only (6 of 31 for 50 words).

1. Anchors met in two documents are found by one shuffle of their hashes.
2. Anchors extend to the windows around them: windows that hold no repeated anchor
   cannot be repeated and are left out; the others' 96-bit hashes find, by a second
   shuffle, the smallest document that holds each repeated window.
3. Those windows are joined back to their documents, which drop the words they cover.

Every task reduces what it sends to one row for each hash and document extreme, so a
passage that a third of all documents share costs a row for each task.  Repeated hashes
reach the next step as a bitmap of bounded size; its false positives only send more
hashes to the exact step.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendledger.llm.common import (
    bit_table,
    documents,
    in_table,
    materialise,
    pow2_bits,
    rolling,
    word_hashes,
    words_of,
)

WIDTH = 50
#: Perfect difference sets, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
#: A repeated hash gets this many bits of the bitmap, up to 2**28 bits (32 MiB) in all.
BITS_PER_KEY, MOST_BITS = 64, 28
FLUSH = 1 << 20
_SECOND = 0xC2B2AE3D27D4EB4F


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of two fifths of the window at least, and its cover."""
    period = max(p for p in COVERS if p == 1 or width - p + 1 >= 0.4 * width)
    return period, COVERS[period]


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a document's anchors, given its words' hashes."""
    period, cover = cover_for(width)
    all_runs = rolling(h, width - period + 1)
    mark = np.zeros(period, bool)
    mark[list(cover)] = True
    at = np.flatnonzero(np.resize(mark, len(all_runs))) if len(all_runs) else np.zeros(0, np.int64)
    return at, all_runs[at]


def windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows: 64 bits and 32 more."""
    return rolling(h, width), (rolling(h, width, _SECOND) >> np.uint64(32)).astype(np.uint32)


def suspects(h: np.ndarray, width: int, repeated: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor found in the bitmap."""
    period, _ = cover_for(width)
    at, hashes = anchors(h, width)
    at = at[in_table(repeated, hashes)]
    n = len(h) - width + 1
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.clip(at - period + 1, 0, n), 1)
    np.add.at(mark, np.minimum(at + 1, n), -1)
    return np.flatnonzero(np.cumsum(mark[:n]) > 0)


def _extremes(ids: list[np.ndarray], *keys: list[np.ndarray]) -> list[np.ndarray]:
    """The least and the greatest id of each distinct key: one row for each, or one if they are the same."""
    doc = np.concatenate(ids)
    cols = [np.concatenate(k) for k in keys]
    order = np.lexsort((doc, *cols[::-1]))
    doc, cols = doc[order], [c[order] for c in cols]
    new = np.zeros(len(doc), bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    more = last[doc[last] > doc[first]]
    take = np.concatenate([first, more])
    return [doc[take], *(c[take] for c in cols)]


def _scan(docs: DataFrame, pick: Callable[[np.ndarray], tuple[np.ndarray, ...]], schema: str, extremes: bool) -> DataFrame:
    """Rows of ``doc_id`` and the arrays that ``pick`` gives for each document's word hashes.

    With ``extremes`` the rows are reduced to the least and greatest id of each key; else
    ``version`` tells texts of one id apart.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in names]
        n = 0

        def flush() -> pa.RecordBatch:
            columns = _extremes(*held) if extremes else [np.concatenate(x) for x in held]
            return pa.record_batch([pa.array(c.view({8: np.int64, 4: np.int32}[c.itemsize])) for c in columns], names=names)

        for batch in batches:
            for doc_id, text, version in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if doc_id is None:
                    continue
                found = pick(word_hashes(words_of(text.as_py())))
                if len(found[0]):
                    same = [np.full(len(found[0]), doc_id, np.int64)]
                    if not extremes:
                        same.append(np.full(len(found[0]), version, np.int32))
                    for column, values in zip(held, (*same, *found), strict=True):
                        column.append(values)
                    n += len(found[0])
                    if n >= FLUSH:
                        yield flush()
                        held, n = [[] for _ in names], 0
        if n:
            yield flush()

    return docs.mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, version, start`` of each window whose word sequence also starts in a document of a smaller id.

    ``docs`` has ``doc_id, text, version``.
    """
    context = docs.sparkSession.sparkContext
    met = _scan(docs, lambda h: anchors(h, width)[1:], "doc_id long, anchor long", True)
    again = materialise(
        met.repartition("anchor").groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        .where("a < b").select("anchor"),
        "anchors")
    table = context.broadcast(bit_table(again, "anchor", pow2_bits(again.count(), BITS_PER_KEY, MOST_BITS)))

    def pick(h: np.ndarray) -> tuple[np.ndarray, ...]:
        at = suspects(h, width, table.value) if len(h) >= width else ()
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        a, b = windows(h, width)
        return a[at], b[at]

    shared = materialise(
        _scan(docs, pick, "doc_id long, high long, low int", True).repartition("high", "low")
        .groupBy("high", "low").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .where("first_id < last_id").drop("last_id"),
        "windows")
    known = context.broadcast(bit_table(shared, "high", pow2_bits(shared.count(), BITS_PER_KEY, MOST_BITS)))

    def place(h: np.ndarray) -> tuple[np.ndarray, ...]:
        if len(h) < width:
            return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        a = rolling(h, width)
        at = np.flatnonzero(in_table(known.value, a))
        return at.astype(np.int32), a[at], windows(h, width)[1][at] if len(at) else np.zeros(0, np.uint32)

    seen = _scan(docs, place, "doc_id long, version int, start int, high long, low int", False)
    return seen.join(shared, ["high", "low"]).where("doc_id > first_id").select("doc_id", "version", "start")


def dedup_passages(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept, n_words, n_removed``; ``kept`` is the words left, joined by one space.

    Null, empty and blank texts have no word.  A document of fewer than ``width`` words
    loses none.  A passage repeated inside its smallest document stays there each time.
    Rows with the same id count as one document and lose the same words of theirs; a row
    without an id loses none and takes none from others.
    """
    plain = documents(docs, id_col, text_col).withColumn("version", F.hash("text"))
    starts = repeated_windows(plain, width).groupBy("doc_id", "version").agg(F.collect_set("start").alias("starts"))
    joined = plain.join(starts, ["doc_id", "version"], "left").select("doc_id", "text", "starts")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, at in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                n_words.append(len(words))
                if at.is_valid:
                    at = at.values.to_numpy()
                    at = at[at + width <= len(words)]
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                n_removed.append(n_words[-1] - len(words))
            yield pa.record_batch(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=["doc_id", "kept", "n_words", "n_removed"])

    return joined.mapInArrow(rebuild, "doc_id long, kept string, n_words long, n_removed long")
