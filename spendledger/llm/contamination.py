"""Find benchmark passages in documents (operator 7).

For every item a window of the item's number of words slides over each document; its
score is the exact weighted share of the item's word shingles that the window holds.  An
index holds of each item only its rarest shingles, as many as weigh more than the share
that may be missing: a window without any of them cannot reach the threshold, so every
item that does is a candidate.  A candidate's windows are all scored at once: each
occurrence of one of its shingles counts for one run of window starts.
"""
from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendledger.llm.common import documents, rolling, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Bytes of item text that one pass over the documents looks for; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20

_PLAIN = bytes(ord(c.lower()) if c.isascii() and c.isalnum() else (i if i > 127 else 32) for i, c in ((i, chr(i)) for i in range(256)))
assert all(_PLAIN[ord(c)] == 32 for c in string.punctuation)


def plain_words(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space part them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges ``a[k]`` to ``b[k] - 1``, one range after the other."""
    n = b - a
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())


class Shingles:
    """The items whose shingles have one width: vocabulary, weights, and the index of rare shingles."""

    def __init__(self, width: int, rows: list[tuple[int, list[bytes]]], similarity: float):
        self.width, self.similarity = width, similarity
        made = []
        for item_id, words in rows:
            letters = np.convolve([len(w) for w in words], np.ones(width, np.int64), "valid")
            own, first, times = np.unique(rolling(word_hashes(words), width), return_index=True, return_counts=True)
            made.append((item_id, len(words), own, letters[first], times))
        self.vocabulary, used = np.unique(np.concatenate([own for _, _, own, _, _ in made]), return_counts=True)
        self.coarse = self._bitmap(self.vocabulary)
        #: ``item_id, words, shingles as places in the vocabulary, letters and count of each, total weight``
        self.items = []
        rare, holder = [], []
        for k, (item_id, size, own, letters, times) in enumerate(made):
            own, weight = np.searchsorted(self.vocabulary, own), letters * times
            total = int(weight.sum())
            self.items.append((item_id, size, own, letters, times, total))
            order = np.argsort(used[own], kind="stable")
            missing = (total - np.cumsum(weight[order])) / total < similarity
            rare.append(own[order[:int(missing.argmax()) + 1 if missing.any() else len(order)]])
            holder.append(np.full(len(rare[-1]), k))
        rare, holder = np.concatenate(rare), np.concatenate(holder)
        order = np.argsort(rare, kind="stable")
        self.holders = holder[order]
        self.starts = np.searchsorted(rare[order], np.arange(len(self.vocabulary) + 1))

    @staticmethod
    def _bitmap(h: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << max(16, (16 * len(h)).bit_length()), bool)
        out[(h & np.uint64(len(out) - 1)).astype(np.int64)] = True
        return out

    def _shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the shingles that some item has, and their places in the vocabulary; by place, then position."""
        s = rolling(h, self.width)
        at = np.flatnonzero(self.coarse[(s & np.uint64(len(self.coarse) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, s[at]), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == s[at]
        at, place = at[known], place[known]
        order = np.argsort(place, kind="stable")
        return at[order], place[order]

    def find(self, h: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """``(item_id, first word, words, share)`` of the first best window of each item found."""
        at, place = self._shared(h)
        here = np.unique(place)
        for k in np.unique(self.holders[_ranges(self.starts[here], self.starts[here + 1])]).tolist():
            item_id, size, own, letters, times, total = self.items[k]
            a, b = np.searchsorted(place, own), np.searchsorted(place, own, "right")
            n = b - a
            if int((np.minimum(n, times) * letters).sum()) / total < self.similarity:
                continue
            size = min(size, len(h))
            p, needed, weight = at[_ranges(a, b)], np.repeat(times, n), np.repeat(letters, n)
            # An occurrence counts where the window holds it and fewer than ``needed`` occurrences before it.
            begin, end = np.maximum(p - size + self.width, 0), np.minimum(p, len(h) - size)
            again = np.flatnonzero(np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) >= needed)
            begin[again] = np.maximum(begin[again], p[again - needed[again]] + 1)
            held = begin <= end
            begin, end, weight = begin[held], end[held], weight[held]
            starts, by_begin, by_end = np.unique(begin), np.argsort(begin), np.argsort(end)
            begun, ended = np.r_[0, np.cumsum(weight[by_begin])], np.r_[0, np.cumsum(weight[by_end])]
            score = begun[np.searchsorted(begin[by_begin], starts, "right")] - ended[np.searchsorted(end[by_end], starts)]
            best = int(score.argmax())
            share = int(score[best]) / total
            if share >= self.similarity:
                yield item_id, int(starts[best]), size, share


class Items:
    """The benchmark items of one pass, by the width of their shingles."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY):
        by_width: dict[int, list[tuple[int, list[bytes]]]] = {}
        for item_id, text in rows:
            words = plain_words(text or "")
            if words and item_id is not None:
                by_width.setdefault(min(SHINGLE, len(words)), []).append((item_id, words))
        self.widths = [Shingles(w, items, similarity) for w, items in sorted(by_width.items())]

    def find(self, text: str) -> list[tuple[int, int, int, float]]:
        """``(item_id, first word, words, share)`` of each item found, by its best window."""
        words = plain_words(text)
        h = word_hashes(words)
        best: dict[int, tuple[int, int, float]] = {}
        for shingles in self.widths:
            if shingles.width <= len(words):
                for item_id, start, size, share in shingles.find(h):
                    if share > best.get(item_id, (0, 0, 0.0))[2]:
                        best[item_id] = (start, size, share)
        return [(i, *b) for i, b in sorted(best.items())]


def passes(benchmark: DataFrame, similarity: float = SIMILARITY, item_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of ``PASS_BYTES``, which bounds what is sent to tasks at once."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        rows.append((r["i"], r["t"]))
        size += len(r["t"] or "")
        if size >= PASS_BYTES:
            yield Items(rows, similarity)
            rows, size = [], 0
    if rows:
        yield Items(rows, similarity)


def find_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, word_start, n_words, similarity``: each item found in each document.

    Null and empty texts hold nothing; an item without a word, or without an id, is never
    found; items of fewer than five words are compared as a whole; a document shorter than
    an item is one window.  Items of equal text are all reported, and so are repeated rows.
    """
    spark, out = docs.sparkSession, None
    shape = "doc_id long, item_id long, word_start long, n_words long, similarity double"
    for items in passes(benchmark, similarity):
        shared = spark.sparkContext.broadcast(items)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                        for m in shared.value.find(t.as_py())]
                if rows:
                    a, b, c, d, e = zip(*rows, strict=True)
                    yield pa.record_batch([*(pa.array(x, pa.int64()) for x in (a, b, c, d)), pa.array(e, pa.float64())],
                                          names=["doc_id", "item_id", "word_start", "n_words", "similarity"])

        found = documents(docs, id_col, text_col).mapInArrow(look, shape)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], shape)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                        text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay, nothing is shuffled."""
    for items in passes(benchmark, similarity):
        shared, at = docs.sparkSession.sparkContext.broadcast(items), docs.columns.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not (t.is_valid and shared.value.find(t.as_py())) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
