"""Token counts by heap-and-linked-list byte-pair merging (operator 8).

The count of a text is its number of symbols after all merges: initial symbols minus
merges, plus the extra bytes of characters the vocabulary does not hold.  No id is
looked up or emitted.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendledger.llm.common import documents

WORDS_KEPT = 400_000
#: Longer words are counted anew each time, so that the table's size in bytes is bounded too.
LONGEST_KEPT = 48
_SPACE = "▁"
_WORD = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message (public wire format)."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte, i = data[i], i + 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, i
            shift += 7

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i:i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i:i + n], i + n
        yield key >> 3, value


class PieceCounter:
    """Count the pieces of a ``.model`` file of kind BPE with byte fallback and no text normalising.

    Only pieces of the kind *normal* take part in merges: marks of beginning and end and
    the byte pieces do not, so their strings in a text are plain text.
    """

    def __init__(self, path: str):
        self.rank: dict[str, float] = {}
        prefix, squeeze, normaliser, byte_fallback, algorithm = True, True, b"", False, 1
        with open(path, "rb") as f:
            message = f.read()
        for field, value in _fields(message):
            if field == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) == 1:
                    self.rank[piece[1].decode()] = -float(np.frombuffer(piece[2], "<f4")[0])
            elif field == 2:
                trainer = dict(_fields(value))
                algorithm, byte_fallback = trainer.get(3, 1), bool(trainer.get(35, 0))
            elif field == 3:
                rule = dict(_fields(value))
                normaliser, prefix, squeeze = rule.get(2, b""), bool(rule.get(3, 1)), bool(rule.get(4, 1))
        crossing = any(_SPACE in p.lstrip(_SPACE) for p in self.rank)
        if algorithm != 2 or normaliser or squeeze or not byte_fallback or crossing:
            raise ValueError("the model file is not byte-fallback BPE over unnormalised text with space-led pieces")
        self.prefix = _SPACE if prefix else ""
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Symbols left of one word: pop the lowest-rank adjacent pair until none is left."""
        rank, n = self.rank, len(word)
        symbol = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(word[i:i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapify(heap)
        left = n
        while heap:
            r, i, size = heappop(heap)
            a = symbol[i]
            if a is None:
                continue
            j = after[i]
            if j >= n or len(a) + len(symbol[j]) != size:
                continue
            merged = a + symbol[j]
            symbol[i], symbol[j] = merged, None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = merged + symbol[k]
                r = rank.get(pair)
                if r is not None:
                    heappush(heap, (r, i, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbol[h] + merged
                r = rank.get(pair)
                if r is not None:
                    heappush(heap, (r, h, len(pair)))
        for s in symbol:
            if s is not None and len(s) == 1 and s not in rank:
                left += len(s.encode("utf-8", "surrogatepass")) - 1
        return left

    def count(self, text: str) -> int:
        """Pieces of a whole text; an empty text has none.

        No piece holds a space after another character, so a text falls apart before
        every run of spaces, and the parts are counted one by one.
        """
        if not text:
            return 0
        marked = self.prefix + text.replace(" ", _SPACE)
        if _SPACE * 2 in marked or marked[-1] == _SPACE:
            words = _WORD.findall(marked)
        else:
            words = marked.split(_SPACE)
            head = words[0]
            words = [head, *[_SPACE + w for w in words[1:]]] if head else [_SPACE + w for w in words[1:]]
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            if len(known) > WORDS_KEPT:
                known.clear()
            for at, g in enumerate(got):
                if g is None:
                    w = words[at]
                    n = known.get(w)
                    if n is None:
                        n = self.word(w)
                        if len(w) <= LONGEST_KEPT:
                            known[w] = n
                    got[at] = n
        return sum(got)


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter for each worker process and model file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Null text is empty and has no token.  Rows stand alone: repeated rows and null ids
    give a row each, in the input's order and partitions; nothing is shuffled.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(model)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py()
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(pieces.count(text))
            tokens = np.array(n_tokens, np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
