"""Fill-in-the-middle samples cut at line ends (operator 11).

A text is a row of units: a line with its line feed, or what is left after the last one.
The ends of the units are a set of code point offsets, held as a two-level set: offsets
with the same upper bits share a container, which is a sorted array, a bitmap or a list
of runs, whichever is smallest.  Cumulative cardinalities find the container that holds
the k-th end by binary search, and a select inside the container finds the offset, so a
cut costs no walk over the units.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendledger.llm.common import documents, utf8

#: Offsets of a container share all bits above these.
LOW_BITS = 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class ArrayContainer:
    """Sorted low parts, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit for each possible low part, with the ones counted up to every 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << LOW_BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.upto, k, "right"))
        left, bits = k - (int(self.upto[word - 1]) if word else 0), int(self.words[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1


class RunContainer:
    """Runs of consecutive low parts, with the values counted before each run."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.start = low[first].astype(np.uint16)
        self.before = first.astype(np.int64)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form: 2 bytes a value, 2**LOW_BITS bits, or 4 bytes a run; an array where two are equal."""
    first = np.flatnonzero(np.r_[True, np.diff(low) != 1])
    if 4 * len(first) < min(2 * len(low), 1 << LOW_BITS - 3):
        return RunContainer(low, first)
    return ArrayContainer(low) if 2 * len(low) <= 1 << LOW_BITS - 3 else BitmapContainer(low)


class Boundaries:
    """A set of offsets with select."""

    def __init__(self, ends: np.ndarray):
        high = ends >> LOW_BITS
        at = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(ends) else np.zeros(0, np.int64)
        self.high = high[at].tolist()
        self.containers = [container(x) for x in np.split(ends & (1 << LOW_BITS) - 1, at[1:])] if len(ends) else []
        #: Offsets in the containers up to and with each one.
        self.upto = [*at[1:].tolist(), len(ends)] if len(ends) else []

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def cut(self, units: int) -> int:
        """The offset behind so many units."""
        if not units:
            return 0
        c = bisect_left(self.upto, units)
        return (self.high[c] << LOW_BITS) + self.containers[c].select(units - 1 - (self.upto[c - 1] if c else 0))


def boundaries(text: str) -> Boundaries:
    """The ends of a text's units, in code points."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    if text and not text.endswith("\n"):
        ends = np.append(ends, len(text))
    return Boundaries(ends)


def _draw(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers from the id."""
    digest = F.sha2(utf8(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    ``n`` counts the units.  Of the four integers drawn from the id (a null id draws as an
    empty one), the first two choose the ends of prefix and middle, the third whether the
    text is cut at all (``rate`` percent are), the fourth the form: ``spm`` (``spm``
    percent) puts the suffix first, ``psm`` the prefix.  An empty or null text, one that
    holds a mark, and one that is not cut are ``plain``: the output is the text and the
    lengths are null.  Repeated rows get a row each; an empty table gives none; nothing
    is shuffled, and a text is never cut for its length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                rows = []
                for text, h1, h2, h3, h4 in zip(part.column(1), *(part.column(k).to_pylist() for k in range(2, 6)), strict=True):
                    text = text.as_py()
                    ends = boundaries(text)
                    n = len(ends)
                    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
                        rows.append((n, "plain", None, None, text))
                        continue
                    a, b = (ends.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    pre, mid, suf = text[:a], text[a:b], text[b:]
                    form = "spm" if h4 % 100 < spm else "psm"
                    out = f"{SUFFIX}{suf}{PREFIX}{pre}{MIDDLE}{mid}" if form == "spm" else f"{PREFIX}{pre}{SUFFIX}{suf}{MIDDLE}{mid}"
                    rows.append((n, form, a, b - a, out))
                n, form, pre, mid, out = zip(*rows, strict=True)
                yield pa.record_batch(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(pre, pa.int64()),
                     pa.array(mid, pa.int64()), pa.array(out, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = documents(docs, id_col, text_col).select("doc_id", "text", *(h.alias(f"h{k}") for k, h in enumerate(_draw(F.col("doc_id"), seed))))
    return drawn.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
