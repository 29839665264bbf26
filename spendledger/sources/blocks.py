"""Records of one file found by many tasks at once.

Spark reads a large file in blocks.  Where a record may cross a block's edge, or a
character means something else inside quotes, a block cannot be cut without knowing the
state at its start.  What a block does to that state is a small value that can be composed
with that of the block after it: every block gives its own in parallel, one row for each
block is folded in order, and then every block is cut with its true start.

* Delimited text: the state is one bit, inside quotes or not.  Lines are landed once with
  what follows from either start, so the source is read once.
* JSON: the state is that bit and the open brackets.  A block's effect is the brackets it
  closes and those it leaves open, for either value of the bit.

Only records that cross an edge are put together from pieces by a shuffle.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored



def _earlier(column: str) -> Column:
    """Sum over the blocks of the file before this one; tables here have one row a block."""
    return F.coalesce(F.sum(column).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file, block, text``: the file cut at every ``separator``, which is left out, in the order of each block."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, bool]]:
    """The pieces of each block in order: ``file, block, texts, is this the block's first part``."""
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(1).to_numpy()
        file = batch.column(0).dictionary_encode()
        code = file.indices.to_numpy()
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            key = (file.dictionary[int(code[a])].as_py(), int(block[a]))
            yield *key, batch.column(2).slice(a, b - a), key != at
            at = key


# --- delimited text -------------------------------------------------------

def _marked_lines(lines: DataFrame, quote: str) -> DataFrame:
    """Lines with what follows from either start of their block: state before and after, records begun up to and with the line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parity, begun, place = 0, [0, 0], 0
        for file, block, texts, first in _runs(batches):
            if first:
                parity, begun, place = 0, [0, 0], 0
            quotes = pc.count_substring(texts, quote).to_numpy(zero_copy_only=False)
            after = (parity + np.cumsum(quotes)) % 2
            before = np.r_[parity, after[:-1]]
            blank = pc.equal(pc.utf8_trim_whitespace(texts), "").to_numpy(zero_copy_only=False)
            columns = []
            for start in (0, 1):
                inside = before ^ start
                begins = ~blank & (inside == 0)
                number = begun[start] + np.cumsum(begins)
                begun[start] = int(number[-1])
                columns += [pa.array(inside == 1), pa.array(begins), pa.array(number)]
            n = len(texts)
            yield pa.record_batch(
                [pa.array([file] * n), pa.array(np.full(n, block)), pa.array(np.arange(place, place + n)), texts, pa.array(after.astype(np.int64)), *columns],
                names=["file", "block", "place", "text", "after", "inside0", "begins0", "number0", "inside1", "begins1", "number1"])
            place, parity = place + n, int(after[-1])

    return lines.mapInArrow(run, "file string, block long, place long, text string, after long, inside0 boolean, begins0 boolean,"
                                 " number0 long, inside1 boolean, begins1 boolean, number1 long")


def quoted_records(spark: SparkSession, path: str, quote: str = '"', encoding: str = "UTF-8") -> DataFrame:
    """``source_file, ordinal, record``: records of delimited text whose quoted fields may hold line breaks.

    ``ordinal`` counts the records of a file from 1; blank lines outside quotes are no records.
    The encoding must leave line feeds and quotes single bytes.
    """
    lines = _pieces(spark, path, "\n")
    if encoding.upper().replace("-", "") not in ("UTF8", "UTF8SIG"):
        lines = lines.withColumn("text", F.decode(F.col("text").cast("binary"), encoding))
    landed = stored(_marked_lines(lines, quote), "marked-lines")
    ends = landed.groupBy("file", "block").agg(
        F.max_by("after", "place").alias("odd"), F.max("number0").alias("n0"), F.max("number1").alias("n1"))
    odd = _earlier("odd") % 2
    started = ends.withColumn("start", odd).withColumn("n", F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1")))
    blocks = started.select("file", "block", "start", _earlier("n").alias("earlier"))

    def pick(name: str) -> Column:
        return F.when(F.col("start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    # A file has a row for each of its blocks: every task that reads lines gets this table, and no line is shuffled for it.
    placed = landed.join(F.broadcast(blocks), ["file", "block"]).select(
        "file", "block", "place", "text", pick("inside").alias("inside"), pick("begins").alias("begins"),
        F.col("after").bitwiseXOR(F.col("start")).alias("after"),
        (F.col("earlier") + pick("number")).alias("ordinal"))
    parts = placed.where("begins OR inside")
    whole = parts.where("begins AND after = 0").select("file", "ordinal", "text")
    pieces = parts.where("NOT (begins AND after = 0)").groupBy("file", "ordinal").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(pieces).select(
        F.col("file").alias("source_file"), "ordinal", F.regexp_replace("text", "\r$", "").alias("record"))


# --- JSON -----------------------------------------------------------------

_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))
#: Stands for an array's content in the text around it; no JSON string may hold its first character.
_MARK = "\x01%d:%d"


class Scanner:
    """Quotes, brackets and commas of a run of bytes, given whether it starts inside a string."""

    def __init__(self, text: bytes, inside: bool):
        self.bytes = b = np.frombuffer(text, np.uint8)
        slash, at = b == ord("\\"), np.arange(len(b))
        # A quote is escaped by an odd run of backslashes before it.
        run = at - np.maximum.accumulate(np.where(slash, -1, at))
        quote = (b == ord('"')) & ~np.r_[False, run[:-1] % 2 == 1]
        parity = (np.cumsum(quote) + inside) % 2
        self.inside_after = bool(parity[-1])
        outside = (parity == 0) & ~quote
        self.opens = outside & ((b == _OPEN[0]) | (b == _OPEN[1]))
        self.closes = outside & ((b == _CLOSE[0]) | (b == _CLOSE[1]))
        self.commas = outside & (b == ord(","))
        self.level = np.cumsum(self.opens.astype(np.int64) - self.closes)

    def effect(self) -> tuple[int, str]:
        """Brackets of earlier text that the run closes, and those of its own that it leaves open."""
        later = np.minimum.accumulate(self.level[::-1])[::-1]
        left = self.bytes[self.opens & (later >= self.level)]
        return max(0, -int(self.level.min())), left.tobytes().decode()


def after(state: str, effect: tuple[int, str]) -> str:
    """Open brackets after an effect; one close too many at a document's end closes nothing."""
    closed, left = effect
    return state[:max(0, len(state) - closed)] + left


def composed(first: tuple[int, str], second: tuple[int, str]) -> tuple[int, str]:
    """The effect of one run and then another."""
    return first[0] + max(0, second[0] - len(first[1])), after(first[1], second)


def _joined(texts: pa.Array) -> bytes:
    """The pieces with the brackets that parted them."""
    return b"".join(t.as_buffer().to_pybytes() + b"}" for t in texts)


_EFFECT = "file string, block long, start int, inside int, closed int, open string"
#: Pieces looked at together.
_STRETCH = 2048


def _effects(pieces: DataFrame) -> DataFrame:
    """What each block does, for either start: inside a string after it, brackets closed, brackets left open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, [(False, (0, "")), (True, (0, ""))]

        def out() -> pa.RecordBatch:
            rows = [(*key, s, int(inside), *effect) for s, (inside, effect) in enumerate(now)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)],
                names=["file", "block", "start", "inside", "closed", "open"])

        for file, block, texts, first in _runs(batches):
            if first:
                if key is not None:
                    yield out()
                key, now = (file, block), [(False, (0, "")), (True, (0, ""))]
            for k in range(0, len(texts), _STRETCH):
                text = _joined(texts[k:k + _STRETCH])
                for s in (0, 1):
                    found = Scanner(text, now[s][0])
                    now[s] = (found.inside_after, composed(now[s][1], found.effect()))
        if key is not None:
            yield out()

    return pieces.mapInArrow(run, _EFFECT)


def _starts(effects: DataFrame) -> DataFrame:
    """``file, block, inside, open``: the state at the start of each block, by folding two rows a block."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        inside, stack, out = 0, "", []
        for block, both in rows.groupby("block", sort=True):
            out.append((rows["file"].iloc[0], block, inside, stack))
            r = both[both["start"] == inside].iloc[0]
            inside, stack = int(r["inside"]), after(stack, (int(r["closed"]), r["open"]))
        return pd.DataFrame(out, columns=["file", "block", "inside", "open"])

    return effects.groupBy("file").applyInPandas(fold, "file string, block long, inside int, open string")


class Cutter:
    """One block of a document cut into the elements of its arrays at ``depth``.

    ``rows``: ``element`` for a whole one, ``part`` for one that crosses the block's edge,
    ``around`` for the text outside with a mark for each array's content, ``count`` with the
    element starts of the block; ``place`` counts those from 1.
    """

    def __init__(self, block: int, depth: int, inside: bool, open_: str):
        self.block, self.depth, self.inside, self.level = block, depth, inside, len(open_)
        self.in_array = len(open_) >= depth and open_[depth - 1] == "["
        self.place, self.held, self.whole, self.around = 0, b"", False, b""
        self.rows: list[tuple[str, int | None, str | None]] = []

    def _element(self, text: bytes) -> None:
        if not self.whole or text.strip():
            self.rows.append(("element" if self.whole else "part", self.place, text.decode("utf-8", "replace")))

    def take(self, text: bytes) -> None:
        found, last = Scanner(text, self.inside), 0
        level = found.level + self.level
        edge = (found.opens & (level == self.depth)) | (found.closes & (level == self.depth - 1)) | (found.commas & (level == self.depth))
        for at in np.flatnonzero(edge).tolist():
            if found.opens[at]:
                if found.bytes[at] == _OPEN[1]:
                    self.place += 1
                    self.around += text[last:at + 1] + b'"' + (_MARK % (self.block, self.place)).encode() + b'"'
                    self.in_array, self.held, self.whole, last = True, b"", True, at + 1
            elif self.in_array:
                self._element(self.held + text[last:at])
                self.held, self.whole = b"", True
                if found.closes[at]:
                    self.in_array, last = False, at
                else:
                    self.place, last = self.place + 1, at + 1
        if self.in_array:
            self.held += text[last:]
        else:
            self.around += text[last:]
        self.inside, self.level = found.inside_after, int(level[-1])

    def end(self) -> None:
        if self.in_array:
            self.rows.append(("part", self.place, self.held.decode("utf-8", "replace")))
        self.rows.append(("around", None, self.around.decode("utf-8", "replace")))
        self.rows.append(("count", self.place, None))


def _cut(pieces: DataFrame, depth: int) -> DataFrame:
    """``file, block, kind, place, text`` from pieces with the state at their block's start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter = None, None

        def out() -> pa.RecordBatch:
            kind, place, text = zip(*cutter.rows, strict=True)
            n, cutter.rows = len(kind), []
            return pa.record_batch([pa.array([key[0]] * n), pa.array([key[1]] * n), pa.array(kind, pa.string()),
                                    pa.array(place, pa.int64()), pa.array(text, pa.string())], names=["file", "block", "kind", "place", "text"])

        for batch in batches:
            at = 0
            for file, block, texts, _ in _runs(iter([batch.select([0, 1, 2])])):
                if key != (file, block):
                    if cutter is not None:
                        cutter.end()
                        yield out()
                    key = (file, block)
                    cutter = Cutter(block, depth, bool(batch.column(3)[at].as_py()), batch.column(4)[at].as_py())
                for k in range(0, len(texts), _STRETCH):
                    cutter.take(_joined(texts[k:k + _STRETCH]))
                    if cutter.rows:
                        yield out()
                at += len(texts)
        if cutter is not None:
            cutter.end()
            yield out()

    return pieces.mapInArrow(run, "file string, block long, kind string, place long, text string")


def _ranges(around: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``file, first_block, first_place, next_block, next_place``: where the array under ``keys`` starts, and the array after it.

    One task for each file puts together what stands outside the arrays.
    """
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        text = "".join(rows.sort_values("block")["text"]).lstrip("\ufeff \t\r\n")
        marks = sorted((int(b), int(p)) for b, p in re.findall("\x01([0-9]+):([0-9]+)", text))
        out = []
        try:
            value, _ = json.JSONDecoder(strict=False).raw_decode(text)
            for key in keys:
                value = value[key]
            if isinstance(value, list) and value and str(value[0])[:1] == "\x01":
                mine = tuple(map(int, value[0][1:].split(":")))
                after_it = marks[marks.index(mine) + 1:][:1] or [(None, None)]
                out.append((rows["file"].iloc[0], *mine, *after_it[0]))
        except (ValueError, KeyError, TypeError, IndexError):
            pass  # no document, or no such array in it: the file has no record
        return pd.DataFrame(out, columns=["file", "first_block", "first_place", "next_block", "next_place"]).astype(
            {"first_block": "Int64", "first_place": "Int64", "next_block": "Int64", "next_place": "Int64"})

    return around.groupBy("file").applyInPandas(
        find, "file string, first_block long, first_place long, next_block long, next_place long")


def json_elements(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """``source_file, ordinal, element``: the elements of the array under ``keys`` (at the root without any) of each document, as text.

    Documents are cut by all tasks that read them: once for the state at each block's
    start, once to cut.  Besides records that cross edges, only the text outside of the
    arrays at that depth is put together in one place.
    """
    pieces = _pieces(spark, path, "}")
    # One row for each block of the input goes to every task that reads.
    known = pieces.join(F.broadcast(_starts(_effects(pieces))), ["file", "block"])
    landed = stored(_cut(known.select("file", "block", "text", "inside", "open"), len(keys) + 1), "json-pieces")
    counts = landed.where("kind = 'count'").select("file", "block", _earlier("place").alias("earlier"))
    found = _ranges(landed.where("kind = 'around'").select("file", "block", "text"), keys)
    first = counts.select("file", F.col("block").alias("first_block"), F.col("earlier").alias("_e1"))
    behind = counts.select("file", F.col("block").alias("next_block"), F.col("earlier").alias("_e2"))
    ranges = found.join(first, ["file", "first_block"]).join(behind, ["file", "next_block"], "left").select(
        "file", (F.col("_e1") + F.col("first_place")).alias("first"), (F.col("_e2") + F.col("next_place")).alias("next"))
    # One row for each block here too: no record is shuffled to meet its file, which may hold any share of them.
    places = counts.join(ranges, "file")
    numbered = landed.where("kind IN ('element', 'part')").join(F.broadcast(places), ["file", "block"]).select(
        "file", "block", "kind", "text", (F.col("earlier") + F.col("place") - F.col("first") + 1).alias("ordinal"),
        (F.col("next") - F.col("first")).alias("n")).where("ordinal >= 1 AND (n IS NULL OR ordinal <= n)")
    whole = numbered.where("kind = 'element'").select("file", "ordinal", "text")
    crossing = numbered.where("kind = 'part'").groupBy("file", "ordinal").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"))
    return whole.unionByName(crossing.where(F.col("text").rlike(r"\S"))).select(
        F.col("file").alias("source_file"), "ordinal", F.col("text").alias("element"))
