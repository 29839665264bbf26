"""Token-set similarity between texts and labels, on the 0-100 scale."""
from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The score travels with the query, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel row updates."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        met = row & where.get(ch, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def token_set_ratio(left: str, right: str) -> float:
    """Best of the insert/delete similarities between the shared words and each side's words."""
    ours, theirs = set(left.split()), set(right.split())
    if not ours or not theirs:
        return 0.0
    shared = ours & theirs
    only_l, only_r = " ".join(sorted(ours - theirs)), " ".join(sorted(theirs - ours))
    if shared and (not only_l or not only_r):
        return 100.0
    base = len(" ".join(sorted(shared)))
    gap = 1 if base else 0
    len_l, len_r = base + gap + len(only_l), base + gap + len(only_r)
    edits = len(only_l) + len(only_r) - 2 * _common_subsequence(only_l, only_r)

    def score(distance: int, total: int) -> float:
        return 100.0 - 100.0 * distance / total if total else 100.0

    best = score(edits, len_l + len_r)
    if base:
        best = max(best, score(gap + len(only_l), base + len_l), score(gap + len(only_r), base + len_r))
    return best


#: Texts or labels that one block holds, letters told apart, and cells compared at once.
ROWS, LETTERS, CELLS = 256, 32, 1 << 22


def _tokens(text: Column) -> Column:
    """The distinct words, parted where ``str.split`` parts them."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))


def _unmatched(length: Column, threshold: float) -> Column:
    """Letters (with their gaps) that a side may have outside the shared words, if those are to carry the score.

    With b letters shared and o not, ``1 - (1 + o) / (2 * b + 1 + o)`` has to reach the threshold.
    """
    share = threshold / 100
    k = (1 - share) / share
    return F.floor(length * (2 * k / (1 + 2 * k)))


def _words(rows: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """``folded, word, rare``: the words of each text; the rare ones come first and outweigh what may be unmatched.

    ``counts`` has the labels that hold a word; a word of none is rarest of all.
    """
    each = rows.select("folded", F.explode(_tokens(F.col("folded"))).alias("word"))
    known = each.join(counts, "word", "left").select("folded", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word").alias("w"))
    sorted_ = known.groupBy("folded").agg(F.array_sort(F.collect_set("w")).alias("ws"))  # the words of one text
    weight = lambda ws: F.aggregate(ws, F.lit(0), lambda t, w: t + F.char_length(w["word"]) + 1)
    left = _unmatched(weight(F.col("ws")), threshold)
    marked = F.transform("ws", lambda w, i: F.struct(
        w["word"].alias("word"), w["n"].alias("n"), (weight(F.slice("ws", F.lit(1), i)) <= left).alias("rare")))
    return sorted_.select("folded", F.explode(marked).alias("x")).where("x.n > 0").select("folded", "x.word", "x.rare")


def _band(length: Column, threshold: float) -> Column:
    """Bands of lengths so wide that two texts within reach lie in the same or in neighbouring ones."""
    share = threshold / 100
    return F.floor(F.log(length) / math.log((2 - share) / share + 1e-9)).cast("int")


def _packed(rows: DataFrame, band: Column) -> DataFrame:
    """``band, texts``: texts of one band in blocks of at most ``ROWS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[str]] = {}

        def block(band: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array([band], pa.int32()), pa.array([held.pop(band)], pa.list_(pa.string()))], names=["band", "texts"])

        for batch in batches:
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(b, []).append(text)
                if len(held[b]) == ROWS:
                    yield block(b)
        for b in list(held):
            yield block(b)

    return rows.select(band.alias("band"), "folded").mapInArrow(run, "band int, texts array<string>")


def letter_counts(texts: Sequence[str]) -> np.ndarray:
    """How often each text's distinct words have each letter, letters dealt to ``LETTERS`` kinds."""
    out = np.zeros((len(texts), LETTERS), np.int16)
    for row, text in zip(out, texts):
        codes = np.frombuffer("".join(set(text.split())).encode("utf-32-le", "surrogatepass"), "<u4") % LETTERS
        row[:] = np.bincount(codes, minlength=LETTERS)
    return out


def near_pairs(left: Sequence[str], right: Sequence[str], threshold: float) -> Iterator[tuple[str, str, float]]:
    """Pairs at or above the threshold.

    Shared words have the same letters, so the edits of what is left are no fewer than
    the letters by which the two texts differ; only pairs that this lets through are scored.
    """
    a, b = letter_counts(left), letter_counts(right)
    size = lambda texts: np.array([len(" ".join(set(t.split()))) for t in texts])
    n, m = size(left), size(right)
    step = max(1, CELLS // (LETTERS * max(1, len(right))))
    for k in range(0, len(left), step):
        apart = np.abs(a[k:k + step, None] - b).sum(axis=2)
        i, j = np.nonzero(apart <= (100 - threshold) / 100 * (n[k:k + step, None] + m) + 1e-9)
        for x, y in zip((i + k).tolist(), j.tolist()):
            score = token_set_ratio(left[x], right[y])
            if score >= threshold:
                yield left[x], right[y], score


_PAIR = "folded string, label string, score double"


def _rows(pairs: list[tuple[str, str, float]]) -> pa.RecordBatch:
    a, b, s = zip(*pairs) if pairs else ((), (), ())
    return pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())], names=["folded", "label", "score"])


def similar_labels(texts: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``folded, code, label, score``: the most similar label of each distinct text that has one.

    ``texts``: folded; ``labels``: code, folded.  Both are tables of any size and meet in joins:

    * by word, where shared words carry the score: the rare words of either side with all
      words of the other, so that a frequent word joins only texts that have no other;
    * by length, where letters carry it: blocks of one band with blocks of the same and the
      neighbouring bands, letters counted before anything is scored.

    Ties go to the smaller code.
    """
    distinct = texts.where("folded <> ''").select("folded").distinct()
    named = labels.where("code IS NOT NULL AND folded <> ''").groupBy("folded").agg(F.max("code").alias("code"))
    spread = named.select("folded", F.explode(_tokens(F.col("folded"))).alias("word"))
    counts = spread.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ours, theirs = _words(distinct, counts, threshold), _words(named, counts, threshold).withColumnRenamed("folded", "label")
    met = ours.where("rare").drop("rare").join(theirs.drop("rare"), "word").unionByName(
        ours.drop("rare").join(theirs.where("rare").drop("rare"), "word")).select("folded", "label").distinct()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield _rows([(a, b, s) for a, b in pairs if (s := token_set_ratio(a, b)) >= threshold])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _rows(list(near_pairs(left, right, threshold)))

    length = F.char_length(F.array_join(_tokens(F.col("folded")), " "))
    near = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")
    left = _packed(distinct.where(length > 0), _band(length, threshold)).withColumnRenamed("texts", "left")
    right = _packed(named.where(length > 0), _band(length, threshold)).select(near, F.col("texts").alias("right"))
    blocks = left.join(right, "band").select("left", "right")
    scored = met.mapInArrow(score, _PAIR).unionByName(blocks.mapInArrow(compare, _PAIR))
    with_code = scored.join(named.select(F.col("folded").alias("label"), "code"), "label")
    best = with_code.groupBy("folded").agg(F.min_by(F.struct("code", "label", "score"), F.struct(-F.col("score"), "code")).alias("b"))
    return best.select("folded", "b.*")
