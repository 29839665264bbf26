"""Language by hyperdimensional profiles (operator 6).

Every letter has a random vector of +1 and -1.  A trigram's vector binds its letters'
vectors, each rotated by its place, by multiplication; a text's vector bundles its
trigrams' vectors by addition.  A language's prototype bundles the trigrams of its
labelled texts, each text with the same weight.  A text gets the language whose
prototype has the largest cosine with its vector.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
UNKNOWN = "und"
GAP = 32
#: Trigrams and letters whose vectors a worker keeps (a byte for each dimension); a full table is emptied.
TRIGRAMS_KEPT, LETTERS_KEPT = 12_000, 4_096
#: Trigrams whose vectors are multiplied at once, texts bundled together, texts taken from a batch together.
STRETCH, TOGETHER, SLICE = 2_048, 64, 512
#: Trigrams that a task counts before it adds them to its vectors.
COUNTED = 100_000
#: Weights of a prototype are summed as whole numbers, so that the order of tasks does not show.
UNIT = 1 << 24
FAN = 512

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the trigrams of a whole text; other characters form gaps between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = np.concatenate(([GAP], np.where(letter, codes, GAP), [GAP])).astype(np.int64)
    gap = symbols == GAP
    symbols = symbols[~(gap & np.r_[False, gap[:-1]])]
    return np.unique(symbols[:-2] << 42 | symbols[1:-1] << 21 | symbols[2:], return_counts=True)


class Binder:
    """Vectors of trigrams, made when first met; what it keeps is bounded whatever the texts hold."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.at: dict[int, int] = {}
        self.rows = np.empty((min(1024, TRIGRAMS_KEPT), dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= LETTERS_KEPT:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64(0x5EED_0000_0000 + code)).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def bind(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of at most ``STRETCH`` different trigrams."""
        at, keys = self.at, keys.tolist()
        if len(at) + sum(k not in at for k in keys) > TRIGRAMS_KEPT:
            at.clear()
        for k in keys:
            if k not in at:
                n = at[k] = len(at)
                if n == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[n] = self.bind(k)
        return self.rows[[at[k] for k in keys]].astype(np.float32)

    def bundle(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The vector of each text, given its trigrams and counts, added up a stretch of trigrams at a time."""
        text = np.repeat(np.arange(len(texts)), [len(k) for k, _ in texts])
        used, place = np.unique(np.concatenate([k for k, _ in texts]), return_inverse=True)
        count = np.concatenate([n for _, n in texts])
        order = np.argsort(place, kind="stable")
        text, place, count = text[order], place[order], count[order]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k in range(0, len(used), STRETCH):
            part = slice(*np.searchsorted(place, [k, k + STRETCH]))
            counts = np.zeros((len(texts), min(STRETCH, len(used) - k)), np.float32)
            counts[text[part], place[part] - k] = count[part]
            out += counts @ self.vectors(used[k:k + STRETCH])
        return out


_BINDERS: dict[int, Binder] = {}


def binder(dimensions: int) -> Binder:
    if dimensions not in _BINDERS:
        _BINDERS[dimensions] = Binder(dimensions)
    return _BINDERS[dimensions]


@dataclass
class Profiles:
    """Languages and their prototypes of length one."""

    languages: list[str]
    prototypes: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; ``und`` and 0 where there is no letter (or no profile)."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        for k in range(0, len(texts), TOGETHER):
            block = [(i, g) for i, t in enumerate(texts[k:k + TOGETHER], k) if t and len((g := trigrams(t))[0])]
            if not block:
                continue
            vectors = binder(self.prototypes.shape[1]).bundle([g for _, g in block])
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            cosine = (vectors / np.maximum(length, 1e-9)) @ self.prototypes.T
            best = cosine.argmax(axis=1)
            for (i, _), b, row in zip(block, best, cosine, strict=True):
                out[i] = (self.languages[b], float(min(1.0, max(0.0, row[b]))))
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """The rows set aside for measuring: crc32 of the id as text leaves 2 when divided by 4 (a null id is not one)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


_PART = "lang string, part long, vector array<long>"


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes from all rows that have a language and a letter.

    One vector for each language comes to the driver; the number of languages is taken to be small.
    """
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[str, dict[int, int]] = {}
        totals: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, mine in weights.items():
                total = totals.setdefault(lang, np.zeros(dimensions, np.int64))
                for k, n in mine.items():
                    total += binder(dimensions).bind(k).astype(np.int64) * n
            weights.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys, counts = trigrams(text.as_py())
                if len(keys):
                    mine = weights.setdefault(lang, {})
                    for k, n in zip(keys.tolist(), (counts * UNIT // counts.sum()).tolist(), strict=True):
                        mine[k] = mine.get(k, 0) + n
                    if sum(map(len, weights.values())) > COUNTED:
                        settle()
        settle()
        if totals:
            part = TaskContext.get().partitionId() // FAN
            yield pa.RecordBatch.from_pylist(
                [{"lang": lang, "part": part, "vector": total.tolist()} for lang, total in totals.items()],
                schema=pa.schema([("lang", pa.string()), ("part", pa.int64()), ("vector", pa.list_(pa.int64()))]))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "part": [int(rows["part"].iloc[0])],
                             "vector": [np.sum(np.stack(list(rows["vector"])), axis=0)]})

    local = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(bundle, _PART)
    some = local.groupBy("lang", "part").applyInPandas(add, _PART)
    found = some.groupBy("lang").applyInPandas(add, _PART).orderBy("lang").collect()
    vectors = np.array([r["vector"] for r in found], np.float64).reshape(len(found), dimensions)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([r["lang"] for r in found], (vectors / np.maximum(length, 1e-9)).astype(np.float32))


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; ``score`` is the cosine, not below 0.

    Null, empty and letterless texts are ``und`` with score 0.  Equal cosines go to the
    language that sorts first.  Repeated rows get a row each; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE)):
                found = shared.value.predict([t.as_py() for t in part.column(2)])
                yield pa.record_batch([part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()),
                                       pa.array([s for _, s in found], pa.float64())],
                                      names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """``docs`` without texts that are ``und`` or whose score is below ``least``; all columns stay."""
    shared, at = docs.sparkSession.sparkContext.broadcast(profiles), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE)):
                found = shared.value.predict([t.as_py() for t in part.column(at)])
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
