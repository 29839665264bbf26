"""Reproducible shuffle into shards by a Feistel permutation of row numbers (operator 5).

Row ``x`` of ``n`` goes to position ``permute(x)`` of the shuffled order; position p
stands in shard ``p mod shards`` at slot ``p div shards``.  Anyone who knows ``n``, the
key and the shard count computes a row's place, and ``Permutation.inverse`` gives the
row that stands at a place.  Shard counts differ by one row at most, whatever the ids,
sizes or texts, so no source or group of copies makes a shard larger.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendledger.llm.common import documents, mix, row_numbers, utf8

ROUNDS = 6


class Permutation:
    """A permutation of 0 … n-1: a balanced Feistel network over the next even number of bits, walked until inside."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, ((max(1, n - 1)).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _forward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ (mix(left + k) & self.mask), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, np.uint64))
        while True:
            outside = np.flatnonzero(out >= np.uint64(self.n))
            if not len(outside):
                return out.astype(np.int64)
            out[outside] = step(out[outside])

    def permute(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._forward)

    def inverse(self, position: np.ndarray) -> np.ndarray:
        return self._walk(position, self._back)


def place(df: DataFrame, shards: int, key: int, order: tuple[str, ...]) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (both from 0, slots gapless within a shard).

    Rows are numbered by ``order``; rows equal in it are interchangeable.  An empty
    table stays empty.  Columns named ``row_no``, ``shard`` or ``slot`` must not be in ``df``.
    """
    numbered = row_numbers(df, *order, name="shard-rows")
    n = numbered.agg(F.coalesce(F.max("row_no") + 1, F.lit(0)).alias("n")).first()["n"]
    names = [c for c in numbered.columns if c != "row_no"]
    out = T.StructType([*numbered.select(names).schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = Permutation(n, key)
        for batch in batches:
            at = order_of.permute(batch.column(len(names)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array((at % shards).astype(np.int32)), pa.array(at // shards)],
                names=[*names, "shard", "slot"])

    return numbered.select(*names, "row_no").mapInArrow(shuffle, out)


def shard_documents(docs: DataFrame, shards: int = 16, key: int = 20_240_501,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    ``size`` is the text's UTF-8 bytes plus one (null text: one).  The law is ``rows``,
    so ``grown_shard`` is null.  A null id is numbered first; repeated rows get a slot each.
    """
    sized = documents(docs, id_col, text_col).select(
        "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(utf8(F.col("text"))).alias("text_crc32"))
    return place(sized, shards, key, ("doc_id", "text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
