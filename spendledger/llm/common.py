"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendledger.session import scratch_path

#: The characters that end a word or a line's edge: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at files that every executor can read, so a lost executor costs
    a re-read and never a new run of what stands before.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read: ``doc_id`` and ``text`` (null becomes empty)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` touches A-Z only.

    ``bytes.split`` and ``bytes.lower`` know ASCII alone, which is what the definition says.
    """
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    hashed = xxhash.xxh3_64_intdigest
    if seed:
        return np.fromiter((hashed(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(hashed, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (two multiply-xorshift rounds)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def rolling(h: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries of ``h``; equal runs have equal hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    """``(doc_id, text)`` of Arrow batches whose first two columns these are."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def row_numbers(df: DataFrame, *order: str, name: str = "numbered") -> DataFrame:
    """``df`` with ``row_no``: its global position from 0 by ``order``.

    One range shuffle.  Each sorted partition is written with the position inside it;
    the partitions' row counts (one figure for each) give the offsets.
    """
    base = F.monotonically_increasing_id()
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"_part": F.shiftright(base, 33), "_at": base.bitwiseAND((1 << 33) - 1)}),
        name,
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).orderBy("_part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["_part"], total))
        total += r["_n"]
    offset = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return (
        placed.join(F.broadcast(offset), "_part")  # one row for each partition of the sort
        .withColumn("row_no", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
    )


def bit_table(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits in which the low bits of each key are set; bounded by ``bits`` alone."""
    at = F.col(column).bitwiseAND((1 << bits) - 1) + 1  # these functions count positions from 1
    rows = (
        keys.select(at.alias("_p"))
        .groupBy(F.bitmap_bucket_number("_p").alias("_b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_m"))
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.collect():  # at most 2**bits / 32768 rows of 4 KiB
        start = (r["_b"] - 1) * 4096
        out[start:start + 4096] |= np.frombuffer(r["_m"], np.uint8)
    return out


def in_table(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the low bits of each hash are set in a bitmap of ``bit_table``."""
    p = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pow2_bits(n: int, per_key: int, most: int) -> int:
    return min(most, max(15, (max(1, n) * per_key - 1).bit_length()))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")
