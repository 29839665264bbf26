"""Document fingerprints by SimHash and their neighbours by permuted block tables (operator 10).

Only DataFrame functions run here.  A text's terms are its pairs of adjacent words (and
the last word alone); each occurrence votes with the 64 bits of the term's hash, so a
term weighs as often as it occurs.  A bit of the fingerprint is set where more than half
of the votes are.  Votes for bit i and bit i + 32 are counted in the two halves of one
sum, which makes 32 sums per text.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendledger.llm.common import WHITE, documents, materialise, utf8

RADIUS = 3
#: Documents of one bucket of the id order; buckets only decide how the work is dealt.
BUCKET_ROWS = 2048
MOST_BUCKETS = 4096
_LANES = 0x100000001


def terms(text: Column) -> Column:
    """Hashes of adjacent word pairs, in order; a text without a word has one term."""
    words = F.split(F.btrim(text, F.lit(WHITE)), r"[\x20\x09-\x0D]+")
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def _votes(h: Column) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES))).alias(f"v{i}") for i in range(32)]


def _majority() -> Column:
    """The fingerprint from the 32 sums and the number of votes ``n``."""
    out = F.lit(0).cast("long")
    for i in range(32):
        for shift, count in ((i, F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"v{i}", 32))):
            bit = F.lit(1 << shift if shift < 63 else -(1 << 63)).cast("long")
            out = out.bitwiseOR(F.when(count * 2 > F.col("n"), bit).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def text_form(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _bounds(ids: DataFrame) -> tuple[list[int], object, int]:
    """Ids that begin a bucket, the first id of the order, and the number of rows."""
    r = ids.agg(F.count("*").alias("n"), F.count("doc_id").alias("named"), F.min("doc_id").alias("least")).first()
    first = r["least"] if r["named"] == r["n"] else None
    buckets = min(MOST_BUCKETS, -(-r["n"] // BUCKET_ROWS))
    if buckets < 2 or not r["named"]:
        return [], first, r["n"]
    cuts = [k / buckets for k in range(1, buckets)]
    found = ids.agg(F.percentile_approx("doc_id", cuts, 20 * buckets).alias("b")).first()["b"]
    return sorted(set(found) - {r["least"]}), first, r["n"]


def with_next(docs: DataFrame) -> DataFrame:
    """``bucket, rn, real, doc_id, text, next_text``: every document beside the next one by ``doc_id``.

    Buckets are ranges of ids, so one shuffle deals the texts; a copy of each bucket's
    first document ends the bucket before (``real`` is false), and a copy of the first
    of all ends the last.  Rows of one id are ordered by text.
    """
    bounds, first, _ = _bounds(docs.select("doc_id"))
    marks = F.lit(bounds) if bounds else F.array().cast("array<long>")
    here = F.coalesce(F.size(F.filter(marks, lambda b: b <= F.col("doc_id"))), F.lit(0))
    none = F.lit(None).cast("struct<bucket:int,late:boolean,real:boolean>")

    def copy(bucket: Column, late: bool, real: bool) -> Column:
        return F.struct(bucket.cast("int").alias("bucket"), F.lit(late).alias("late"), F.lit(real).alias("real"))

    places = F.array_compact(F.array(
        copy(here, False, True),
        F.when(F.array_contains(marks, F.col("doc_id")), copy(here - 1, False, False)).otherwise(none),
        F.when(F.col("doc_id").eqNullSafe(F.lit(first)), copy(F.lit(len(bounds)), True, False)).otherwise(none),
    ))
    dealt = docs.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.*")
    order = Window.partitionBy("bucket").orderBy("late", "doc_id", "text")
    return dealt.select(
        "bucket", F.row_number().over(order).alias("rn"), "real", "doc_id", "text",
        F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp`` (fingerprints as long integers).

    The edited text is the text with its last floor(n_chars / 4) code points replaced by
    the first as many, or all, of the next document's.  Null text is empty.  Repeated rows stay
    rows of their own; a null id comes first in the order.  An empty table gives no row.
    """
    placed = with_next(documents(docs, id_col, text_col))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = placed.select(
        "bucket", "rn", "real", "doc_id", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    keys = ("bucket", "rn", "real", "doc_id", "n_chars", "edited_sha256")
    both = edited.withColumn("edited_sha256", F.sha2(utf8(F.col("edited")), 256)).select(
        *keys, F.explode(F.array(
            F.struct(F.lit(False).alias("changed"), F.col("text").alias("t")),
            F.struct(F.lit(True).alias("changed"), F.col("edited").alias("t")))).alias("v"))
    votes = (
        both.where("real OR NOT v.changed").select(*keys, "v.changed", F.explode(terms(F.col("v.t"))).alias("h"))
        .groupBy(*keys, "changed").agg(F.count("*").alias("n"), *_votes(F.col("h")))
        .select(*keys, "changed", _majority().alias("f"))
    )
    rows = votes.groupBy(*keys).agg(
        F.max(F.when(~F.col("changed"), F.col("f"))).alias("fp"), F.max(F.when(F.col("changed"), F.col("f"))).alias("edited_fp"))
    order = Window.partitionBy("bucket").orderBy("rn")
    return rows.withColumn("next_fp", F.lead("fp").over(order)).where("real").select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def _tables(fp: Column, radius: int, blocks: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """Block sets of the permuted tables and the mask of bits of each table."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    kept = list(combinations(range(blocks), blocks - radius))
    return kept, [sum(masks[b] for b in s) for s in kept]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks whose tables' keys have two bits more than ``n`` fingerprints need."""
    return next((b for b in range(radius + 1, 12) if 64 * (b - radius) // b >= max(1, n).bit_length() + 2), 12)


def near(queries: DataFrame, base: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``fp, near_fp, distance, copies``: all fingerprints of ``base`` within the radius of each of ``queries``.

    Both inputs have a long column ``fp``; a row of the result stands for ``copies`` rows
    of ``base``.  With b blocks, two fingerprints within radius r agree in b - r blocks at
    least, so one table for each set of b - r blocks finds them all; a pair is reported
    by the first table it agrees in.  Null fingerprints match nothing.  The join is always a
    merge join: either side grows with the documents, times the number of tables.
    """
    counted = base.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("copies"))
    blocks = blocks or blocks_for(counted.count(), radius)
    _, masks = _tables(F.col("fp"), radius, blocks)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for t, m in enumerate(masks)))
    left = queries.where("fp IS NOT NULL").select("fp").distinct().select("fp", F.explode(keys).alias("x")).select("fp", "x.*")
    right = counted.select("fp", "copies", F.explode(keys).alias("x")).select(F.col("fp").alias("near_fp"), "copies", "x.*")
    apart = F.col("fp").bitwiseXOR(F.col("near_fp"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(_signed(m)).cast("long")) == 0, F.lit(t)) for t, m in enumerate(masks)))
    pairs = left.join(right.hint("merge"), ["t", "k"]).where((F.bit_count(apart) <= radius) & (first == F.col("t")))
    return pairs.select("fp", "near_fp", F.bit_count(apart).alias("distance"), "copies")


def fingerprint_report(docs: DataFrame, radius: int = RADIUS, every: int = 20,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprints of all documents and, for ids divisible by ``every``, ``n_near``.

    ``n_near`` counts all documents (itself included) whose fingerprint is within the
    radius; it is null for the other ids.
    """
    made = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    asked = made.where(F.col("doc_id") % every == 0)
    found = near(asked, made, radius).groupBy("fp").agg(F.sum("copies").alias("n_near")).withColumnRenamed("fp", "_fp")
    searched = asked.join(found, F.col("fp") == F.col("_fp"), "left").drop("_fp")
    rest = made.where(F.coalesce(F.col("doc_id") % every != 0, F.lit(True))).withColumn("n_near", F.lit(None).cast("long"))
    return searched.unionByName(rest).select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("fp")).alias("fingerprint"),
        text_form(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")
