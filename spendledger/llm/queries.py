"""The registered queries of this subpackage; each applies its operator to a whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendledger.llm import (
    anchor_dedup,
    bin_packing,
    bpe_count,
    contamination,
    fill_middle,
    forest_dedup,
    hard_negatives,
    hyper_language,
    line_dedup,
    permuted_shards,
    segment_simhash,
    simhash,
    token_files,
)
from spendledger.llm.common import table, utf8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in sequence files, read back."""
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(manifest)


@register
def op2_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity of 0.85 or more."""
    return forest_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@register
def op3_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing passages of 50 words that an earlier document holds."""
    return anchor_dedup.dedup_passages(table(spark, sf_dir, "documents"), width=50).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@register
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least ten code points stay in the smallest document that holds them."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = """
WITH line AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), first AS (
    SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
    SELECT keyed.*, coalesce(keyed.doc_id > first_id, false) AS gone FROM keyed LEFT JOIN first USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@register
def op5_permuted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among 16 shards of a reproducible shuffle."""
    return permuted_shards.shard_documents(table(spark, sf_dir, "documents"), 16)


@register
def op6_hyper_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return hyper_language.identify(docs, hyper_language.learn(docs.where(~hyper_language.held_out())))


@register
def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op8_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts of every text."""
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


@register
def op9_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as byte-level tokens, packed into sequences of four permitted lengths."""
    return bin_packing.pack(bin_packing.byte_lengths(table(spark, sf_dir, "documents")))


@register
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, with the near ones of every twentieth id counted."""
    return simhash.fingerprint_report(table(spark, sf_dir, "documents"))


@register
def op11_boundary_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at line ends into prefix, middle and suffix, and put together again from the output."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(utf8(F.col("output")), 256).alias("output_sha256"),
        F.sha2(utf8(fill_middle.restored(F.col("output"), F.col("form"))), 256).alias("restored_sha256"))


ORACLES["op11_boundary_fim"] = """
WITH unit AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
    SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM unit
), cut AS (
    SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
           array_to_string(u[greatest(c1, c2) + 1:n], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


@register
def op12_segment_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose four-word fingerprints differ in at most four bits."""
    return segment_simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)


@register
def op13_hyperplane_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are wrong on purpose."""
    rows = hard_negatives.quantised(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0).drop("positive_rank")


ORACLES["op13_hyperplane_negatives"] = """
WITH whole AS (
    SELECT vec_id, label, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM whole
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), negative AS (
    SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
    FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
     AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10
"""
