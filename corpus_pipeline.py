"""Documents to packed sequences in five stages; each reads the Parquet that the one before wrote.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns
of ``documents``.  Nothing is carried between stages but those files in the shared
folder, so a lost executor costs at most the stage it was in.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendledger.llm import bin_packing, contamination, forest_dedup, hyper_language, line_dedup
from spendledger.llm.common import materialise, table

#: A text that shares no trigram with the profiles has a cosine of about 0, give or take 0.016 (one by the root of the dimensions).
LEAST_LIKENESS, DIMENSIONS = 0.06, 4096


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts unlike every labelled language.

    A null or empty text goes; a null id or language does not matter; repeated rows are
    judged each on its own.  A table without a labelled text, or an empty one, leaves nothing.
    """
    return hyper_language.keep_known(docs, hyper_language.learn(docs, dimensions=DIMENSIONS), LEAST_LIKENESS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that a smaller document holds, and documents that lose all their words; ``n_chars`` follows the text.

    A null text, or one without a word, stays as it is.  A row without an id keeps its lines, and no other row loses
    one to it.  Rows of one id are one document.  An empty table stays empty.
    """
    out = line_dedup.remove_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each group of near copies (five-word shingles, 0.8).

    Texts without a word are near to nothing and stay, and so do rows without an id; rows of
    one id stay or go together.  An empty table stays empty.
    """
    gone = forest_dedup.near_duplicates(docs, size=5, percent=80).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    A null or empty text holds none and stays; items without text or id find nothing; repeated
    rows are judged each on its own.  An empty table, or an empty benchmark, changes nothing.
    """
    return contamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of the permitted lengths.

    A null text counts its end mark alone; null ids are carried along; repeated rows are
    packed each on its own.  An empty table gives no row.
    """
    return bin_packing.pack(bin_packing.byte_lengths(docs))


STAGES = [
    ("language", known_language),
    ("lines", fresh_lines),
    ("near_copies", one_of_each),
    ("benchmark", uncontaminated),
    ("packing", packed),
]

#: SQL cannot express the profiles, the similarity of whole sets on all documents or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
