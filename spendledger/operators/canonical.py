"""Case and accent variants of one description resolved to the spelling used most."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .joins import salted_lookup
from .landing import POSITION
from .quality import batch_issues


def spelling_counts(rows: DataFrame, group: Sequence[str], text: str, order: Sequence[str]) -> DataFrame:
    """Per group and spelling: fold key, occurrences and first position."""
    return (
        rows.where(F.col(text).isNotNull())
        .groupBy(*group, F.col(text).alias("spelling"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first_seen"))
        .withColumn("fold_key", fold(F.col("spelling")))
    )


def canonical_spellings(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per group and fold key: the most frequent spelling, ties to the first seen."""
    return counts.groupBy(*group, "fold_key").agg(
        F.min_by("spelling", F.struct(-F.col("n"), F.col("first_seen"))).alias("canonical"),
        F.count(F.lit(1)).alias("n_spellings"),
        F.sum("n").alias("n_rows"),
        (F.sum("n") - F.max("n")).alias("n_changed"),
        F.min("first_seen").alias("first_seen"),
    )


def canonicalise(
    facts: DataFrame,
    group: Sequence[str] = ("country_code", "batch_id"),
    text: str = "description",
    order: Sequence[str] = (*POSITION, "child_pos"),
) -> DataFrame:
    """Rewrite ``text`` to its group's canonical spelling; the raw text column is left alone.

    Spelling counts are reduced before the shuffle, and only spellings that lose to
    another one are joined back.  They are few as a rule, and then Spark sends them to the
    rows by their measured size; where they are not, it splits a hot spelling by the
    measured size of its part, so nothing is copied or salted beforehand.
    """
    counts = spelling_counts(facts, group, text, order)
    variants = Window.partitionBy(*group, "fold_key")  # the spellings of one text
    losing = counts.withColumn(
        "canonical", F.min_by("spelling", F.struct(-F.col("n"), F.col("first_seen"))).over(variants)
    ).where("spelling <> canonical").select(*[F.col(c).alias(f"_{c}") for c in group], F.col("spelling").alias("_spelling"), "canonical")
    same = facts[text] == F.col("_spelling")
    for c in group:
        same = same & (facts[c] == F.col(f"_{c}"))
    return facts.join(losing, same, "left").withColumn(text, F.coalesce("canonical", text)).select(*facts.columns)


def variant_issues(facts: DataFrame, detected_at=None) -> DataFrame:
    """DESCRIPTION_CASE_VARIANTS: one entry per load that has any, naming the text with most spellings.

    ``variant_spellings`` lists every spelling.
    """
    group = ["country_code", "batch_id"]
    counts = spelling_counts(facts, group, "description", (*POSITION, "child_pos"))
    groups = canonical_spellings(counts, group).where("n_spellings > 1")
    summary = groups.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum("n_spellings").alias("n_spellings"),
        F.sum("n_changed").alias("n_changed"),
        F.min_by("canonical", F.struct(-F.col("n_spellings"), F.col("first_seen"))).alias("canonical"),
    )
    return batch_issues(
        summary, "DESCRIPTION_CASE_VARIANTS", F.lit("description"), F.col("canonical"),
        F.format_string(
            "%d descriptions come in more than one casing (%d spellings); %d rows now carry the most"
            " frequent one. The text as supplied is kept.",
            "n_texts", "n_spellings", "n_changed"),
        detected_at,
    )


def variant_spellings(facts: DataFrame, group: Sequence[str] = ("country_code", "batch_id"),
                      text: str = "description", order: Sequence[str] = (*POSITION, "child_pos")) -> DataFrame:
    """Every spelling of every text that has more than one: ``fold_key, spelling, n, canonical``."""
    counts = spelling_counts(facts, group, text, order)
    several = canonical_spellings(counts, group).where("n_spellings > 1").select(*group, "fold_key", "canonical")
    return salted_lookup(counts, several, [*group, "fold_key"], ["spelling"], how="inner").select(
        *group, "fold_key", "spelling", "n", "canonical")
