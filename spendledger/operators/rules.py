"""Keyword rules kept as a table of any size, found through the words they need.

A rule is a regular expression with a position; the first one that a text matches counts.
Most rules start with a group of alternatives between word boundaries, so a text has to
hold one of a few words before the rule can match.  Those words are the rule's keys: texts
and rules meet in a join on words, and only the rules met are tried.  A rule of another
form has no key and is tried on every text.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Rule
from ..session import values_table

RULE_COLUMNS = "position int, rule_id string, pattern string, code string, outcome string, confidence double, note string"
#: A group of plain alternatives between word boundaries, not repeated, and what follows it.
_KEYED = r"^\\b\(([^()\[\]{}\\.*+?^$]+)\)\\b(?![?*+{])(.*)$"


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Configured rules in their order."""
    return values_table(spark, [(k, r.id, r.pattern, r.code, r.outcome, r.confidence, r.note) for k, r in enumerate(rules)], RULE_COLUMNS)


def _word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")


def rule_words(pattern: Column) -> Column:
    """Words of which a matching text holds one at least; NULL where the pattern's form does not say.

    Of an alternative of several words the first is enough.
    """
    group, rest = F.regexp_extract(pattern, _KEYED, 1), F.regexp_extract(pattern, _KEYED, 2)
    # An alternative beside the whole group would need none of its words.
    open_choice = F.regexp_replace(rest, r"\([^()]*\)", "").contains("|")
    words = F.transform(F.split(group, r"\|"), lambda a: F.try_element_at(_word_list(a), F.lit(1)))
    keyed = (group != "") & ~open_choice & ~F.exists(words, lambda w: w.isNull())
    return F.when(keyed, F.array_distinct(words))


def first_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``folded`` and the columns of ``rules`` (position, pattern, …): the first rule each distinct text matches.

    Texts without a match are left out.  Of rules with the same pattern only the first can
    count.  ``rules`` may be of any size; a word that very many rules need is met by the
    texts that hold it alone.
    """
    rest = [c for c in rules.columns if c not in ("pattern", "position")]
    once = rules.where("pattern IS NOT NULL").groupBy("pattern").agg(
        F.min("position").alias("position"), F.min_by(F.struct(*rest), "position").alias("_rest"))
    keyed = once.withColumn("_words", rule_words(F.col("pattern")))
    index = keyed.select("pattern", "position", F.explode(F.coalesce("_words", F.array(F.lit("")))).alias("word"))
    distinct = texts.where("folded <> ''").select("folded").distinct()
    held = distinct.select("folded", F.explode(F.array_distinct(F.concat(_word_list(F.col("folded")), F.array(F.lit(""))))).alias("word"))
    met = held.join(index, "word").where(F.expr("folded rlike concat('(?idU)', pattern)"))
    first = met.groupBy("folded").agg(F.min("position").alias("position"))
    named = once.select("position", "pattern", "_rest.*")
    return first.join(named, "position").select("folded", *rules.columns)
