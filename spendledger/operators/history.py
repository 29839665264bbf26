"""Classification history: append-only rows, the current one per record and scheme, review decisions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .landing import RECORD_KEY

SCHEME_KEY = (*RECORD_KEY, "scheme")


def current(history: DataFrame, key: Sequence[str] = SCHEME_KEY, seq: str = "seq",
            preserve_manual: bool = False) -> DataFrame:
    """The latest row per key; with ``preserve_manual`` a manual correction outranks later runs.

    ``max_by`` keeps one candidate per key and task, so a record with a long history
    costs no more than any other.
    """
    rank = F.struct(F.coalesce(F.col("method") == "manual", F.lit(False)), F.col(seq)) if preserve_manual else F.col(seq)
    rest = [c for c in history.columns if c not in key]
    latest = history.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_latest"))
    return latest.select(*key, "_latest.*").select(*history.columns)


def with_previous(history: DataFrame, key: Sequence[str], seq: str, value: str) -> DataFrame:
    """Each history row with its predecessor's ``value`` within the key, whatever the sequence numbers.

    The rows are dealt to ranges of key and sequence and written; a long history lies in
    several ranges.  Inside each range the predecessor is the row before; only the last
    value of a range crosses to the next one that holds the key, so no task sorts a whole
    hot key.  Keys may be null.
    """
    placed = stored(history.repartitionByRange(*key, seq).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *key).orderBy(seq)
    # One row for each key and range.
    lasts = placed.groupBy("_range", *key).agg(F.max_by(F.struct(value), seq).alias("_last"))
    across = Window.partitionBy(*key).orderBy("_range")
    before = lasts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)],
                          F.lag(F.col("_last")[value]).over(across).alias("_before"))
    numbered = placed.withColumns({"_n": F.row_number().over(inside), f"previous_{value}": F.lag(value).over(inside)})
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return numbered.join(before, same).select(
        *history.columns, F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col(f"previous_{value}")).alias(f"previous_{value}"))


def is_pending(status: str = "review_status", flag: str = "needs_review", outcome: str = "outcome"):
    """What still waits for a person."""
    return (F.col(status) == "PENDING") & (F.col(flag) | (F.col(outcome) == "UNCLASSIFIED"))


def effective_decisions(decisions: DataFrame, key: Sequence[str] = SCHEME_KEY) -> DataFrame:
    """One decision per record and scheme: the first, since it takes the record off the queue.

    ``decisions``: key, ``action`` (ACCEPT or CORRECT), ``new_code``, ``reviewed_by``,
    ``review_note``, ``decided_at``, ``decision_no``.  A correction needs a code.
    """
    valid = decisions.where((F.col("action") == "ACCEPT") | (
        (F.col("action") == "CORRECT") & (F.coalesce("new_code", F.lit("")) != "")))
    rest = [c for c in decisions.columns if c not in key]
    return valid.groupBy(*key).agg(F.min_by(F.struct(*rest), "decision_no").alias("_d")).select(*key, "_d.*")


def apply_decisions(current_rows: DataFrame, decisions: DataFrame,
                    key: Sequence[str] = SCHEME_KEY, seq: str = "seq") -> DataFrame:
    """History rows that record the decisions taken on pending current rows.

    ACCEPT restates the current row as ACCEPTED under its own sequence number;
    CORRECT appends a manual row after it.  Rows without a decision are not returned.
    """
    return _decide(current_rows.where(is_pending()), decisions, key, seq, "inner")


def reviewed(current_rows: DataFrame, decisions: DataFrame,
             key: Sequence[str] = SCHEME_KEY, seq: str = "seq") -> DataFrame:
    """The current rows once the decisions are in: those decided on changed, all others as they are.

    What ``current(merge_decisions(…, apply_decisions(…)))`` gives for rows that are all
    current, by one join: no history is shuffled again and nothing is read twice.
    """
    return _decide(current_rows, decisions, key, seq, "left")


def _decide(rows: DataFrame, decisions: DataFrame, key: Sequence[str], seq: str, how: str) -> DataFrame:
    """One join on the record and scheme, of which both sides have one row: no key is hot, so none is salted."""
    first = effective_decisions(decisions, key).select(
        *key, "action", "new_code", F.col("reviewed_by").alias("_by"),
        F.col("review_note").alias("_note"), "decided_at")
    taken = rows.join(first, list(key), how)
    decided = is_pending() & F.col("action").isNotNull()
    fixed = F.col("action") == "CORRECT"
    none = F.lit(None).cast("string")
    changed = {
        "code": F.when(fixed, F.col("new_code")).otherwise(F.col("code")),
        "outcome": F.when(fixed, "CLASSIFIED").otherwise(F.col("outcome")),
        "method": F.when(fixed, "manual").otherwise(F.col("method")),
        "rule_id": F.when(fixed, none).otherwise(F.col("rule_id")),
        "confidence": F.when(fixed, 1.0).otherwise(F.col("confidence")),
        "needs_review": F.when(fixed, False).otherwise(F.col("needs_review")),
        "explanation": F.when(fixed, F.concat(
            F.lit("Manually corrected from "), F.coalesce("code", F.lit("none")),
            F.lit(" ("), F.col("method"), F.lit(").")
        )).otherwise(F.col("explanation")),
        "review_status": F.when(fixed, "CORRECTED").otherwise("ACCEPTED"),
        "reviewed_by": F.col("_by"),
        "reviewed_at": F.col("decided_at").cast("timestamp"),
        "review_note": F.col("_note"),
        "classified_at": F.when(fixed, F.col("decided_at").cast("timestamp")).otherwise(F.col("classified_at")),
        seq: F.when(fixed, F.col(seq) + 1).otherwise(F.col(seq)),
    }
    return taken.select(*[
        (F.when(decided, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in rows.columns
    ])


def merge_decisions(history: DataFrame, decided: DataFrame, key: Sequence[str] = SCHEME_KEY,
                    seq: str = "seq") -> DataFrame:
    """History after the decisions: accepted rows restated in place, corrections appended."""
    restated = decided.select(*key, seq).withColumn("_restated", F.lit(True))
    kept = history.join(restated, [*key, seq], "left_anti")
    return kept.unionByName(decided)
