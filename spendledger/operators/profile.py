"""Profiling an extract before any convention is declared."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import AMOUNT_SHAPES, declared_reading, parse_amount
from ..functions.dates import date_shape, parse_format
from ..functions.text import strip
from .joins import salted_lookup


def column_profile(rows: DataFrame, columns: Sequence[str] | None = None, samples: int = 3) -> DataFrame:
    """Per column: rows, nulls, blanks, distinct values and the first few values in order.

    Columns are turned into (column, value) pairs and reduced per value before anything
    is counted, so one shuffle serves every column.
    """
    columns = list(columns or rows.columns)
    pairs = rows.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ])))
    values = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    stats = values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(strip(F.col("value")) == "", F.col("n"))), F.lit(0)).alias("n_blank"),
        F.count("value").alias("n_distinct"),
    )
    first = Window.partitionBy("column_name").orderBy("value")
    shown = (
        values.where("value IS NOT NULL").withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= samples)
        .groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("samples"))
    )
    return stats.join(shown, "column_name", "left")


def text_anomalies(rows: DataFrame, column: str, max_distinct: int = 60) -> DataFrame:
    """A text column that behaves like a closed list, value by value, with unusually long ones marked.

    More than ``max_distinct`` values means genuine free text: then one row with the
    median and maximum length instead.
    """
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("length", F.length("value"))
    n_distinct = values.agg(F.count(F.lit(1))).scalar()
    typical = values.agg(F.median("length").cast("double")).scalar()
    longest = values.agg(F.max("length")).scalar()
    listed = values.where(n_distinct <= max_distinct).select(
        F.lit("closed list").alias("kind"), "value", "n", "length",
        typical.alias("typical_length"), longest.alias("max_length"),
        (F.col("length") > 2 * typical).alias("is_outlier"))
    prose = values.groupBy("length").agg(F.sum("n").alias("n")).agg(
        F.sum("n").alias("n"), F.expr("percentile(length, 0.5, n)").alias("typical_length"),
        F.max("length").alias("max_length"),
    ).where(n_distinct > max_distinct).select(
        F.lit("free text").alias("kind"), F.lit(None).cast("string").alias("value"), "n",
        F.lit(None).cast("int").alias("length"), F.col("typical_length").cast("double").alias("typical_length"),
        "max_length", F.lit(None).cast("boolean").alias("is_outlier"))
    return listed.unionByName(prose)


def date_format_matrix(rows: DataFrame, column: str, formats: Sequence[str]) -> DataFrame:
    """How many values each format parses, in one scan."""
    day = strip(F.col(column))
    wide = rows.agg(
        F.count(column).alias("_n"),
        *[F.count(parse_format(day, f)).alias(f"f{i}") for i, f in enumerate(formats)],
        *[F.min(parse_format(day, f)).alias(f"lo{i}") for i, f in enumerate(formats)],
        *[F.max(parse_format(day, f)).alias(f"hi{i}") for i, f in enumerate(formats)],
    )
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("date_format"), F.col(f"f{i}").alias("n_parsed"),
                 (F.col("_n") - F.col(f"f{i}")).alias("n_failed"),
                 F.col(f"lo{i}").alias("first_day"), F.col(f"hi{i}").alias("last_day"))
        for i, f in enumerate(formats)
    ])))


def amount_shapes(rows: DataFrame, column: str) -> DataFrame:
    """Values per shape; a value counts under every shape it fits."""
    text = F.col(column)
    wide = rows.agg(*[F.count_if(text.rlike(f"(?U){p}")).alias(f"s{i}") for i, (_, p) in enumerate(AMOUNT_SHAPES)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("shape"), F.col(f"s{i}").alias("n")) for i, (name, _) in enumerate(AMOUNT_SHAPES)
    ])))


def _both_readings(rows: DataFrame, column: str, decimal_separator: str, suffixes: Sequence[str]) -> DataFrame:
    parsed = parse_amount(rows, column, decimal_separator=decimal_separator, suffixes=suffixes, into="structural")
    return parsed.withColumn("declared", declared_reading(F.col(column), decimal_separator, suffixes))


_DISAGREE = "NOT (declared <=> structural)"


def amount_readings(rows: DataFrame, column: str, decimal_separator: str, suffixes: Sequence[str],
                    group: Sequence[str] = ()) -> DataFrame:
    """Total under the declared reading, total under the structural one, and how many values they disagree on."""
    return _both_readings(rows, column, decimal_separator, suffixes).groupBy(*group).agg(
        F.sum("declared").alias("declared_total"),
        F.sum("structural").alias("structural_total"),
        F.count_if(F.expr(_DISAGREE)).alias("n_disagree"),
    )


def amount_disagreements(rows: DataFrame, column: str, decimal_separator: str, suffixes: Sequence[str]) -> DataFrame:
    """Every row whose two readings differ, with both."""
    return _both_readings(rows, column, decimal_separator, suffixes).where(_DISAGREE).select(
        *rows.columns, "declared", "structural")


def duplicates(rows: DataFrame, key: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once, with the number of occurrences."""
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    return salted_lookup(rows, repeated, key, row_key, how="inner")


def json_key_frequency(rows: DataFrame, column: str) -> DataFrame:
    """How often each top-level key occurs, and whether always."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    keys = rows.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"))
    return keys.select("key", "n", F.when(F.col("n") == total, "always").otherwise("sometimes").alias("presence"))


def code_lengths(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.length(column).alias("code_length")).agg(F.count(F.lit(1)).alias("n"))


def category_census(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several category columns in one pass."""
    pairs = rows.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    return pairs.where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def numeric_profile(rows: DataFrame, column: str) -> DataFrame:
    """Parsed as plain numbers: ok, failed, negative, zero, least, greatest, sum."""
    number = F.col(column).try_cast("decimal(24,6)")
    return rows.select(F.col(column).alias("_raw"), number.alias("_x")).agg(
        F.count("_x").alias("n_numeric"),
        F.count_if(F.col("_raw").isNotNull() & F.col("_x").isNull()).alias("n_other"),
        F.count_if(F.col("_x") < 0).alias("n_negative"),
        F.count_if(F.col("_x") == 0).alias("n_zero"),
        F.min("_x").alias("least"),
        F.max("_x").alias("greatest"),
        F.sum("_x").alias("total"),
    )


def currency_mix(rows: DataFrame, currency: str, amount: str) -> DataFrame:
    """Rows and mean amount per currency."""
    return rows.groupBy(F.col(currency).alias("currency")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(amount).alias("n_amounts"),
        (F.sum(amount) / F.count(amount)).alias("mean_amount"),
    )


# The letters a vocabulary word may consist of.
WORD = "[a-zA-Zàâçéèêëîïôûùüÿœ]+"


def token_vocabulary(rows: DataFrame, text: str, top: int | None = None, longer_than: int = 3) -> DataFrame:
    """Lower-cased words longer than three letters with their counts, or only the most frequent ``top``."""
    words = rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word"))
    counted = words.where(F.length("word") > longer_than).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.orderBy(F.desc("n"), "word")
    return ranked.limit(top) if top else counted


def date_format_vote(rows: DataFrame, column: str) -> DataFrame:
    """The format most values have the shape of; ties to the one listed first."""
    from ..functions.dates import DATE_SHAPES

    rank = F.array_position(F.array(*[F.lit(f) for _, f in DATE_SHAPES]), F.col("date_format"))
    votes = rows.select(date_shape(F.col(column)).alias("date_format")).where("date_format IS NOT NULL").groupBy(
        "date_format").agg(F.count(F.lit(1)).alias("votes"))
    return votes.agg(F.max_by("date_format", F.struct("votes", -rank)).alias("date_format"),
                     F.max("votes").alias("votes"))


def amount_convention_vote(rows: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Decimal separator most text values of each group suggest."""
    text = F.col(column)
    return rows.groupBy(*group).agg(
        F.count_if(text.rlike(r",\d{1,2}$")).alias("comma_decimals"),
        F.count_if(text.rlike(r"\.\d{1,2}$")).alias("dot_decimals"),
    ).withColumn("decimal_separator", F.when(F.col("comma_decimals") > F.col("dot_decimals"), ",").otherwise("."))


def amount_suffixes(rows: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """The currency suffixes seen, a row for each with its count."""
    suffix = F.nullif(F.regexp_extract(column, r"(?U)\s([A-Z]{2,5})$", 1), F.lit(""))
    return rows.select(*group, suffix.alias("suffix")).where("suffix IS NOT NULL").groupBy(*group, "suffix").agg(
        F.count(F.lit(1)).alias("n"))


def code_overlap(rows: DataFrame, country: str, code: str) -> DataFrame:
    """Codes shared by each pair of sources.

    Reduced to distinct (source, code) first: a code meets at most one row per source.
    """
    held = rows.where(F.col(code).isNotNull()).select(F.col(country).alias("c"), F.col(code).alias("k")).distinct()
    left, right = held.alias("l"), held.alias("r")
    return left.join(right, (F.col("l.k") == F.col("r.k")) & (F.col("l.c") < F.col("r.c"))).groupBy(
        F.col("l.c").alias("country_a"), F.col("r.c").alias("country_b")).agg(
        F.count(F.lit(1)).alias("shared_codes"))

