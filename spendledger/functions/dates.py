"""Dates parsed only by the declared formats; day and month are never guessed."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import is_blank
from .text import strip

# Strptime directive -> (what it accepts, Spark pattern letters).
_DIRECTIVES = {
    "d": (r"\d{1,2}", "d"),
    "m": (r"\d{1,2}", "M"),
    "Y": (r"\d{4}", "yyyy"),
    "y": (r"\d{2}", "yy"),
    "H": (r"\d{1,2}", "H"),
    "M": (r"\d{1,2}", "m"),
    "S": (r"\d{1,2}", "s"),
    "b": (r"[A-Za-z]{3}", "MMM"),
    "B": (r"[A-Za-z]{3,}", "MMMM"),
}

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:.(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def _compile(fmt: str) -> tuple[str, str]:
    """A strptime format as (full-match regex, Spark datetime pattern)."""
    shape, pattern = "", ""
    for directive, literal in re.findall(r"%(.)|([^%]+)", fmt):
        if directive:
            if directive not in _DIRECTIVES:
                raise ValueError(f"date directive %{directive} is not supported in {fmt!r}")
            accepts, letters = _DIRECTIVES[directive]
            shape, pattern = shape + accepts, pattern + letters
        else:
            shape += re.escape(literal)
            pattern += re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", literal)
    return f"^{shape}$", pattern


def parse_format(col: Column, fmt: str) -> Column:
    """One strptime format; NULL unless the whole text fits."""
    shape, pattern = _compile(fmt)
    if sorted(d for d, _ in re.findall(r"%(.)|([^%]+)", fmt) if d) == ["Y", "d", "m"]:
        # Day, month and year as digits: rearranged to an ISO date, which Spark casts without a formatter.
        order = re.findall(r"%(.)", fmt)
        shape = shape[:-1] + r"\z"
        parts = re.sub(r"(\\d\{[^}]*\})", r"(\1)", shape)
        iso = F.regexp_replace(col, parts, "-".join(f"${order.index(d) + 1}" for d in "Ymd"))
        return F.when(col.rlike(shape.replace(r"\d{4}", r"(?!0000)\d{4}")), iso.try_cast("date"))
    day = F.try_to_date(col, pattern)
    if "yy" in pattern and "yyyy" not in pattern:
        day = F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)
    return F.when(col.rlike(shape), day)


def day_part(col: Column) -> Column:
    """Stripped text without anything from ``T`` on."""
    return F.when(col.rlike(r"^[!-SU-~]++\z"), col).otherwise(F.substring_index(strip(col), "T", 1))


def declared_date(day: Column, formats: Sequence[str]) -> Column:
    """The first declared format that the whole text fits."""
    if not formats:
        return F.lit(None).cast("date")
    return F.coalesce(*[parse_format(day, f) for f in formats])


def iso_date(day: Column) -> Column:
    """ISO calendar dates, extended or basic, with or without a time."""
    return F.when(day.rlike(_ISO), F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd")).when(
        day.rlike(r"^\d{8}$"), F.try_to_date(day, "yyyyMMdd")
    )


def parse_date(col: Column, formats: Sequence[str]) -> Column:
    """Declared formats in order, any part after ``T`` dropped, ISO as a last resort."""
    day = day_part(col)
    return F.coalesce(declared_date(day, formats), iso_date(day))


def date_problem(raw: Column, parsed: Column) -> Column:
    """NULL, ``missing`` or ``unparseable:…`` for a raw text and its parsed date."""
    unread = F.when(is_blank(raw), F.lit("missing")).otherwise(F.concat(F.lit("unparseable:"), day_part(raw)))
    return F.when(parsed.isNull(), unread)


def fiscal_year_start(day: Column, first_month: int = 7) -> Column:
    """Calendar year in which the fiscal year containing ``day`` began."""
    return F.year(F.add_months(day, -(first_month - 1)))


def fiscal_year_label(day: Column, first_month: int = 7) -> Column:
    """``FY2024/25`` for a July-June year."""
    start = fiscal_year_start(day, first_month)
    return F.when(
        day.isNotNull(),
        F.concat(F.lit("FY"), start.cast("string"), F.lit("/"),
                 F.lpad(((start + 1) % 100).cast("string"), 2, "0")),
    )


# Date shapes a sample is voted over, first match wins.
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}", "%Y-%m-%d"),
    (r"^\d{2}/\d{2}/\d{4}$", "%d/%m/%Y"),
    (r"^\d{2}-\d{2}-\d{4}$", "%d-%m-%Y"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "%d.%m.%Y"),
    (r"^\d{4}/\d{2}/\d{2}$", "%Y/%m/%d"),
    (r"^\d{8}$", "%Y%m%d"),
)


def date_shape(col: Column) -> Column:
    """The format whose shape the value has, or NULL."""
    s = strip(col)
    return F.coalesce(*[F.when(s.rlike(shape), F.lit(fmt)) for shape, fmt in DATE_SHAPES])
