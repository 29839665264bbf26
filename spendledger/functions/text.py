"""Text cleaning, folding and pattern matching as Column expressions."""
from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as a blank.
_BLANK = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


# Printable ASCII: words parted by single spaces, and text without a blank at either end.
_CLEAN = r"^[!-~]++(?: [!-~]++)*+\z"
_TRIMMED = r"^[!-~](?:[ -~]*[!-~])?\z"


def strip(col: Column) -> Column:
    """Remove leading and trailing blanks of any kind, no-break spaces included."""
    return F.trim(col, F.lit(_BLANKS))


def normalise_text(col: Column) -> Column:
    """Collapse blank runs to one space, trim, empty becomes NULL; case is kept.

    Text that is clean already, the common case, only pays for a probe.
    """
    return F.when(col.rlike(_CLEAN), col).otherwise(F.nullif(F.trim(F.regexp_replace(col, rf"{_BLANK}+", " ")), F.lit("")))


def clean_code(col: Column) -> Column:
    """Identifiers are keys into another system: trimmed, never re-cased."""
    return normalise_text(col)


@functools.lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without combining marks, derived from the Unicode database.

    Returns (characters to replace or drop, their replacements, multi-character
    replacements).  Hangul syllables decompose by arithmetic rather than by table and
    are left composed.
    """
    single_from, single_to, dropped, multi = [], [], [], {}
    for point in range(0x80, 0x30000):
        if 0xD800 <= point < 0xE000 or 0xAC00 <= point < 0xD7A4:
            continue
        char = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char:
            continue
        if not plain:
            dropped.append(char)
        elif len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        else:
            multi[char] = plain
    return "".join(single_from + dropped), "".join(single_to), multi


def _ranges(chars: Sequence[str], gap: int) -> str:
    """Characters as regex ranges; with a ``gap`` above one the ranges also cover what lies between near ones."""
    ranges: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if ranges and point - ranges[-1][1] <= gap:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


@functools.lru_cache(maxsize=1)
def _expanding() -> str:
    """A class of the characters that expand to several.

    A class is tried range by range, so it is nested: ASCII fails at the first test, other
    scripts at one of a few wide ranges, and the exact ranges are tried for the rest alone.
    """
    multi = list(_fold_tables()[2])
    return rf"[[^\x00-\x7F]&&[{_ranges(multi, 256)}]&&[{_ranges(multi, 1)}]]"


def fold(col: Column) -> Column:
    """Accent-free lower case used as a matching key; NULL stays NULL.

    Plain ASCII text, the common case, only pays for a regex probe and ``lower``.
    Characters that expand to several (ligatures, fractions) are replaced one kind at a
    time, so a text pays for the kinds it holds and not for its length in look-ups.
    """
    source, target, multi = _fold_tables()
    plain = F.translate(col, source, target)
    table = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")
    present = F.array_distinct(F.regexp_extract_all(col, F.lit(_expanding()), F.lit(0)))
    expanded = F.aggregate(present, col, lambda text, c: F.replace(text, c, F.element_at(table, c)))
    expanded = F.translate(expanded, source, target)
    folded = (
        F.when(~col.rlike(r"[^\x00-\x7F]"), col)
        .when(col.rlike(_expanding()), expanded)
        .otherwise(plain)
    )
    return F.when(col.rlike(_TRIMMED), F.lower(col)).otherwise(strip(F.lower(folded)))


def matching_patterns(col: Column, patterns: Sequence[str]) -> Column:
    """Array of the patterns found in the text, in rule order; empty when none or NULL.

    One alternation is tried first, so the ordinary row costs a single scan.
    """
    none = F.array().cast("array<string>")
    if not patterns:
        return none
    either = "|".join(f"(?:{p})" for p in patterns)
    hits = F.array_compact(
        F.array(*[F.when(col.rlike(f"(?iU){p}"), F.lit(p)) for p in patterns])
    )
    return F.when(found_in(col, either, "i"), hits).otherwise(none)


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def found_in(col: Column, pattern: str, flags: str) -> Column:
    """Whether the pattern, read with Unicode classes, is found; on ASCII text the plain reading says the same and is faster.

    That holds for patterns of ASCII characters without property classes, as ``\\p{Punct}`` differs.
    """
    unicode = col.rlike(f"(?{flags}U){pattern}")
    if not pattern.isascii() or re.search(r"\\[pPxuNX0c]|\(\?[a-zA-Z-]*[uU]", pattern):
        return unicode
    return F.when(is_ascii(col), col.rlike(f"(?{flags}){pattern}")).otherwise(unicode)


def contains_ignoring_case(col: Column, needle: str) -> Column:
    """Substring test where only ASCII letters ignore case; wildcards in ``needle`` work as in LIKE."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    wanted = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in needle)
    wanted = wanted.replace("\\", "\\\\")
    return F.translate(col, upper, lower).like(f"%{wanted}%")

