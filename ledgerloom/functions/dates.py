"""Dates in text: patterns by priority, each reading kept, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_NAME = r"[A-Za-z][A-Za-z01Il]{2,8}"
_TIME_OR_END = r"(?:(?=\d{1,2}:\d{2})|(?!\d))"

# Date patterns in the order in which they are tried, and what their groups are.
PATTERNS = [
    (r"(?U)\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "ymd"),
    (r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", "ymd"),
    (r"(?U)\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", "ab4"),
    (r"(?U)\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})(?!\d)", "ab2"),
    (rf"(?U)\b({_NAME})\.?\s+(\d{{1,2}})(?:\s*[.,]\s*|\s+)(\d{{4}}){_TIME_OR_END}", "Mdy"),
    (rf"(?U)\b(\d{{1,2}})\s+({_NAME})\.?(?:\s*[.,]\s*|\s+)(\d{{4}}){_TIME_OR_END}", "dMy4"),
    (rf"(?U)\b(\d{{1,2}})\s*({_NAME})\.?\s*'\s*(\d{{2}})", "dMy2"),
    (rf"(?U)\b(\d{{1,2}})\s+({_NAME})\.?,?\s+(\d{{2}})(?!\d)", "dMy2"),
]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

#: Put where a date or time was: no digit, sign or letter touches it.
MASK = "\u0001"
# A time of day.
TIME = r"(?<![\d.])(?:[01]?\d|2[0-3])[:;][0-5]?\d(?:[:;][0-5]\d)?(?!\d)"


def month_number(token: Column) -> Column:
    """Month of a name as OCR reads it: by its first three letters, else by two edits at most from a full name."""
    t = F.translate(F.lower(F.regexp_replace(token, "I", "l")), "01", "ol")
    t = F.regexp_replace(t, r"^\.+|\.+$", "")
    # Lists as constants that are split: a tenth of the expressions that the analyser has to look at.
    listed = lambda names: F.split(F.lit(",".join(names)), ",")
    by_start = F.array_position(listed([m[:3] for m in MONTHS]), F.substring(t, 1, 3))
    near = F.array_position(F.transform(listed(MONTHS), lambda m: F.levenshtein(t, m, 2) >= 0), F.lit(True))
    return F.when(by_start > 0, by_start.cast("int")).when((F.length(t) >= 5) & (near > 0), near.cast("int"))


def _iso(y: Column, m: Column, d: Column) -> Column:
    """The reading as text, null out of range; days of the month are not checked here."""
    good = y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31)
    return F.when(good, F.format_string("%04d-%02d-%02d", y, m, d))


def _readings(match: Column, pattern: str, kind: str) -> Column:
    """All readings of one matched text, day first before month first."""
    group = [F.regexp_extract(match, pattern, i) for i in (1, 2, 3)]
    number = [g.try_cast("int") for g in group]
    if kind == "ymd":
        found = [_iso(number[0], number[1], number[2])]
    elif kind in ("ab4", "ab2"):
        y = number[2] if kind == "ab4" else number[2] + 2000
        found = [_iso(y, number[1], number[0]), _iso(y, number[0], number[1])]
    elif kind == "Mdy":
        found = [_iso(number[2], month_number(group[0]), number[1])]
    else:
        y = number[2] if kind == "dMy4" else number[2] + 2000
        found = [_iso(y, month_number(group[1]), number[0])]
    return F.array_distinct(F.array_compact(F.array(*found)))


#: Cheap tests of whether a pattern of either sort can match at all: most rows of a receipt hold no date.
_MAY_BE_NUMERIC = r"\d[-/.]\d{1,2}[-/.]\d|\d\s*年"
_MAY_BE_NAMED = r"\d\s*[A-Za-z][A-Za-z01Il]{2,8}[\s.,']*\d|[A-Za-z][A-Za-z01Il]{2,8}\.?\s+\d{1,2}[\s.,]+\d{4}"
_EMPTY = "array<struct<primary:string,candidates:array<string>>>"


def may_hold_date(text: Column) -> Column:
    return text.rlike("(?U)" + _MAY_BE_NUMERIC + "|" + _MAY_BE_NAMED)


def extract(text: Column, order: str = "dmy") -> Column:
    """array<struct<primary, candidates>> of the dates in the text, by pattern and then place.

    What one pattern has matched is masked for those after it.  Of an ambiguous date
    both readings stay; ``order`` says which is primary, if both are legal.

    The patterns are kept side by side, not nested: nested bindings cost the analyser
    seconds for each use.
    """
    parts, left = [], text
    for pattern, kind in PATTERNS:
        read = F.transform(F.regexp_extract_all(left, F.lit(pattern), F.lit(0)), _reader(pattern, kind))
        parts.append(F.filter(read, lambda c: F.size(c) > 0))
        left = F.regexp_replace(left, pattern, MASK)
    first = 1 if order == "dmy" else -1
    found = F.transform(F.flatten(F.array(*parts)), lambda r: F.struct(F.element_at(r, first).alias("primary"), r.alias("candidates")))
    none = F.when(text.isNotNull(), F.array().cast(_EMPTY))
    return F.when(~may_hold_date(text), none).otherwise(found)


def _reader(pattern: str, kind: str) -> Callable[[Column], Column]:
    return lambda match: _readings(match, pattern, kind)


def without_dates(text: Column) -> Column:
    """The text with everything that looks like a date or a time of day masked, so that only other numbers stay."""
    plain = F.when(may_hold_date(text), let(text, _without_patterns)).otherwise(text)
    clock = lambda t: F.contains(t, F.lit(":")) | F.contains(t, F.lit(";"))
    return let(plain, lambda t: F.when(clock(t), F.regexp_replace(t, TIME, MASK)).otherwise(t))


def _without_patterns(text: Column) -> Column:
    numeric = None
    for pattern, kind in PATTERNS:
        if kind in ("ymd", "ab4", "ab2"):
            numeric = F.regexp_replace(text if numeric is None else numeric, pattern, MASK)

    def by_name(t: Column) -> Column:
        for pattern, kind in PATTERNS:
            if kind not in ("ymd", "ab4", "ab2"):
                t = let(t, _without_named(pattern, 1 if kind == "Mdy" else 2))
        return t

    # Names of months cost most: they are looked for only where a word stands beside numbers.
    return let(numeric, lambda t: F.when(t.rlike("(?U)" + _MAY_BE_NAMED), by_name(t)).otherwise(t))


def _without_named(pattern: str, place: int) -> Callable[[Column], Column]:
    def mask(text: Column) -> Column:
        named = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: month_number(F.regexp_extract(m, pattern, place)).isNotNull())
        return F.aggregate(named, text, lambda t, m: F.replace(t, m, F.lit(MASK)))

    return mask


def primaries(text: Column, order: str = "dmy") -> Column:
    """Distinct primary readings in order."""
    return F.array_distinct(F.transform(extract(text, order), lambda r: r["primary"]))


def legal(iso: Column) -> Column:
    """The date, null for an impossible one."""
    return F.try_to_date(iso, "yyyy-MM-dd")


def replaced_year(iso: Column, year: Column) -> Column:
    return F.concat(year, F.substring(iso, 5, 100))


def ordinal(iso: Column) -> Column:
    """Days since 0001-01-01, from 1; null for an impossible date."""
    return F.datediff(legal(iso), F.lit("0001-01-01").cast("date")) + 1
