"""Repair of OCR text and keyword tests, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"

# What OCR gets wrong and what it stands for, applied in this order.
REPAIRS = [
    (rf"(?iu)(\d)((?:{_MONTH})[a-z]*)", "$1 $2"),
    (rf"(?iu)((?:{_MONTH})[a-z]*)(\d)", "$1 $2"),
    (r"(\d)\.\s+(\d{2})(?!\d)(?!\s*[A-Za-z])", "$1.$2"),
    (r"(?U)\bD[:;](\d{2})\s+(\d{2})\s+(\d{2})(?!\d)", "D:$1-$2-$3"),
    (r"(\d{4}[/-]\d{2}[/-]):(\d)", "$1\\1$2"),
    (r"(?U)\bBi1{1,2}\b", "Bill"),
    (r"(?U)\bTota1\b", "Total"),
    (r"(?<=[R$€£¥])[Il!](?=[\d,.])", "1"),
    (r"(?<=,)[Il](?=\d{2})", "1"),
    (r"(?U)(\d)\.(\d{3})\.(\d{2})\b", "$1,$2.$3"),
    (r"(?U)(\d),(\d{3}),(\d{2})\b", "$1,$2.$3"),
    (r"(?U)(\d),\s+(\d{3})(?=\.\d{2}\b|\s|$)", "$1,$2"),
]
# Words beside which a Q between digits is a zero.
AMOUNT_WORDS = ["total", "amount", "tender", "balance", "due", "card", "合计", "总计", "金额", "应付", "实付", "价税"]
# A Q that is a zero, before an amount's decimals and beside the words above; money with a colon for its point.
Q_IN_DECIMALS = r"(?U)(?<=\d)Q(?=\d{0,2}[.,]\d{2}\b)"
Q_IN_DIGITS = r"(?<=\d)Q(?=\d)"
COLON_FOR_POINT = r"^\s*(\d{1,3}(?:,\d{3})*|\d{1,6})[:;](\d{2})\s*$"
# Letters in numbers and the digits they stand for.
LETTERS_IN_NUMBERS = [(r"(?<=[\d.,])[oO](?=[\d.,])", "0"), (r"(?<=[\d.,])[lI](?=[\d.,])", "1"), (r"(?<=\d)\.o(?![a-z])", ".0")]
# A line that is only a time of day; a row of a table of suggested tips; a row that starts an invoice.
BARE_TIME = r"^\s*([01]?\d|2[0-3])[:;][0-5]\d(?:[:;][0-5]\d)?\s*$"
SUGGESTION = r"(@?\s*\d{1,2}\s*[%％]\s*[=＝])|(\d{1,2}\s*[%％]\s*[=＝]\s*[R$]?\s*\d)"
HEADER = r"(?iu)tax\s*lnvolce|tax\s*invoice|invoice\s*n[or]|vat\s*invoice|增值税.*发票|普通发票|发票\s*代码|发票\s*号码"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def repair(text: Column) -> Column:
    """The text of an OCR line with what is safely known to be misread set right."""
    for pattern, put in REPAIRS:
        text = F.regexp_replace(text, pattern, put)
    text = F.regexp_replace(text, Q_IN_DECIMALS, "0")
    return let(let(text, _q_in_amounts), _colon_for_point)


def _q_in_amounts(text: Column) -> Column:
    words = F.exists(F.array(*map(F.lit, AMOUNT_WORDS)), lambda w: F.contains(F.lower(text), w))
    return F.when(words, F.regexp_replace(text, Q_IN_DIGITS, "0")).otherwise(text)


def _colon_for_point(text: Column) -> Column:
    """A whole line of digits, a colon and two digits is money if no clock shows it."""
    head = F.regexp_extract(text, COLON_FOR_POINT, 1)
    return F.when((head != "") & (F.regexp_replace(head, ",", "").try_cast("long") > 23), F.concat(head, F.lit("."), F.regexp_extract(text, COLON_FOR_POINT, 2))).otherwise(text)


#: A stretch of digits, signs and letters that stand for digits, from its first digit or sign.
_STRETCH = r"[\d.,][\d.,oOlI]*"


def repair_digits(text: Column) -> Column:
    """Letters inside numbers read as digits; a repair may make its neighbour's, so it is done until nothing changes.

    A round changes nothing outside stretches of digits, signs and such letters, and each
    further one sets a letter of each right in which anything is left.  Of several letters
    in a row the first two at most are ever set right: twice as many rounds as the
    stretch with most such rows has are enough.
    """

    def once(t: Column) -> Column:
        for pattern, digit in LETTERS_IN_NUMBERS:
            t = F.regexp_replace(t, pattern, digit)
        return t

    rows = F.transform(F.regexp_extract_all(text, F.lit(_STRETCH), F.lit(0)), lambda s: F.regexp_count(s, F.lit("[oOlI]+")))
    rounds = F.sequence(F.lit(1), F.greatest(2 * F.array_max(rows), F.lit(1)))
    return F.when(text.rlike(r"[\d.,][oOlI]"), F.aggregate(rounds, text, lambda t, _: once(t))).otherwise(text)


def canonical(text: Column) -> Column:
    """Lower case with the letters that OCR confuses made one: 1, i and l; 0 and o."""
    return F.translate(F.lower(text), "1i0", "llo")


def is_bare_time(text: Column) -> Column:
    return text.rlike(BARE_TIME)


def is_suggestion(text: Column) -> Column:
    """Whether a row is one of a table of suggested tips."""
    return text.rlike(SUGGESTION)


def is_header(text: Column) -> Column:
    """Whether a row starts an invoice; the pattern allows for canonical spelling."""
    return canonical(text).rlike(HEADER) | text.rlike(HEADER)


def keyword_rank(text: Column, words: Sequence[str]) -> Column:
    """Index of the first keyword that the text holds, plainly or in canonical spelling; null if none."""
    low, bare = F.lower(text), canonical(text)
    table = str.maketrans("1i0", "llo")
    tests = [(F.contains(low, F.lit(w.lower())) | F.contains(bare, F.lit(w.lower().translate(table)))) for w in words]
    if not tests:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])


def has_keyword(text: Column, words: Sequence[str]) -> Column:
    return keyword_rank(text, words).isNotNull()
