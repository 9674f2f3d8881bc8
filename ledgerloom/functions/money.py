"""Money in text, as Column expressions; amounts are decimal(18,2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .dates import without_dates
from .text import repair_digits

# Currency signs and codes, and the one they stand for.
CURRENCIES = {"$": "$", "¥": "¥", "￥": "¥", "€": "€", "£": "£", "RMB": "¥", "CNY": "¥", "USD": "$", "EUR": "€", "GBP": "£", "R": "ZAR", "ZAR": "ZAR"}
# The signs and codes that a text is searched for, the numbers that are amounts, and rows of identifiers.
CODES_IN_TEXT = ["RMB", "CNY", "USD", "EUR", "GBP", "ZAR", "￥", "¥", "€", "£", "$"]
AMOUNT = r"([$¥￥€£]|RMB|CNY|USD|EUR|GBP|ZAR|R(?=\s?\d{1,3}(?:,\d{3})*\.\d{2}))?\s?(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)\s*(元)?"
ID_ROW = (
    r"(?iu)商户号|终端号|卡号|授权码|凭证号|批次号|流水号|订单号|参考号|发票号|校验码|电话|"
    r"terminal|merchant\s*(id|no)|auth|approval|batch|ref(erence)?\s*(no|#)|card\s*(no|#)|account|tel|phone|inv(oice)?\s*no|tax\s*inv\s*no"
)

_PLAIN = "(?iuU)" + AMOUNT
#: The sign before an amount is taken along: a minus marks a discount, a star the end of a masked card number.
_SIGNED = "(?iuU)([-*])?" + AMOUNT
TOKEN = "struct<value:decimal(18,2),fragment:string,currency:string,no_separator:boolean>"


#: White space as the patterns know it, and all that stands in a match beside digits, points and commas.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "".join(sorted({c for code in CURRENCIES for c in code + code.lower()})) + "\u017f"  # a long s is an s, whatever its case
_NO_TOKENS = f"array<{TOKEN}>"
#: Words of which one stands in every row of identifiers, in lower case.
_ID_WORDS = ["terminal", "merchant", "auth", "approval", "batch", "ref", "card", "account", "tel", "phone", "inv"]


def _without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def _currency(match: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    code = F.upper(F.call_function("translate", match, _without(match, _LETTERS), F.lit("")))
    return F.when(code != "", F.coalesce(F.try_element_at(known, code), code)).when(F.contains(match, F.lit("元")), F.lit("¥"))


def _value(match: Column) -> Column:
    return _without(match, "-*,元" + _LETTERS + _WHITE).try_cast("decimal(18,2)")


def _no_separator(match: Column) -> Column:
    return ~(F.contains(match, F.lit(".")) | F.contains(match, F.lit(",")))


def is_id_row(text: Column) -> Column:
    """Whether a row holds identifiers: the pattern is tried only where one of its words stands, or signs beyond ASCII."""
    low = F.lower(text)
    may = F.octet_length(text) != F.length(text)
    for w in _ID_WORDS:
        may = may | F.contains(low, F.lit(w))
    return may & text.rlike(ID_ROW)


def tokens(text: Column) -> Column:
    """array of every money token: value, fragment, currency, whether it has no separator."""
    read = F.transform(
        F.regexp_extract_all(text, F.lit(_PLAIN), F.lit(0)),
        lambda m: F.struct(_value(m).alias("value"), F.trim(m).alias("fragment"), _currency(m).alias("currency"), _no_separator(m).alias("no_separator")),
    )
    found = F.when(text.rlike(r"(?U)\d"), F.filter(read, lambda t: t["value"].isNotNull()))
    return F.coalesce(found, F.when(text.isNotNull(), F.array().cast(_NO_TOKENS)))


def amounts(text: Column) -> Column:
    """array of the numbers of a row that look like amounts.

    Not: all of a row of identifiers, numbers in dates and times, those after a minus
    or a star, six digits and more without separator, bare ones from 10000 and bare
    ones that look like a year.
    """
    none = F.array().cast(_NO_TOKENS)
    found = F.when(~text.rlike(r"(?U)\d") | is_id_row(text), none).otherwise(let(let(repair_digits(text), without_dates), _kept))
    return F.coalesce(found, none)


def _kept(masked: Column) -> Column:
    # A match is found once; its parts are read from it.
    unsigned = F.filter(F.regexp_extract_all(masked, F.lit(_SIGNED), F.lit(0)), lambda m: ~F.substring(m, 1, 1).isin("-", "*"))
    read = F.transform(
        unsigned,
        lambda m: F.struct(_value(m).alias("value"), F.btrim(m, F.lit(_WHITE)).alias("fragment"), _currency(m).alias("currency"), _no_separator(m).alias("no_separator")),
    )
    # Six digits and more are beyond 99999, unless they begin with zeros.
    long = lambda t: F.length(_without(t["fragment"], "-*.,元" + _LETTERS + _WHITE)) >= 6
    bare = lambda t: t["no_separator"] & t["currency"].isNull()
    return F.filter(read, lambda t: t["value"].isNotNull() & ~(t["no_separator"] & long(t)) & ~(bare(t) & ((t["value"] >= 10000) | t["value"].between(2000, 2099))))


def last(found: Column) -> Column:
    """The last amount of a row."""
    return F.try_element_at(found, F.lit(-1))["value"]


def best(found: Column) -> Column:
    """The largest amount that has a separator, else the largest; whether it has one."""
    good = F.filter(found, lambda t: ~t["no_separator"])
    return F.when(
        F.size(found) > 0,
        F.struct(F.coalesce(F.array_max(F.transform(good, lambda t: t["value"])), F.array_max(F.transform(found, lambda t: t["value"]))).alias("value"), (F.size(good) > 0).alias("is_decimal")),
    )


def voted_currency(full_text: Column) -> Column:
    """The currency most tokens have, the first seen among equals; else the first code that the text holds."""
    seen = F.filter(F.transform(tokens(full_text), lambda t: t["currency"]), lambda c: c.isNotNull())

    def vote(s: Column) -> Column:
        ranked = F.transform(F.array_distinct(s), lambda c: F.struct(F.size(F.filter(s, lambda x: x == c)).alias("n"), (-F.array_position(s, c)).alias("place"), c.alias("c")))
        return F.array_max(ranked)["c"]

    codes = F.coalesce(*[F.when(F.contains(full_text, F.lit(c)), F.lit(CURRENCIES[c])) for c in CODES_IN_TEXT])
    return F.coalesce(let(seen, vote), codes)
