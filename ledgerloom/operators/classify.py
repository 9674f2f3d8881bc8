"""What rows and receipts are: fields of rows, kinds and types of receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CARD_SLIP_WORDS, KEYWORDS
from ..functions import money
from ..functions.text import has_keyword, is_header, is_suggestion, keyword_rank


def row_class(text: Column, keywords: dict[str, list[str]] = KEYWORDS) -> Column:
    """subtotal, tip, tax, cash, tendered or total, in that priority; null for other and ignored rows."""
    low = F.lower(text)
    cash = F.contains(low, F.lit("cash")) | F.contains(low, F.lit("现金"))
    return F.when(has_keyword(text, keywords["ignore"]) | is_suggestion(text), F.lit(None)).otherwise(
        F.when(has_keyword(text, keywords["subtotal"]), "subtotal")
        .when(has_keyword(text, keywords["tip"]), "tip")
        .when(has_keyword(text, keywords["tax"]), "tax")
        .when(has_keyword(text, keywords["tendered"]), F.when(cash, "cash").otherwise("tendered"))
        .when(has_keyword(text, keywords["total"]), "total")
    )


def classified_rows(rows: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Rows with amounts, class, is_tip (a tip row even without amount), last and best amount, rank of the total word."""
    text = F.col("text")
    ignored = has_keyword(text, keywords["ignore"]) | is_suggestion(text)
    return (
        rows.withColumn("amounts", money.amounts(text))
        .withColumn("class", F.when(F.size("amounts") > 0, row_class(text, keywords)))
        .withColumn("is_tip", ~ignored & has_keyword(text, keywords["tip"]))
        .withColumn("last_amount", money.last(F.col("amounts")))
        .withColumn("best_amount", money.best(F.col("amounts")))
        .withColumn("total_rank", keyword_rank(text, keywords["total"]))
    )


def doc_kind(full_text: Column) -> Column:
    """card_slip or invoice; an invoice header asks for more of a slip's words."""
    low = F.lower(full_text)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in CARD_SLIP_WORDS), F.lit(0))
    header = is_header(full_text)
    masked_card = full_text.rlike(r"\*{2,}\s*\d{4}")
    slip = (hits >= F.when(header, 4).otherwise(2)) | ((hits == 1) & ~header & masked_card)
    return F.when(slip, "card_slip").otherwise("invoice")


def doc_type(full_text: Column) -> Column:
    """vat, western or unknown."""
    low = F.lower(full_text)
    vat = F.contains(full_text, F.lit("价税合计")) | F.contains(full_text, F.lit("增值税")) | F.contains(full_text, F.lit("发票"))
    western = low.rlike("subtotal|total|tax|amount due|balance due")
    return F.when(vat, "vat").when(western, "western").otherwise("unknown")
