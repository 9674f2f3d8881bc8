"""The payable total of a receipt: a chain of rules over its candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TIP_RATIO_PERCENT
from ..functions.binding import let

CANDIDATE = "struct<pos:int,value:decimal(18,2),rank:int,is_decimal:boolean,kw:string>"


def _nearest(candidates: Column, target: Column) -> Column:
    """The first candidate nearest to a value; null of none."""
    keyed = F.transform(candidates, lambda c, i: F.struct(F.abs(c["value"] - target).alias("d"), i.alias("i"), c["value"].alias("v")))
    return F.array_min(keyed)["v"]


def _choice(value: Column, confidence: Column | str, note: Column) -> Column:
    level = F.lit(confidence) if isinstance(confidence, str) else confidence
    return F.when(value.isNotNull(), F.struct(value.cast("decimal(18,2)").alias("value"), level.alias("confidence"), note.alias("note")))


def _said(code: str, *parts: Column) -> Column:
    return F.concat_ws(" ", F.lit(code), *[p.cast("string") for p in parts])


def select_total(df: DataFrame) -> DataFrame:
    """Add total_incl_tax, confidence, notes, printed_total and total_src.

    Needs subtotal, tax, tip, candidates (array of CANDIDATE in row order), tendered
    (array of decimal), first_tip (row of the first tip word), amounts (money tokens)
    and invoice_type.  Notes are codes with values; sinks render them as text.
    """
    c = F.col("candidates")
    has = F.size(c) > 0
    paid = F.array_max("tendered")
    expected = F.when(F.col("subtotal").isNotNull(), (F.col("subtotal") + F.coalesce("tax", F.lit(0)) + F.coalesce("tip", F.lit(0))).cast("decimal(18,2)"))
    df = df.withColumn("expected", expected)
    e = F.when(F.col("expected") > 0, F.col("expected"))
    # A tax invoice names its total outright.
    by_name = _choice(F.get(F.filter(c, lambda x: F.contains(x["kw"], F.lit("价税合计"))), F.lit(0))["value"], F.when(F.col("tax").isNotNull(), "high").otherwise("medium"), F.lit("named_total"))
    # No total word: what was paid, else the largest amount that is no smaller than the subtotal.
    separated = F.transform(F.filter("amounts", lambda t: ~t["no_separator"]), lambda t: t["value"])
    every = F.transform("amounts", lambda t: t["value"])
    pool = F.when(F.size(separated) > 0, separated).otherwise(every)
    above = let(pool, lambda p: let(F.filter(p, lambda v: F.col("subtotal").isNull() | (v >= F.col("subtotal") - F.lit("0.01").cast("decimal(18,2)"))), lambda q: F.when(F.size(q) > 0, q).otherwise(p)))
    by_payment = F.when(~has, _choice(paid, "medium", F.lit("no_total_word_paid")))
    by_size = F.when(~has & paid.isNull(), _choice(F.array_max(above), "low", F.lit("no_total_word_largest")))
    # The sum of the parts.
    exact = F.filter(c, lambda x: F.abs(x["value"] - e) <= F.greatest(F.lit("0.05").cast("decimal(18,4)"), e * F.lit("0.01").cast("decimal(4,2)")))
    window = F.filter(c, lambda x: (x["value"] >= e * F.lit("0.95").cast("decimal(4,2)")) & (x["value"] <= e * F.lit("1.6").cast("decimal(4,2)")))
    by_sum = F.when(e.isNotNull(), _choice(_nearest(exact, e), "high", _said("sum_matches", F.col("expected"))))
    by_window = F.when(e.isNotNull(), _choice(_nearest(window, e), "medium", _said("sum_nearest", F.col("expected"))))
    # One candidate and the tip make another.
    reached = F.flatten(
        F.transform(c, lambda a, i: F.transform(F.filter(c, lambda b, j: (i != j) & (F.abs(a["value"] + F.col("tip") - b["value"]) <= F.greatest(F.lit("0.02").cast("decimal(18,5)"), b["value"] * F.lit("0.001").cast("decimal(4,3)")))), lambda b: b["value"]))
    )
    by_tip = F.when((F.col("tip") > 0) & (F.size(c) >= 2), _choice(F.get(reached, F.lit(0)), "high", F.lit("tip_adds_up")))
    # The rank of the word, an amount with a separator, the larger amount.
    ranked = F.array_min(F.transform(c, lambda x, i: F.struct(x["rank"].alias("rank"), (~x["is_decimal"]).alias("bare"), (-x["value"]).alias("less"), i.alias("i"), x["kw"].alias("kw"))))
    ranked_value = -ranked["less"]
    cent = F.lit("0.01").cast("decimal(18,2)")
    too_small = (ranked_value < F.col("subtotal") - cent) | (ranked_value < F.col("tax") - cent)
    by_rank = F.when(has, _choice(ranked_value, F.when(F.coalesce(too_small, F.lit(False)), "low").otherwise("medium"), _said("by_word", ranked["kw"])))
    # Why a choice by word may be wrong, and what else there was to choose from.
    doubts = F.array_compact(
        F.array(
            F.when(ranked_value < F.col("subtotal") - cent, _said("total_below_subtotal", ranked_value, F.col("subtotal"))),
            F.when(ranked_value < F.col("tax") - cent, _said("total_below_tax", ranked_value, F.col("tax"))),
            F.when(F.size(c) > 1, F.concat(F.lit("candidates "), F.array_join(F.transform(c, lambda x: F.concat(x["kw"], F.lit("="), x["value"].cast("string"))), ", "))),
        )
    )
    df = df.withColumn("doubts", doubts)
    df = df.withColumn("chosen", F.coalesce(by_name, by_payment, by_size, by_sum, by_window, by_tip, by_rank))
    df = df.withColumn("src", F.when(F.col("chosen").isNull(), "none").when(F.col("chosen.note") == "no_total_word_paid", "tendered").when(F.col("chosen.note") == "no_total_word_largest", "fallback").otherwise("kw"))
    by_word = F.col("chosen.note").startswith("by_word")
    none = F.array().cast("array<string>")
    notes = F.when(F.col("chosen").isNull(), F.array(F.lit("no_amount"))).otherwise(
        F.concat(
            F.array_compact(F.array(F.when(e.isNotNull() & has & F.col("chosen.note").isin("tip_adds_up") | (e.isNotNull() & F.col("chosen.note").startswith("by_word")), _said("sum_unmatched", F.col("expected"))))),
            F.when(by_word, F.col("doubts")).otherwise(none),
            F.array("chosen.note"),
        )
    )
    df = df.withColumn("notes", notes)
    # A total after the tip row is the one written by hand.
    v = F.col("chosen.value")
    after = F.filter(c, lambda x: (x["pos"] > F.col("first_tip")) & (x["value"] >= v * F.lit("0.6").cast("decimal(4,2)")) & (x["value"] <= v * F.lit("1.6").cast("decimal(4,2)")))
    hand = F.when((F.col("invoice_type") != "vat") & F.col("first_tip").isNotNull(), F.array_max(F.transform(after, lambda x: F.struct(x["pos"].alias("pos"), x["value"].alias("value"))))["value"])
    df = df.withColumn("hand", F.when(hand != v, hand))
    df = df.withColumn("v3", F.coalesce("hand", v)).withColumn("printed_total", F.when(F.col("hand").isNotNull(), v))
    # The value and a fee of the pool make the largest amount.
    df = df.withColumn("pool", separated)
    most = F.array_max("pool")
    fee = most - F.col("v3")
    fits = (F.col("invoice_type") != "vat") & (fee > 0) & (fee <= F.col("v3") * F.lit("0.35").cast("decimal(4,2)")) & F.exists("pool", lambda a: F.abs(a - fee) <= F.lit("0.02").cast("decimal(18,2)"))
    df = df.withColumn("fee_fits", F.coalesce(fits, F.lit(False)))
    df = df.withColumn("printed_total", F.when(F.col("fee_fits"), F.coalesce("printed_total", "v3")).otherwise(F.col("printed_total")))
    df = df.withColumn("v4", F.when(F.col("fee_fits"), most).otherwise(F.col("v3")))
    changed = F.col("hand").isNotNull() | F.col("fee_fits")
    df = df.withColumn("c4", F.when(changed & (F.col("chosen.confidence") == "high"), "medium").otherwise(F.coalesce("chosen.confidence", F.lit("low"))))
    # What was paid has the last word.
    more = F.coalesce(paid > F.col("v4"), F.lit(False))
    by_tip_ratio = paid * 100 <= F.col("v4") * TIP_RATIO_PERCENT
    df = df.withColumn("paid_more", more)
    df = df.withColumn("confidence", F.when(more & by_tip_ratio, F.when(F.col("c4") == "high", "high").otherwise("medium")).when(more, "medium").otherwise(F.col("c4")))
    df = df.withColumn("total_incl_tax", F.when(more, paid).otherwise(F.col("v4")).cast("decimal(18,2)"))
    extra = [F.when(F.col("hand").isNotNull(), _said("handwritten_total", F.col("hand"), v)), F.when(F.col("fee_fits"), _said("fee_adds_up", fee)), F.when(more & by_tip_ratio, _said("paid_with_tip", paid)), F.when(more & ~by_tip_ratio, _said("paid_overrides", paid))]
    df = df.withColumn("notes", F.concat("notes", F.array_compact(F.array(*extra)))).withColumn("total_src", F.when(more, "tendered").otherwise(F.col("src")))
    return df.withColumn("printed_total", F.col("printed_total").cast("decimal(18,2)")).drop("expected", "doubts", "chosen", "src", "hand", "v3", "v4", "pool", "fee_fits", "c4", "paid_more")
