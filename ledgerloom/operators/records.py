"""Receipt records from the lines of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import dates, money
from ..functions.text import has_keyword
from .classify import classified_rows, doc_kind, doc_type
from .rows import REGION, cluster_rows
from .total import CANDIDATE, select_total


def _rands(rows: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """An 8 before an amount is the sign R misread, where the region's amounts bear that sign."""
    k = settings.keywords
    seen = F.sum(F.size(F.regexp_extract_all("text", F.lit(r"R\s?\d{1,3}[.,]\d"), F.lit(0)))).over(Window.partitionBy(*keys))
    row = F.col("text").rlike(r"^\s*8\d{1,3}\.\d{2}\s*$") | has_keyword(F.col("text"), k["total"] + k["tendered"])
    fixed = F.regexp_replace("text", r"(?U)(?<![\w.,])8(?=\d{1,3}\.\d{2}(?!\d))", "R")
    return rows.withColumn("text", F.when((seen >= 3) & row, fixed).otherwise(F.col("text")))


def parse_rows(rows: DataFrame, settings: Settings = Settings(), keys: list[str] = REGION) -> DataFrame:
    """One record for each region from its visual rows (keys, row_no, text).

    One shuffle by region; all rules are expressions over the region's small arrays.
    """
    k = settings.keywords
    marked = classified_rows(_rands(rows, keys, settings), k)
    hinted = F.exists(F.array(*[F.lit(w.lower()) for w in k["date_hint"]]), lambda w: F.contains(F.lower("text"), w))
    marked = marked.withColumn("hint", F.when(hinted, F.get(dates.extract(F.col("text"), settings.date_order), F.lit(0))))
    total = F.col("class") == "total"
    candidate = F.struct(F.col("row_no").cast("int").alias("pos"), F.col("best_amount.value").alias("value"), F.col("total_rank").alias("rank"), F.col("best_amount.is_decimal").alias("is_decimal"), F.element_at(F.array(*map(F.lit, k["total"])), F.col("total_rank") + 1).alias("kw"))
    first = lambda name: F.min_by("last_amount", F.when(F.col("class") == name, F.col("row_no"))).alias(name)
    grouped = marked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("row_no", "text", "amounts"))).alias("rows"),
        first("subtotal"),
        first("tax"),
        first("tip"),
        F.array_sort(F.collect_list(F.when(total & F.col("best_amount").isNotNull(), candidate))).cast(f"array<{CANDIDATE}>").alias("candidates"),
        F.collect_list(F.when(F.col("class") == "tendered", F.col("best_amount.value"))).alias("tendered"),
        F.min(F.when(F.col("is_tip"), F.col("row_no"))).alias("first_tip"),
        F.min_by("hint", F.when(F.col("hint").isNotNull(), F.col("row_no"))).alias("hint"),
    )
    full = grouped.withColumn("full_text", F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).withColumn("amounts", F.flatten(F.transform("rows", lambda r: r["amounts"])))
    full = full.withColumn("dates", dates.extract(F.col("full_text"), settings.date_order))
    main = F.coalesce("hint", F.get("dates", F.lit(0)))
    full = full.withColumn("main", main).withColumn("invoice_date", F.col("main.primary"))
    others = F.flatten(F.transform(F.slice("dates", 1, 6), lambda d: d["candidates"]))
    full = full.withColumn("date_candidates", F.array_distinct(F.concat(F.coalesce("main.candidates", F.array().cast("array<string>")), others)))
    full = full.withColumn("invoice_type", doc_type(F.col("full_text"))).withColumn("doc_kind", doc_kind(F.col("full_text"))).withColumn("currency", money.voted_currency(F.col("full_text")))
    found = select_total(full)
    like_money = F.exists("amounts", lambda t: ~t["no_separator"] | t["currency"].isNotNull())
    evidence = (F.size("candidates") > 0) | (F.size("tendered") > 0) | F.col("subtotal").isNotNull() | F.col("tax").isNotNull() | F.col("tip").isNotNull()
    return found.withColumn("moneyish", like_money | evidence).select(
        *keys, "invoice_type", "doc_kind", "invoice_date", "date_candidates", "currency", "subtotal", "tax", "tip", "total_incl_tax", "printed_total", "confidence", "notes", "total_src", "moneyish"
    )


def worth_keeping(records: DataFrame) -> DataFrame:
    """Records that have an amount or a date, and more than bare numbers.

    Ask it of records that are written (``lineage.cut``): over ``parse_rows`` itself the
    optimiser puts the rules of every column into the filter, which takes it half a minute.
    """
    any_field = F.coalesce("total_incl_tax", "subtotal", "tax", "tip").isNotNull() | F.col("invoice_date").isNotNull() | (F.size("date_candidates") > 0)
    strip_of_numbers = (F.col("total_src") == "fallback") & ~F.col("moneyish")
    return records.where(any_field & ~strip_of_numbers)


def without_ghosts(records: DataFrame) -> DataFrame:
    """Without low fallback records of a crop in which another record's total is backed by a word."""
    crop = Window.partitionBy("crop_id")
    backed = F.max((~F.col("total_src").isin("fallback", "none")).cast("int")).over(crop)
    ghost = F.col("crop_id").isNotNull() & (F.col("total_src") == "fallback") & (F.col("confidence") == "low") & (backed == 1)
    return records.withColumn("ghost", F.coalesce(ghost, F.lit(False))).where("not ghost").drop("ghost")


def parse_regions(lines: DataFrame, settings: Settings = Settings(), keys: list[str] = REGION) -> DataFrame:
    """Records of regions from their lines."""
    return parse_rows(cluster_rows(lines, keys), settings, keys)
