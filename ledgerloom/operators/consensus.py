"""What a page or batch agrees on, and repairs and guesses made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ordinal, replaced_year


def modal(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value for each key, the smallest among equals; counted before it is compared."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))).alias(name), F.max("n").alias(f"{name}_count"), F.sum("n").alias(f"{name}_of"))


def at_rank(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, names): for each name the value at an index (from 0; an expression of ``n``) of the sorted ones.

    From counts by value with a running sum, so rows of one key never meet in a list.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("m"))
    key = Window.partitionBy(*keys)
    running = counts.withColumn("so_far", F.sum("m").over(key.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("m").over(key))
    return running.groupBy(*keys).agg(*[F.min(F.when(F.col("so_far") > index, F.col(value))).alias(name) for name, index in ranks.items()])


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """(keys, name): the element at index n // 2 of the sorted values."""
    return at_rank(df, keys, value, {name: F.floor(F.col("n") / 2)})


def index_percentile(df: DataFrame, keys: list[str], value: str, share: float, name: str = "percentile") -> DataFrame:
    """(keys, name): the element at index int(share * n) of the sorted values."""
    return at_rank(df, keys, value, {name: F.floor(F.col("n") * share)})


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "weighted_median") -> DataFrame:
    """The first value at which the weights so far reach half of all."""
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    per_value = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    summed = per_value.withColumn("so_far", F.sum("w").over(order)).withColumn("all", F.sum("w").over(Window.partitionBy(*keys)))
    return summed.where(F.col("so_far") >= F.col("all") / 2).groupBy(*keys).agg(F.min(value).alias(name))


def _with_facts(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the facts of its batch: a join by ``keys``, or the one row of facts as constants if there are none."""
    if keys:
        return df.join(facts, keys, "left")
    row = facts.first()
    return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in facts.schema})


def repair_years(records: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """Dates whose year differs from their batch's set right where that brings them nearer.

    A batch speaks if it has three dates at least and one year has 60 % of them.  The
    measure is the upper median of the dates of that year, taken from counts by date, so
    a large batch never meets in one task.  Without ``batch`` all records are one.
    All outliers become low and get a note.
    """
    keys = batch or []
    year = F.substring("invoice_date", 1, 4)
    dated = records.where(F.col("invoice_date").isNotNull()).withColumn("year", year)
    modes = modal(dated, keys, "year", "modal_year").where((F.col("modal_year_of") >= 3) & (F.col("modal_year_count") * 10 >= F.col("modal_year_of") * 6))
    of_year = _with_facts(dated, modes.select(*keys, "modal_year"), keys).where(F.col("year") == F.col("modal_year"))
    middle = upper_median(of_year.withColumn("day", ordinal(F.col("invoice_date"))), [*keys, "modal_year"], "day", "middle")
    out = _with_facts(records, modes.select(*keys, "modal_year").join(middle, [*keys, "modal_year"], "left").select(*keys, "modal_year", "middle"), keys)
    outlier = F.coalesce(year != F.col("modal_year"), F.lit(False))
    fixed = replaced_year(F.col("invoice_date"), F.col("modal_year"))
    nearer = F.coalesce(F.abs(ordinal(fixed) - F.col("middle")) < F.abs(ordinal(F.col("invoice_date")) - F.col("middle")), F.lit(False))
    note = F.when(nearer, F.concat_ws(" ", F.lit("year_repaired"), F.col("invoice_date"), fixed)).otherwise(F.concat_ws(" ", F.lit("year_differs"), year, F.col("modal_year")))
    out = out.withColumn("notes", F.when(outlier, F.array_append(F.coalesce("notes", F.array().cast("array<string>")), note)).otherwise(F.col("notes")))
    out = out.withColumn("confidence", F.when(outlier, "low").otherwise(F.col("confidence")))
    out = out.withColumn("invoice_date", F.when(outlier & nearer, fixed).otherwise(F.col("invoice_date")))
    return out.select(*records.columns)


def enrich_review(records: DataFrame, batch: list[str] | None = None, page: list[str] | None = None) -> DataFrame:
    """Add amount_default, date_default, date_guessed, date_guess_src, status and confirm_default.

    A missing date is guessed from the record's own readings, else the mode of its
    page, else that of its batch.
    """
    page = page or ["file_id", "page_no"]
    keys = batch or []
    pages = modal(records, page, "invoice_date", "page_date").select(*page, "page_date")
    batches = modal(records, keys, "invoice_date", "batch_date").select(*keys, "batch_date")
    out = _with_facts(records.join(pages, page, "left"), batches, keys)
    own = F.get("date_candidates", F.lit(0))
    missing = F.col("invoice_date").isNull()
    guess = F.coalesce(own, F.col("page_date"), F.col("batch_date"))
    source = F.when(own.isNotNull(), "candidate").when(F.col("page_date").isNotNull(), "page").when(F.col("batch_date").isNotNull(), "batch")
    complete = ~missing & F.col("total_incl_tax").isNotNull()
    status = F.when(complete & (F.col("confidence") == "high"), "ok").when(complete & (F.col("confidence") == "medium"), "review").otherwise("missing")
    return out.select(
        *records.columns,
        F.col("total_incl_tax").alias("amount_default"),
        F.coalesce("invoice_date", guess, F.lit("")).alias("date_default"),
        (missing & guess.isNotNull()).alias("date_guessed"),
        F.when(missing, source).alias("date_guess_src"),
        status.alias("status"),
        (status == "ok").alias("confirm_default"),
    )


def date_suggestions(records: DataFrame, id_column: str = "ord", page: list[str] | None = None, most: int = 3) -> DataFrame:
    """(id, suggestions): own readings, the page's other dates by frequency, the batch's mode; distinct, the first ``most``."""
    page = page or ["file_id", "page_no"]
    dated = records.where(F.col("invoice_date").isNotNull())
    # The ``most`` + 1 most frequent dates of a page are enough: one may be the record's own, which counts for less.
    counts = dated.groupBy(*page, "invoice_date").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("n"), "invoice_date"))).where(F.col("rank") <= most + 1)
    by_page = ranked.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("invoice_date").alias("d")))).alias("page_dates"))
    joined = _with_facts(records.join(by_page, page, "left"), modal(dated, [], "invoice_date", "batch_date").select("batch_date"), [])
    # The record itself doesn't speak for its page.
    others = F.array_sort(F.filter(F.transform("page_dates", lambda s: F.struct((s["less"] + F.when(s["d"] == F.col("invoice_date"), 1).otherwise(0)).alias("less"), s["d"].alias("d"))), lambda s: s["less"] < 0))
    every = F.concat(F.coalesce("date_candidates", F.array().cast("array<string>")), F.coalesce(F.transform(others, lambda s: s["d"]), F.array().cast("array<string>")), F.array("batch_date"))
    return joined.select(id_column, F.slice(F.array_distinct(F.array_compact(every)), 1, most).alias("suggestions"))
