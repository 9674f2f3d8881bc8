"""Receipt-like tables made from the driver's order and event tables by plain projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: clicks and errors as card slips, the others as invoices; every 17th has no date."""
    kind = F.when(F.col("event_type").isin("click", "error"), "card_slip").otherwise("invoice")
    date = F.when(F.col("event_id") % 17 != 0, F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd"))
    total = F.round("value", 2).cast("decimal(18,2)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("record_id"),
        F.col("event_id").alias("ord"),
        F.col("user_id").alias("batch_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_file"),
        kind.alias("doc_kind"),
        F.when(F.col("event_type") == "purchase", "vat").when(F.col("event_type") == "view", "western").otherwise("unknown").alias("invoice_type"),
        F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "medium").otherwise("low").alias("confidence"),
        date.alias("invoice_date"),
        F.when(date.isNotNull(), F.array(date)).otherwise(F.array().cast("array<string>")).alias("date_candidates"),
        total.alias("total_incl_tax"),
        F.lit(None).cast("decimal(18,2)").alias("printed_total"),
        F.lit(None).cast("decimal(18,2)").alias("subtotal"),
        F.lit(None).cast("decimal(18,2)").alias("tax"),
        F.lit(None).cast("decimal(18,2)").alias("tip"),
        F.array().cast("array<string>").alias("notes"),
    )


EVENT_RECORDS_SQL = """
SELECT event_id AS ord, user_id AS batch_id,
  CASE WHEN event_type IN ('click', 'error') THEN 'card_slip' ELSE 'invoice' END AS kind,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS type_rank,
  CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN event_id % 17 <> 0 THEN CAST(ts AS DATE) END AS d,
  CAST(round(CAST(round(value, 2) AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents
FROM events
"""


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of customers' batches: every 7th has no date, every 11th a year off by one."""
    year = F.when(F.col("o_orderkey") % 11 == 0, F.year("o_orderdate") + 1).otherwise(F.year("o_orderdate"))
    date = F.format_string("%04d-%02d-%02d", year, F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.col("o_orderkey").alias("ord"),
        F.col("o_custkey").alias("batch_id"),
        (F.col("o_custkey") % 25).cast("string").alias("file_id"),
        (F.col("o_orderkey") % 4).cast("int").alias("page_no"),
        F.when(F.col("o_orderkey") % 7 != 0, date).alias("invoice_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.array(date)).when(F.col("o_orderkey") % 14 == 0, F.array(F.lit("1999-09-09"))).otherwise(F.array().cast("array<string>")).alias("date_candidates"),
        F.when(F.col("o_orderkey") % 13 != 0, F.round("o_totalprice", 2).cast("decimal(18,2)")).alias("total_incl_tax"),
        F.when(F.col("o_orderkey") % 3 == 0, "high").when(F.col("o_orderkey") % 3 == 1, "medium").otherwise("low").alias("confidence"),
        F.array().cast("array<string>").alias("notes"),
    )


def dated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as invoices that all have their date."""
    date = F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd")
    return event_records(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), date.alias("d")), "ord").withColumn("doc_kind", F.lit("invoice")).withColumn("invoice_date", F.col("d")).withColumn("date_candidates", F.array("d")).drop("d")


def order_amounts(spark: SparkSession, sf_dir: str, kind: str = "invoice", dated: bool = True) -> DataFrame:
    """Orders as records of one kind with their amount and, if asked, their day."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd") if dated else F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.col("o_custkey").alias("batch_id"),
        F.lit(kind).alias("doc_kind"),
        F.round("o_totalprice", 2).cast("decimal(18,2)").alias("total_incl_tax"),
        F.lit(None).cast("decimal(18,2)").alias("printed_total"),
        date.alias("invoice_date"),
        F.array().cast("array<string>").alias("date_candidates"),
    )


ORDER_RECORDS_SQL = """
SELECT o_orderkey AS ord, o_custkey AS batch_id, CAST(o_custkey % 25 AS VARCHAR) AS file_id, o_orderkey % 4 AS page_no,
  CASE WHEN o_orderkey % 7 <> 0 THEN
    printf('%04d-%02d-%02d', year(o_orderdate) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END, month(o_orderdate), day(o_orderdate)) END AS invoice_date,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 14 = 0 THEN '1999-09-09' END AS candidate,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) END AS total,
  CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM orders
"""


def receipt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as the rows of a receipt: subtotal, tax, total and, for some, tip, written total or card."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % 500000 + 10000
    money = lambda c: F.format_string("%d.%02d", F.floor(c / 100).cast("long"), (c % 100).cast("long"))
    kind = F.col("o_orderkey") % 5
    sub, tax = F.col("sub"), F.floor(F.col("sub") * 15 / 100)
    tip = F.floor(F.col("sub") / 10)
    texts = F.array_compact(
        F.array(
            F.lit("Corner Shop"),
            F.when(kind != 4, F.concat(F.lit("Subtotal "), money(sub))),
            F.when(kind != 4, F.concat(F.lit("Sales Tax "), money(tax))),
            F.when(kind == 1, F.concat(F.lit("Tip "), money(tip))),
            F.when(kind != 4, F.concat(F.lit("Total "), money(F.when(kind == 1, sub + tax + tip).otherwise(sub + tax)))),
            F.when(kind == 2, F.lit("Gratuity:")),
            F.when(kind == 2, F.concat(F.lit("TOTAL: "), money(sub + tax + tip))),
            F.when(kind == 3, F.concat(F.lit("C/Card "), money(sub + tax + tip))),
            F.when(kind == 4, F.concat(F.lit("Coffee "), money(sub))),
        )
    )
    return o.withColumn("sub", cents).select(F.col("o_orderkey").cast("string").alias("file_id"), F.lit(1).alias("page_no"), F.lit(1).alias("region_no"), F.posexplode(texts).alias("row_no", "text"))


RECEIPTS_SQL = """
SELECT o_orderkey AS k, o_orderkey % 5 AS kind, s.sub, CAST(floor(s.sub * 15 / 100) AS BIGINT) AS tax, CAST(floor(s.sub / 10) AS BIGINT) AS tip
FROM orders, LATERAL (SELECT CAST(round(o_totalprice * 100) AS BIGINT) % 500000 + 10000 AS sub) s
"""


#: Not a constant: the optimiser would take it out of keys, and what is dealt by page would be moved again by file.
def _first_page() -> Column:
    return F.when(F.col("o_orderkey").isNotNull(), F.lit(1))


def _dealt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders, dealt before they become lines: a small file is read by one task."""
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), rows=20_000)


#: Rows of a drawn receipt; {} is its number.
DRAWN = ["TAX INVOICE", "Date 07/03/2026", "Coffee beans and milk 35.00", "Subtotal 100.00", "Sales Tax 15.00", "Total 115.00", "Thank you for coming"]


def drawn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of up to three receipts side by side: order k is on page k div 3, at k mod 3, some of them set lower."""
    k = F.col("o_orderkey")
    rows = F.posexplode(F.array(*map(F.lit, DRAWN))).alias("i", "text")
    left, top = (k % 3) * 700.0, (k % 5) * 10.0 + F.col("i") * 40.0
    return _dealt_orders(spark, sf_dir).select("o_orderkey", rows).select(
        F.floor(k / 3).cast("string").alias("file_id"),
        _first_page().alias("page_no"),
        ((k % 3) * 100 + F.col("i")).cast("int").alias("line_no"),
        "text",
        left.alias("x0"),
        top.alias("y0"),
        (left + 400.0).alias("x1"),
        (top + 25.0).alias("y1"),
        F.lit(0.0).alias("angle"),
        F.lit(0.99).alias("score"),
    )


DRAWN_SQL = """
SELECT CAST(o_orderkey // 3 AS VARCHAR) AS file_id, CAST(o_orderkey % 3 * 100 + i AS INTEGER) AS line_no, o_orderkey AS k, o_orderkey % 3 AS slot, i, count(*) OVER (PARTITION BY o_orderkey // 3) AS n
FROM orders, range(7) t(i)
"""


#: What is printed in the pieces of a receipt: (piece, text, left, top, width).
PIECES = [
    ("names", "TAX INVOICE", 0, 0, 200),
    ("names", "Date 07/03/2026", 0, 40, 200),
    ("names", "Coffee beans", 0, 80, 200),
    ("names", "Milk and sugar", 0, 120, 200),
    ("names", "Sales Tax", 0, 160, 200),
    ("amounts", "35.00", 300, 80, 90),
    ("amounts", "65.00", 300, 120, 90),
    ("amounts", "15.00", 300, 160, 90),
    ("foot", "Total 115.00", 10, 290, 380),
    ("foot", "Paid by card 115.00", 10, 330, 380),
    ("foot", "Thank you for coming", 10, 370, 380),
    ("scrap", "x", 40, 520, 20),
    ("stray", "zz", 560, 900, 20),
]


def pieced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of up to three receipts that are printed in pieces: order k is on page k div 3, at k mod 3.

    Names and amounts stand in strips side by side, the foot is set off by more than
    lines of one group may be, every second receipt has a scrap below, every fifth
    a stray sign far from all.
    """
    k, slot = F.col("o_orderkey"), F.col("o_orderkey") % 3
    piece = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("piece", "text", "x", "y", "w"), p, strict=True)]) for p in PIECES])
    rows = _dealt_orders(spark, sf_dir).select("o_orderkey", F.posexplode(piece).alias("i", "p")).where(((F.col("p.piece") != "scrap") | (k % 2 == 0)) & ((F.col("p.piece") != "stray") | (k % 5 == 0)))
    left, top = slot * 1000.0 + F.col("p.x"), (k % 7) * 9.0 + F.col("p.y")
    return rows.select(
        F.floor(k / 3).cast("string").alias("file_id"),
        _first_page().alias("page_no"),
        (slot * 100 + F.col("i")).cast("int").alias("line_no"),
        F.col("p.text").alias("text"),
        left.alias("x0"),
        top.alias("y0"),
        (left + F.col("p.w")).alias("x1"),
        (top + 25.0).alias("y1"),
        F.lit(0.0).alias("angle"),
        F.lit(0.99).alias("score"),
    )


PIECED_SQL = f"""
SELECT CAST(o_orderkey // 3 AS VARCHAR) AS file_id, CAST(o_orderkey % 3 * 100 + i AS INTEGER) AS line_no, o_orderkey % 3 AS slot, i
FROM orders, range({len(PIECES)}) t(i) WHERE (i <> 11 OR o_orderkey % 2 = 0) AND (i <> 12 OR o_orderkey % 5 = 0)
"""


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey image for each supplier: two receipts of small strokes; every third page has a fold between them, every second a foot set off below the right one."""
    k, width, height = F.col("s_suppkey"), 760, 480
    white = lambda n: F.lit("FF" * n)
    strokes = F.lit(("00" * 8 + "FF" * 6) * 19 + "00" * 8)
    line = lambda y, top, n: (y >= top) & (y < top + 24 * n) & (F.pmod(y - top, F.lit(24)) < 12)

    def row(y):
        left = F.when(line(y, 20, 12), strokes).otherwise(white(274))
        right = F.when(line(y, 30, 11) | ((k % 2 == 1) & line(y, 372, 4)), strokes).otherwise(white(274))
        fold = F.when(k % 3 == 0, F.lit("FF" * 51 + "00" * 3 + "FF" * 52)).otherwise(white(106))
        return F.concat(white(40), left, fold, right, white(66))

    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row), ""))
    # Dealt before they are drawn: an image is some 360 KB.  The keys are written, or a filter on pixels would be moved to the one task that reads them.
    return cut(spread(table(spark, sf_dir, "supplier").select("s_suppkey"), rows=200)).select(k.cast("string").alias("file_id"), F.lit(1).alias("page_no"), F.lit(height).alias("height"), F.lit(width).alias("width"), pixels.alias("pixels"))
