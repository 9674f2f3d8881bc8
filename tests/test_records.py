"""Total selection, classification and rows, rule by rule."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import classify, records, rows

RECEIPTS = {
    "P1": (["Total 931.00", "Service Charge 116.38", "To Pay 1047.38"], (1047.38, "high", None, "kw")),
    "P2": (["Subtotal 100.00", "Tax 15.00", "Total 115.00"], (115.00, "high", None, "kw")),
    "P3": (["Subtotal 180.00", "Tax 20.00", "Total 200.00", "Gratuity:", "TOTAL: 230.00"], (230.00, "medium", 200.00, "kw")),
    "P3b": (["Total 200.00", "Gratuity:", "TOTAL: 230.00"], (230.00, "medium", None, "kw")),
    "P4": (["Total 100.00", "C/Card 120.00"], (120.00, "medium", None, "tendered")),
    "P5": (["Total 100.00", "Card 150.00"], (150.00, "medium", None, "tendered")),
    "P6": (["Total 150.00", "Cash Tendered 200.00"], (150.00, "medium", None, "kw")),
    "P7": (["税额 13.00", "价税合计 113.00"], (113.00, "high", None, "kw")),
    "P8": (["Coffee 35.00", "1234"], (35.00, "low", None, "fallback")),
    "P9": (["Store 12", "345"], (345.0, "low", None, "fallback")),
}


@pytest.fixture(scope="module")
def parsed(spark):
    data = [(k, 1, 1, i, t) for k, (texts, _) in RECEIPTS.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "file_id string, page_no int, region_no int, row_no int, text string")
    return records.parse_rows(df).cache()


def test_totals(parsed):
    got = {r.file_id: (float(r.total_incl_tax), r.confidence, float(r.printed_total) if r.printed_total is not None else None, r.total_src) for r in parsed.collect()}
    assert got == {k: v for k, (_, v) in RECEIPTS.items()}


def test_only_bare_numbers_are_dropped(parsed):
    kept = {r.file_id for r in records.worth_keeping(parsed).collect()}
    assert kept == set(RECEIPTS) - {"P9"}


def test_rows_and_stacks(spark):
    lines = []
    for part in range(2):
        for i, t in enumerate(["TAX INVOICE", "Coffee", "Tea", "Total"]):
            y = 100 * part + 20 * i
            lines.append(("f", 1, len(lines), t, 0.0, float(y), 50.0, y + 10.0, None, None, 1))
            lines.append(("f", 1, len(lines), f"{i}.50", 60.0, y + 2.0, 90.0, y + 11.0, None, None, 1))
    df = spark.createDataFrame(lines, "file_id string, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, angle double, score double, region_no int")
    clustered = rows.cluster_rows(df)
    assert [r.text for r in clustered.orderBy("row_no").collect()] == ["TAX INVOICE 0.50", "Coffee 1.50", "Tea 2.50", "Total 3.50"] * 2
    split = rows.split_stacked(clustered.drop("members"), ["total"])
    assert [r.part for r in split.orderBy("row_no").collect()] == [0] * 4 + [1] * 4


def test_kinds(spark):
    texts = ["merchant copy approved", "TAX INVOICE approved rrn", "****1234 rrn", "增值税发票", "subtotal 5", "hello"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", classify.doc_kind(F.col("t")).alias("k"), classify.doc_type(F.col("t")).alias("y")).orderBy("i").collect()
    assert [r.k for r in got] == ["card_slip", "invoice", "card_slip", "invoice", "invoice", "invoice"]
    assert [r.y for r in got] == ["unknown", "western", "unknown", "vat", "western", "unknown"]


def test_notes_say_why(spark):
    texts = {"a": ["Subtotal 50.00", "Total 20.00"], "b": ["Tax 9.00", "Total 5.00", "Amount due 7.00"]}
    df = spark.createDataFrame([(k, 1, 1, i, t) for k, rows in texts.items() for i, t in enumerate(rows)], "file_id string, page_no int, region_no int, row_no int, text string")
    got = {r.file_id: (r.notes, r.confidence) for r in records.parse_rows(df).collect()}
    assert "total_below_subtotal 20.00 50.00" in got["a"][0] and got["a"][1] == "low"
    assert got["b"][0][:3] == ["total_below_tax 7.00 9.00", "candidates total=5.00, amount due=7.00", "by_word amount due"]
