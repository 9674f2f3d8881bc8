"""Layout on drawn pages, the whole plan, sinks, sources and streams."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Settings, TemplateSettings, load
from ledgerloom.operators import layout
from ledgerloom.plans import extraction
from ledgerloom.schema import LINE
from ledgerloom.sources import files, workbook

RECEIPT = ["TAX INVOICE", "Date 07/03/2026", "Coffee beans and milk 35.00", "Subtotal 100.00", "Sales Tax 15.00", "Total 115.00", "Thank you for coming"]


def page(texts, x, y, file_id="f", page_no=1, start=0, width=400.0):
    return [(file_id, page_no, start + i, t, x, y + 40.0 * i, x + width, y + 40.0 * i + 25, 0.0, 0.99) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def two(spark):
    other = [t.replace("07/03/2026", "08/03/2026").replace("115.00", "115.01") for t in RECEIPT]
    return spark.createDataFrame(page(RECEIPT, 0.0, 0.0) + page(other, 700.0, 0.0, start=20), LINE)


def test_receipts_side_by_side(two):
    found = layout.cluster_receipts(two).groupBy("region_no").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x")).orderBy("region_no").collect()
    assert [(r.region_no, r.n, r.x) for r in found] == [(1, 7, 0.0), (2, 7, 700.0)]


def test_stacked_receipts(spark):
    lines = spark.createDataFrame(page(RECEIPT, 0.0, 0.0) + page(RECEIPT, 0.0, 420.0, start=20), LINE)
    assert [r.n for r in layout.cluster_receipts(lines).groupBy("region_no").agg(F.count(F.lit(1)).alias("n")).collect()] == [7, 7]
    # A few lines are no page of receipts.
    assert layout.cluster_receipts(spark.createDataFrame(page(RECEIPT[:3], 0.0, 0.0), LINE)).where("region_no is not null").count() == 0


def test_text_blocks(spark):
    lines = spark.createDataFrame(page(RECEIPT, 0.0, 0.0) + page(RECEIPT, 600.0, 0.0, start=20) + page(RECEIPT, 0.0, 500.0, start=40), LINE)
    found = layout.segment_text_lines(lines).groupBy("region_no").agg(F.count(F.lit(1)).alias("n"), F.min("y0").alias("y"), F.min("x0").alias("x")).orderBy("region_no").collect()
    assert [(r.n, r.x, r.y) for r in found] == [(7, 0.0, 0.0), (7, 0.0, 500.0), (7, 600.0, 0.0)]


def test_wide_region_and_edges(spark, two):
    region = two.withColumn("region_no", F.lit(1)).drop("region_no")
    parts = layout.refine_wide_regions(region, ["file_id", "page_no"]).groupBy("region_no").count().collect()
    assert sorted(r["count"] for r in parts) == [7, 7]
    stray = spark.createDataFrame(page(RECEIPT, 0.0, 0.0) + [("f", 1, 30, "x", 500.0, 10.0, 530.0, 30.0, 0.0, 0.9)], LINE)
    assert layout.strip_edge_bleed(stray, ["file_id", "page_no"]).count() == 7
    assert layout.upscale_factor(two, ["file_id"]).first().factor == pytest.approx(1.6)
    assert layout.deskew_angle(two.withColumn("angle", F.lit(2.0)), ["file_id"]).first().angle == 2.0


def test_order_and_gaps(spark):
    boxes = [(100.0, 0.0, 180.0, 10.0), (0.0, 50.0, 80.0, 60.0), (0.0, 0.0, 80.0, 10.0), (110.0, 50.0, 170.0, 60.0)]
    df = spark.createDataFrame([("f", k, *b) for k, b in enumerate(boxes)], "file_id string, k int, x0 double, y0 double, x1 double, y1 double")
    assert [r.k for r in layout.column_major(df, ["file_id"]).orderBy("place").collect()] == [2, 1, 0, 3]
    spans = spark.createDataFrame([("f", 0.0, 10.0), ("f", 50.0, 60.0), ("f", 52.0, 70.0)], "file_id string, x0 double, x1 double")
    found = lambda most: [(r.begin, r.finish) for r in layout.quiet_stretches(spans, ["file_id"], "x", F.lit(most)).orderBy("begin").collect()]
    assert found(0) == [(10.0, 50.0)] and found(1) == [(0.0, 52.0)]


def test_strips_of_one_receipt_are_joined(spark):
    """Names and amounts set apart, with a second receipt beside them that must stay apart."""
    names = ["TAX INVOICE", "Date 07/03/2026", "Coffee beans", "Milk and sugar", "Subtotal", "Sales Tax", "Total"]
    amounts = ["35.00", "65.00", "100.00", "15.00", "115.00"]
    left = page(names, 0.0, 0.0, width=200.0)
    right = page(amounts, 300.0, 80.0, start=10, width=80.0)
    lines = spark.createDataFrame(left + right + page(RECEIPT, 900.0, 0.0, start=20), LINE)
    found = {r.region_no: (r.n, r.x) for r in layout.cluster_receipts(lines).groupBy("region_no").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x")).collect()}
    assert found == {1: (12, 0.0), 2: (7, 900.0)}


def test_scraps_are_settled(spark):
    """A short line near a receipt joins it; one far from all that says nothing is dropped."""
    lines = spark.createDataFrame(page(RECEIPT, 0.0, 0.0) + page(["x"], 20.0, 480.0, start=10, width=30.0) + page(["zz"], 1500.0, 900.0, start=11, width=30.0) + page(RECEIPT, 700.0, 0.0, start=20), LINE)
    got = {r.line_no: r.region_no for r in layout.cluster_receipts(lines).collect()}
    assert got[10] == 1 and got[11] is None and got[20] == 2


def test_many_pages_at_once(spark):
    """Pages are placed as each would be alone."""
    pages = [(f"f{k}", page(RECEIPT, 0.0, 0.0, file_id=f"f{k}") + (page(RECEIPT, 700.0, 13.0 * k, file_id=f"f{k}", start=20) if k % 2 else [])) for k in range(6)]
    together = {(r.file_id, r.line_no): r.region_no for r in layout.cluster_receipts(spark.createDataFrame([x for _, p in pages for x in p], LINE)).collect()}
    for name, p in pages[:4]:
        if len(p) >= 8:
            alone = {(r.file_id, r.line_no): r.region_no for r in layout.cluster_receipts(spark.createDataFrame(p, LINE)).collect()}
            assert alone == {k: v for k, v in together.items() if k[0] == name}
    assert {v for k, v in together.items() if k[0] == "f0"} == {None}


def test_whole_plan(two):
    done = extraction.finish(extraction.extract(two)).orderBy("invoice_date").collect()
    assert [(r.invoice_date, float(r.total_incl_tax), r.confidence, r.status) for r in done] == [("2026-03-07", 115.0, "high", "ok"), ("2026-03-08", 115.01, "high", "ok")]


def test_books(spark, two):
    found = extraction.finish(extraction.extract(two)).orderBy("invoice_date")
    cells = workbook.read_book(workbook.template_book(found))
    assert (cells["B5"], cells["C5"], cells["K5"], cells["K6"]) == ("2026-03-07", "2026-03-07", "115.00", "115.01")
    from ledgerloom.operators.review import review_colour

    cells = workbook.read_book(workbook.review_book(review_colour(found)))
    assert cells["A1"] == "来源文件" and cells["H2"] == "发票" and cells["L1"] == "原图（对着改）"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (600).to_bytes(4, "big") + (400).to_bytes(4, "big")
    assert workbook.image_size(png) == ("png", 600, 400)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"rest"
    assert workbook.image_size(jpeg) == ("jpeg", 200, 300) and workbook.image_size(b"text") is None
    with_crops = review_colour(found).withColumn("crop", F.when(F.col("invoice_date") == "2026-03-07", F.lit(bytearray(png))))
    import io
    import zipfile

    book = zipfile.ZipFile(io.BytesIO(workbook.review_book(with_crops)))
    assert book.read("xl/media/crop1.png") == png and 'ht="150"' in book.read("xl/worksheets/sheet1.xml").decode()
    assert "<xdr:col>11</xdr:col>" in book.read("xl/drawings/drawing1.xml").decode()


def test_books_in_tasks_and_templates(spark):
    rows = [(f"b{i % 2}", i, f"2026-01-{i + 1:02d}", float(i) if i != 4 else None, "card_slip") for i in range(9)]
    df = spark.createDataFrame(rows, "batch string, i int, invoice_date string, total_incl_tax double, doc_kind string")
    template = TemplateSettings(columns={"invoice_date": ["B"], "total_incl_tax": ["D"], "doc_kind": ["F"]}, sheet="Data", header_row=1, start_row=3)
    books = {(r.batch, r.book): (r.n, workbook.read_book(bytes(r.content))) for r in workbook.template_books(df, ["batch"], ["i"], template, most=3).collect()}
    assert {k: n for k, (n, _) in books.items()} == {("b0", 0): 3, ("b0", 1): 2, ("b1", 0): 3, ("b1", 1): 1}
    first = books["b0", 0][1]
    assert (first["B3"], first["D3"], first["F3"], first["B5"]) == ("2026-01-01", "0.0", "刷卡小票", "2026-01-05") and "D5" not in first
    own = workbook.template_book(df.where("i < 2").orderBy("i"), template)
    again = workbook.read_book(workbook.template_book(df.where("i = 8"), TemplateSettings(columns={"invoice_date": ["B", "A"]}, sheet="none", start_row=4), source=own))
    assert (again["B3"], again["B4"], again["A4"], again["B1"]) == ("2026-01-01", "2026-01-09", "2026-01-09", "发票日期")


def test_sources(spark, tmp_path):
    for name in ("b.JPG", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path[-5:] for r in files.input_files(spark, str(tmp_path)).select("path").collect()) == ["a.pdf", "b.JPG"]
    assert [r.file_id[-5:] for r in files.unsupported_files(spark, str(tmp_path)).collect()] == ["c.txt"]
    pages = spark.createDataFrame([("good", 1, bytearray(b"1")), ("bad", 1, bytearray(b"2"))], "file_id string, page_no int, content binary")

    def engine(content):
        if content == b"2":
            raise OSError("broken")
        return [{"text": "Tota1 5.00", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "score": s} for s in (0.9, 0.2)]

    lines = files.recognised_lines(pages, engine)
    assert [r.text for r in lines.where("error is null").collect()] == ["Total 5.00"]
    assert files.error_records(lines).first().notes == ["OSError: broken"]
    quad = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (0, 100), (-20, 100), (-20, 0))])
    assert spark.range(1).select(files.quad_angle(quad).alias("a")).first().a == pytest.approx(0.0)


def test_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("dedup: {mode: mark, date_tolerance_days: 2}\nparsing: {date_order: mdy}\ntemplate: {columns: {tax: D}, start_row: 9}\n")
    s = load(p)
    assert (s.link.mode, s.link.date_tolerance_days, s.date_order, s.template.columns, s.template.start_row) == ("mark", 2, "mdy", {"tax": ["D"]}, 9)
    assert Settings().link.date_tolerance_days == 0


def test_stream_equals_batch(spark, tmp_path):
    from ledgerloom.streaming.links import amounts_by_window, distinct_records

    rows = [(i, f"2024-01-{1 + i % 9:02d} 10:00:00", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5], "id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    unique = distinct_records(stream, ["id"], late="30 days")
    q = unique.writeStream.format("memory").queryName("unique_records").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("unique_records").count() == 40
    batch = amounts_by_window(spark.table("unique_records"))
    assert batch.agg(F.sum("n")).first()[0] == 40


def test_links_on_arrival(spark, tmp_path):
    """A stream's links, over the edges of amount groups and batches, are those of the records before each."""
    import random

    rng = random.Random(4)
    rows = [(f"r{i:03d}", f"u{rng.randrange(2)}", 86400 * (100 + i // 6) + 3600 * (i % 6), rng.choice([99, 100, 101, 199, 200, 250, 251])) for i in range(90)]
    df = spark.createDataFrame(rows, "record_id string, user string, s long, cents long").withColumn("ts", F.col("s").cast("timestamp")).drop("s")
    for k in range(3):  # one file, and so one batch, after another
        df.where((F.substring("record_id", 2, 3).cast("int") >= 30 * k) & (F.substring("record_id", 2, 3).cast("int") < 30 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from ledgerloom.streaming.links import linked_on_arrival

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = linked_on_arrival(stream, ["user"], days=3, late="10 days").writeStream.format("memory").queryName("linked_records").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.record_id: r.of for r in spark.table("linked_records").collect()}
    expected = {}
    for i, (name, user, s, cents) in enumerate(rows):
        near = [(b, a) for a, u, b, c in rows[:i] if u == user and abs(c - cents) <= 1 and abs(b - s) <= 3 * 86400]
        expected[name] = min(near)[1] if near else None
    assert got == expected and sum(v is not None for v in got.values()) > 20


def blocks_by_hand(lines):
    """line_no -> block, by the covered pixels of a page."""
    import math

    import numpy as np

    boxes = [x for x in lines if x[3].strip()]
    height, foot = float(np.median([b[7] - b[5] for b in boxes])), max(b[7] for b in boxes)

    def before(own, k, most, least):
        low, high = [math.floor(max(b[k], 0.0)) for b in own], [math.floor(b[k + 2]) + 1 for b in own]
        begin, cover = min(low), np.zeros(max(high) - min(low), dtype=int)
        for a, b in zip(low, high, strict=True):
            cover[a - begin : b - begin] += 1
        edge = np.flatnonzero(np.diff(np.pad(cover <= most, 1).astype(int))) + begin
        cuts = [(a + b) / 2 for a, b in zip(edge[::2], edge[1::2], strict=True) if b < max(high) and b - a >= least]
        return [sum(c < (b[k] + b[k + 2]) / 2 for c in cuts) for b in own]

    column, place, region, found = before(boxes, 4, 1, max(0.8 * height, 10.0)), {}, 0, {}
    for c in sorted(set(column)):
        own = [b for b, k in zip(boxes, column, strict=True) if k == c]
        for b, k in zip(own, before(own, 5, 0, max(3 * height, 0.025 * foot)), strict=True):
            place.setdefault((c, k), []).append(b)
    for _, own in sorted(place.items()):
        region += len(own) >= 3 and sum(len(b[3].strip()) for b in own) >= 20
        found |= {b[2]: region or None for b in own}
    return found


def test_blocks_of_random_pages(spark):
    import random

    rng, rows, expected = random.Random(5), [], {}
    for p in range(120):
        step, left = (20 if p % 2 else 1), [rng.randrange(0, 1500, 50) for _ in range(rng.randint(1, 4))]
        own = []
        for i in range(rng.choice([1, 4, 12, 40])):
            x, y = rng.choice(left) + rng.choice([0, step]), rng.randrange(0, rng.choice([300, 1200]), step)
            own.append((f"f{p}", 1, i, rng.choice(["Total 5.00", "a longer line of text", "x", "  "]), float(x), float(y), float(x + rng.choice([20, 200, 380])), float(y + rng.choice([15, 25])), 0.0, 0.9))
        if any(x[3].strip() for x in own):
            rows += own
            expected |= {(f"f{p}", i): r for i, r in blocks_by_hand(own).items()}
    got = {(r.file_id, r.line_no): r.region_no for r in layout.segment_text_lines(spark.createDataFrame(rows, LINE)).collect()}
    assert len(got) == len(rows) and {k: v for k, v in got.items() if v} == {k: v for k, v in expected.items() if v}
    assert max(filter(None, got.values())) > 2 and None in got.values()


def test_text_lines_move_by_page_and_for_their_numbers(spark, two):
    """One exchange of boxes, and the two sides of the last join, whatever columns and blocks a page has."""
    found = layout.segment_text_lines(two, tasks=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Broadcast" not in plan
