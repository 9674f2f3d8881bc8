"""From a folder to records: every strategy, and files that fail."""

import json
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerloom.plans import folder
from ledgerloom.plans.progress import Feed
from ledgerloom.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests

RECEIPT = ["TAX INVOICE", "Date 07/03/2026", "Coffee beans and milk 35.00", "Subtotal 100.00", "Sales Tax 15.00", "Total 115.00", "Thank you for coming"]


def drawn(texts, x, y=0.0):
    return [{"text": t, "x0": x, "y0": y + 40.0 * i, "x1": x + 400, "y1": y + 40.0 * i + 25, "angle": 0.0, "score": 0.9} for i, t in enumerate(texts)]


def priced(total):
    return [t.replace("115.00", total).replace("Subtotal 100.00", "Tea").replace("Sales Tax 15.00", "Milk") for t in RECEIPT]


def engine(content):
    if content == b"bad":
        raise OSError("broken")
    return json.loads(content)["lines"]


def decode(content):
    boxes = json.loads(content).get("ink")
    if not boxes:
        raise OSError("no image")
    image = np.full((900, 1200, 3), 255, dtype=np.uint8)
    for left in boxes:
        for y in range(50, 750, 24):
            for x in range(left, left + 400, 14):
                image[y : y + 12, x : x + 8] = 0
    return 900, 1200, image.tobytes()


def reader(content):
    if content == b"bad":
        raise ValueError("no document")
    words = [{"text": w, "x0": 60.0 * k, "top": 40.0 * i, "x1": 60.0 * k + 50, "bottom": 40.0 * i + 12} for i, t in enumerate(priced("77.00")) for k, w in enumerate(t.split())]
    yield {"layer": lambda: words, "draw": lambda: b"unused"}
    yield {"layer": lambda: [], "draw": lambda: json.dumps({"lines": drawn(priced("66.00"), 0.0)}).encode()}


def crop(content, box, angle, factor):
    if box[0] > 500:
        return []  # a second reading that finds nothing is not taken
    return [x | {"text": x["text"].replace("115.00", "116.00").replace("Tax 15.00", "Tax 16.00")} for x in json.loads(content)["lines"] if x["x0"] < 500]


def test_folder(spark, tmp_path):
    page = lambda **k: json.dumps(k).encode()
    (tmp_path / "in").mkdir()
    put = {
        "a.png": page(lines=drawn(RECEIPT, 0.0) + drawn(priced("88.00"), 700.0)),
        "b.jpg": page(lines=drawn(priced("55.00"), 0.0)),
        "c.png": page(lines=drawn(priced("44.00")[1:3] + priced("44.00")[5:6], 50.0, 60.0) + drawn(priced("33.00")[1:2] + priced("33.00")[5:6], 650.0, 60.0), ink=[50, 650]),
        "d.pdf": b"good",
        "e.pdf": b"bad",
        "f.png": b"bad",
        "g.txt": b"x",
    }
    for name, content in put.items():
        (tmp_path / "in" / name).write_bytes(content)
    heard = []
    batch = folder.process_folder(spark, str(tmp_path / "in"), folder.Adapters(engine, reader, decode, crop), notify=lambda *told: heard.append(told))
    done = [d for d, _, _ in heard]
    assert done == sorted(set(done)) and done[-1] == 5 and {t for _, t, _ in heard} == {5}
    assert all(name.endswith((".png", ".jpg", ".pdf")) for _, _, name in heard)
    got = {(r.file_id[-5:], r.page_no, float(r.total_incl_tax)): r.strategy for r in batch.records.collect()}
    assert got == {
        ("a.png", 1, 116.0): "receipts",
        ("a.png", 1, 88.0): "receipts",
        ("b.jpg", 1, 55.0): "page",
        ("c.png", 1, 44.0): "raster",
        ("c.png", 1, 33.0): "raster",
        ("d.pdf", 1, 77.0): "layer",
        ("d.pdf", 2, 66.0): "page",
    }
    errors = {r.file_id[-5:]: r.notes[0] for r in batch.errors.collect()}
    assert errors == {"e.pdf": "ValueError: no document", "f.png": "OSError: broken", "g.txt": "unsupported file type"}
    counts = batch.counts()
    assert (counts["files"], counts["pages"], counts["records"]) == (6, 7, 7)
    assert (counts["images"], counts["documents"], counts["document_pages"]) == (4, 2, 3)


def test_contents_of_other_types_are_not_read(spark, tmp_path):
    for name in ("a.PNG", "b.pdf", "c.PdF", "d.txt", "e.tiff", "pdf", "f.pdf.bak"):
        (tmp_path / name).write_bytes(name.encode())
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.input_files(spark, str(tmp_path), ["pdf"])) == ["b.pdf", "c.PdF"]
    assert names(files.input_files(spark, str(tmp_path))) == ["a.PNG", "b.pdf", "c.PdF", "e.tiff"]
    assert names(files.unsupported_files(spark, str(tmp_path)).withColumnRenamed("file_id", "path")) == ["d.txt", "f.pdf.bak", "pdf"]
    assert names(files.input_files(spark, str(tmp_path), ["webp"])) == []


def made_engine():
    made_engine.times = getattr(made_engine, "times", 0) + 1
    return lambda content: [{"text": f"made {made_engine.times}", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}]


def test_one_engine_for_each_worker():
    assert files.one_per_worker(made_engine)(b"")[0]["text"] == "made 1"
    assert files.one_per_worker(made_engine)(b"")[0]["text"] == "made 1"


def test_unreadable_layer_draws_the_document(spark):
    def broken():
        raise KeyError("layer")

    def odd(content):
        yield {"layer": lambda: [{"text": "long enough text", "x0": 0.0, "top": 0.0, "x1": 9.0, "bottom": 9.0}], "draw": lambda: b"one"}
        yield {"layer": broken, "draw": lambda: b"two"}

    docs = spark.createDataFrame([("x.pdf", bytearray(b"1"))], "path string, content binary")
    rows = files.document_pages(docs, odd).orderBy("page_no").collect()
    assert [(r.page_no, bytes(r.content), r.layer) for r in rows] == [(1, b"one", None), (2, b"two", None)]
    assert files.document_pages(docs, lambda c: [{"layer": lambda: [], "draw": broken}]).select(F.col("error")).first()[0] == "KeyError: 'layer'"


def test_forced_split_and_crops(spark, tmp_path):
    """A record of two receipts read as one is replaced by those of its bands."""
    two = json.dumps({"lines": drawn(priced("20.00"), 0.0) + drawn(priced("30.00"), 0.0, 300.0)}).encode()

    def banded(content, box, angle, factor):
        return [x for x in json.loads(content)["lines"] if box[1] <= (x["y0"] + x["y1"]) / 2 < box[3]]

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(two)
    adapters = folder.Adapters(engine, crop=banded)
    batch = folder.process_folder(spark, str(tmp_path / "in"), adapters)
    before = batch.records.select("*").collect()
    page = spark.createDataFrame([(before[0].file_id, 1, 1, bytearray(two), 0.0, 0.0, 400.0, 600.0)], "file_id string, page_no int, region_no int, content binary, x0 double, y0 double, x1 double, y1 double")
    kept = spark.createDataFrame(before, batch.records.schema)
    after = folder.force_split(kept, before[0].record_id, page, 2, adapters).collect()
    failing = folder.Adapters(engine, crop=lambda *a: 1 / 0)
    assert folder.force_split(kept, before[0].record_id, page, 2, failing).count() == len(before)
    gone = {r.record_id for r in before} - {r.record_id for r in after}
    assert gone == {before[0].record_id}
    assert {float(r.total_incl_tax) for r in after if r.record_id.startswith(before[0].record_id + "#")} == {20.0, 30.0}
    assert all(r.date_default == "2026-03-07" for r in after)
    lines = spark.createDataFrame([("f", 1, 1, 0.0, 0.0, 9.0, 9.0), ("f", 1, 2, 0.0, 0.0, 9.0, 9.0)], "file_id string, page_no int, region_no int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("f", 1, bytearray(b"image"))], "file_id string, page_no int, content binary")

    def encode(content, box):
        return content + b"!"

    assert [bytes(r.crop) for r in folder.crops(lines, pages, encode).collect()] == [b"image!", b"image!"]
    assert folder.crops(lines, pages, lambda content, box: 1 / 0).where("crop is null").count() == 2


def test_an_image_moves_once_with_all_its_boxes(spark):
    """Bytes handed over don't grow with a page's regions; pages without an image, and regions without a page, stop nothing."""
    region = "file_id string, page_no int, region_no int, x0 double, y0 double, x1 double, y1 double"
    lines = spark.createDataFrame([("f", p, r, float(r), 0.0, float(r + 1), 9.0) for p in (1, 2) for r in range(1, 301)] + [("lost", 1, 1, 0.0, 0.0, 1.0, 1.0)], region)
    pages = spark.createDataFrame([("f", 1, bytearray(b"one")), ("f", 2, None), ("g", 1, bytearray(b"unused"))], "file_id string, page_no int, content binary")
    asked = folder.imaged(folder.page_boxes(lines), pages).collect()
    assert sorted((r.page_no, r.content, len(r.boxes)) for r in asked if r.content) == [(1, b"one", 300)] and len(asked) == 2
    got = {(r.page_no, r.region_no): r.crop for r in folder.crops(lines, pages, lambda content, box: content + str(int(box[0])).encode()).collect()}
    assert len(got) == 600 and all(got[1, r] == b"one%d" % r and got[2, r] == b"%d" % r for r in range(1, 301))
    assert folder.crops(lines.limit(0), pages, lambda content, box: content).count() == 0


def test_feed_never_says_more_than_there_is(spark):
    heard = []
    with Feed(spark, 3, lambda *told: heard.append(told), seconds=0.01) as feed:
        feed.pages.add((2, "a"))
        feed.pages.add((2, ""))
    assert heard[-1] == (3, 3, "a") and [d for d, _, _ in heard] == sorted({d for d, _, _ in heard})
    with Feed(spark, 0, lambda *told: heard.append("none")):
        pass
    assert "none" not in heard
