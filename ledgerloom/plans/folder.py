"""From a folder of files to reviewed records, with every file accounted for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import consensus, layout, raster, records, review, rows
from ..operators.lineage import cut
from ..operators.rows import REGION
from ..sources import files
from . import extraction
from .progress import Feed


@dataclass(frozen=True)
class Adapters:
    """What this engine has no libraries for; each runs in the workers.

    engine: lines of an image; or factory: a module's function that makes such an
    engine, called once in each worker.  reader: pages of a document (see
    ``files.document_pages``).  decode: (height, width, RGB bytes) of an image, for
    pages on which receipts are told apart by their ink.  crop: the image of a part (x0,
    y0, x1, y1) of an image, turned by an angle and enlarged by a factor, and the
    engine's lines of it in the page's pixels, for a second, finer recognition.
    """

    engine: Callable[[bytes], list[dict]] | None = None
    reader: Callable[[bytes], Iterable[dict]] | None = None
    decode: Callable[[bytes], tuple[int, int, bytes]] | None = None
    crop: Callable[[bytes, tuple[float, float, float, float], float, float], list[dict]] | None = None
    factory: Callable[[], Callable[[bytes], list[dict]]] | None = None


@dataclass
class Batch:
    """Records and the error records of files that gave none, and what was counted on the way (once a sink has run)."""

    records: DataFrame
    errors: DataFrame
    observed: dict[str, Observation] = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        """images, documents and document_pages, files and pages of both sorts, lines and records."""
        seen = {k: v for o in self.observed.values() for k, v in o.get.items()}
        return seen | {"files": seen["images"] + seen["documents"], "pages": seen["images"] + seen["document_pages"]}


def _seen(df: DataFrame, name: str, observed: dict[str, Observation]) -> DataFrame:
    observed[name] = Observation(name)
    return df.observe(observed[name], F.count(F.lit(1)).alias(name))


def page_boxes(lines: DataFrame) -> DataFrame:
    """(file_id, page_no, region_no, x0, y0, x1, y1, n): the box of each region's lines and their number."""
    return lines.groupBy(*REGION).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"))


def imaged(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, page_no, boxes, content): each page's image once, with all of its boxes in order of their regions.

    However many regions a page has, its image is moved and handed over once.
    """
    listed = boxes.groupBy(*layout.PAGE).agg(F.array_sort(F.collect_list(F.struct(*[c for c in boxes.columns if c not in layout.PAGE]))).alias("boxes"))
    return listed.join(pages.select("file_id", "page_no", "content"), layout.PAGE)


def _for_each_box(work: Callable[[bytes, dict], list[tuple]], added: str) -> tuple[Callable, str]:
    """A function of Arrow batches of ``imaged``, and its schema: file_id, page_no, region_no and what ``work`` gives of every box, a page at a time."""
    import pyarrow as pa

    schema = f"file_id string, page_no int, region_no int, {added}"
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                page = batch.slice(i, 1).to_pylist()[0]
                content = page["content"] if page["content"] is not None else b""
                out = [(page["file_id"], page["page_no"], b["region_no"], *row) for b in page["boxes"] for row in work(content, b)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return run, schema


def _finer(lines: DataFrame, pages: DataFrame, crop: Callable, settings: Settings) -> DataFrame:
    """Lines of receipts recognised again, each from its own straightened and enlarged part of the page.

    A second reading that finds fewer than three lines, or half of the first one's, is
    not taken.
    """
    angle, factor = layout.deskew_angle(lines, REGION, settings.dpi / 200), layout.upscale_factor(lines, REGION)
    asked = imaged(page_boxes(lines).join(angle, REGION).join(factor, REGION), pages)

    def read(content: bytes, b: dict) -> list[tuple]:
        try:
            found = crop(content, (b["x0"], b["y0"], b["x1"], b["y1"]), b["angle"], b["factor"])
        except Exception:  # the first reading stays
            return []
        if len(found) < max(3, 0.5 * b["n"]):
            return []
        real = lambda v: None if v is None else float(v)
        return [(n, x["text"], *[real(x.get(k)) for k in ("x0", "y0", "x1", "y1", "angle", "score")]) for n, x in enumerate(found)]

    again = cut(rows.usable_lines(asked.mapInArrow(*_for_each_box(read, "line_no int, text string, x0 double, y0 double, x1 double, y1 double, angle double, score double"))))
    first = lines.join(again.select(*REGION).distinct(), REGION, "left_anti")
    return first.unionByName(again.select(*first.columns))


def placed_lines(lines: DataFrame, pages: DataFrame, adapters: Adapters, settings: Settings = Settings()) -> DataFrame:
    """Lines of OCR pages with region_no and the ``strategy`` of their page.

    receipts: two receipts or more are told apart by their lines.  raster: else, by
    the ink of the image, where it can be decoded and shows two or more.  page: the
    whole page is one.
    """
    usable = cut(rows.usable_lines(lines))
    if not settings.segment:
        return usable.withColumn("region_no", F.lit(1)).withColumn("strategy", F.lit("page"))
    found = cut(layout.cluster_receipts(usable, settings.dpi / 200))
    several = found.groupBy(*layout.PAGE).agg((F.coalesce(F.max("region_no"), F.lit(0)) >= 2).alias("several"))
    found = found.join(several, layout.PAGE)
    receipts = layout.strip_edge_bleed(found.where("several and region_no is not null").drop("several"), REGION)
    if adapters.crop:
        receipts = _finer(receipts, pages, adapters.crop, settings)
        receipts = layout.strip_edge_bleed(receipts, REGION)
    wide = receipts.withColumnRenamed("region_no", "outer_no")
    parts = layout.refine_wide_regions(wide, [*layout.PAGE, "outer_no"])
    dense = F.dense_rank().over(Window.partitionBy(*layout.PAGE).orderBy("outer_no", "region_no")).cast("int")
    done = parts.withColumn("region_no", dense).drop("outer_no").withColumn("strategy", F.lit("receipts"))
    rest = found.where("not several").drop("several", "region_no")
    whole = rest.withColumn("region_no", F.lit(1)).withColumn("strategy", F.lit("page"))
    if adapters.decode is None:
        return done.unionByName(whole)
    import pandas as pd

    decode = adapters.decode

    def decoded(batches):
        for batch in batches:
            for file_id, page_no, content in batch[["file_id", "page_no", "content"]].itertuples(index=False):
                try:
                    page = (file_id, page_no, *decode(bytes(content)))
                except Exception:  # such a page is one region
                    continue
                # One page's pixels at a time.
                yield pd.DataFrame([page], columns=["file_id", "page_no", "height", "width", "pixels"])

    drawn = pages.join(rest.select(*layout.PAGE).distinct(), layout.PAGE, "left_semi").select("file_id", "page_no", "content")
    boxes = raster.segment_images(drawn.mapInPandas(decoded, "file_id string, page_no int, height int, width int, pixels binary"), settings.dpi)
    boxes = cut(boxes.withColumn("most", F.max("region_no").over(Window.partitionBy(*layout.PAGE))).where("most >= 2").drop("most").toDF("file_id", "page_no", "box_no", "bx0", "by0", "bx1", "by1"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (cx >= F.col("bx0")) & (cx < F.col("bx1")) & (cy >= F.col("by0")) & (cy < F.col("by1"))
    homes = rest.join(boxes, layout.PAGE).where(inside).groupBy(*layout.PAGE, "line_no").agg(F.min("box_no").alias("region_no"))
    by_ink = rest.join(homes, [*layout.PAGE, "line_no"]).withColumn("strategy", F.lit("raster"))
    one = whole.join(boxes.select(*layout.PAGE).distinct(), layout.PAGE, "left_anti")
    return done.unionByName(by_ink.select(*done.columns)).unionByName(one.select(*done.columns))


def process_folder(spark: SparkSession, folder: str, adapters: Adapters, settings: Settings = Settings(), notify: Callable[[int, int, str], None] | None = None) -> Batch:
    """All files under a folder as one batch: records linked, repaired and enriched, and an error record for each file that failed.

    One bad file, page or type stops nothing.  ``Batch.counts`` tells files, pages, lines
    and records once a sink has taken the records.  While pages are recognised, ``notify``
    is called in the driver with pages done, pages to read and a file's name.
    """
    observed: dict[str, Observation] = {}
    images = files.input_files(spark, folder, [k for k in files.EXTENSIONS if k != "pdf"]).select(F.col("path").alias("file_id"), F.lit(1).alias("page_no"), F.lit(None).cast(files.PAGE_WORDS).alias("layer"), "content", F.lit(None).cast("string").alias("error"))
    documents = _seen(files.input_files(spark, folder, ["pdf"]), "documents", observed)
    if adapters.reader is not None:
        read = files.document_pages(documents, adapters.reader, settings.prefer_text_layer)
    else:
        read = documents.select(F.col("path").alias("file_id"), F.lit(None).cast("int").alias("page_no"), F.lit(None).cast(files.PAGE_WORDS).alias("layer"), F.lit(None).cast("binary").alias("content"), F.lit("no reader for documents").alias("error"))
    # Drawn pages are written, because drawing is costly; images are read again where they are needed.
    pages = cut(_seen(read, "document_pages", observed))
    drawn = pages.where("error is null and layer is null")
    to_read = images.unionByName(drawn)
    noticed = _seen(images, "images", observed).unionByName(drawn)
    read_by = lambda counted: cut(_seen(files.recognised_lines(noticed, adapters.engine, factory=adapters.factory, counted=counted), "lines", observed))
    if notify is None:
        recognised = read_by(None)
    else:
        with Feed(spark, to_read.count(), notify) as feed:
            recognised = read_by(feed.pages)
    ocr = placed_lines(recognised.where("error is null").drop("error"), to_read, adapters, settings)
    text = rows.usable_lines(files.layer_lines(pages))
    text = layout.segment_text_lines(text).where("region_no is not null") if settings.segment else text.withColumn("region_no", F.lit(1))
    placed = ocr.unionByName(text.withColumn("strategy", F.lit("layer")).select(*ocr.columns))
    found = extraction.parsed(placed, settings).withColumn("source", F.when(F.col("strategy") == "layer", "text").otherwise("ocr"))
    found = _seen(found, "records", observed)
    failed = pages.where("error is not null").select("file_id", "error").unionByName(recognised.where("error is not null").select("file_id", "error"))
    errors = files.error_records(failed.unionByName(files.unsupported_files(spark, folder)))
    return Batch(extraction.finish(found, settings), errors, observed)


def crops(placed: DataFrame, pages: DataFrame, encode: Callable[[bytes, tuple[float, float, float, float]], bytes]) -> DataFrame:
    """(file_id, page_no, region_no, crop): the image of each region of ``placed`` lines; null where ``encode`` fails."""

    def cut_out(content: bytes, b: dict) -> list[tuple]:
        try:
            return [(encode(content, (b["x0"], b["y0"], b["x1"], b["y1"])),)]
        except Exception:  # a record without its image is still a record
            return [(None,)]

    return imaged(page_boxes(placed), pages).mapInArrow(*_for_each_box(cut_out, "crop binary"))


def force_split(enriched: DataFrame, record_id: str, region: DataFrame, parts: int, adapters: Adapters, settings: Settings = Settings()) -> DataFrame:
    """Reviewed records with one of them replaced by the records of so many bands of its region.

    ``region`` is one row: file_id, page_no, region_no, content (the page's image) and the
    region's box x0, y0, x1, y1.  Bands run along its longer side and overlap a little;
    each is recognised anew.  The batch is enriched again, but not linked again.  Bands in
    which nothing is found leave the record as it was.
    """
    import pandas as pd

    crop = adapters.crop

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                bands = review.bands(int(r.x1 - r.x0), int(r.y1 - r.y0), parts)
                for band, (x0, y0, x1, y1) in enumerate(bands):
                    try:
                        found = crop(bytes(r.content), (r.x0 + x0, r.y0 + y0, r.x0 + x1, r.y0 + y1), 0.0, 1.0)
                    except Exception:  # a band that can't be read has no lines
                        continue
                    out += [(r.file_id, r.page_no, r.region_no, band, n, x["text"], x["x0"], x["y0"], x["x1"], x["y1"], x.get("angle"), x.get("score")) for n, x in enumerate(found)]
            yield pd.DataFrame(out, columns=[*REGION, "part", "line_no", "text", "x0", "y0", "x1", "y1", "angle", "score"])

    schema = "file_id string, page_no int, region_no int, part int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, angle double, score double"
    keys = [*REGION, "part"]
    lines = cut(rows.usable_lines(region.mapInPandas(run, schema)))
    found = records.worth_keeping(cut(records.parse_rows(rows.cluster_rows(lines, keys).drop("members"), settings, keys)))
    name = F.concat_ws("#", F.lit(record_id), "part")
    children = found.withColumn("record_id", name).withColumn("source_file", name).withColumn("ord", F.struct("file_id", "page_no", "region_no", "part"))
    children = children.select(*[c for c in children.columns if c in enriched.columns])
    if children.isEmpty():
        return enriched
    added = ["amount_default", "date_default", "date_guessed", "date_guess_src", "status", "confirm_default"]
    return consensus.enrich_review(cut(review.replace_split(enriched.drop(*added), record_id, children)))
