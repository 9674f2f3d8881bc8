"""Sources of documents: files, images and lines made by adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LEAST_OCR_SCORE
from ..functions.text import repair
from ..schema import LINE

# File types that are read.
EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "pdf"]
#: Characters of a text layer from which on a page needs no OCR.
LEAST_LAYER = 10


def is_supported(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")


def input_files(spark: SparkSession, folder: str, kinds: list[str] = EXTENSIONS) -> DataFrame:
    """Files of such types under a folder: path, modificationTime, length, content.

    Types are told by the listing, in whatever case, so contents of others are never
    read.  In no order: contents aren't sorted.  Records carry their file's path, and a
    sink orders those.
    """
    either = ["".join(f"[{c}{c.upper()}]" for c in kind) for kind in kinds]
    return _every_file(spark, folder, "*.{" + ",".join(either) + "}")


def unsupported_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, error) of files of other types; their contents aren't read."""
    return _every_file(spark, folder).where(~is_supported(F.col("path"))).select(F.col("path").alias("file_id"), F.lit("unsupported file type").alias("error"))


def _every_file(spark: SparkSession, folder: str, named: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", named).load(folder)


def uploads(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    """Files given as bytes, in the shape of ``input_files``."""
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in sorted(files.items())], "path string, length long, content binary")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images: path, height, width, channels, pixels (RGB order), error for undecodable ones."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select("image.*")

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        import numpy as np

        def turn(d: bytes, n: int) -> bytes:
            return np.frombuffer(d, dtype=np.uint8).reshape(-1, n)[:, ::-1].tobytes() if n == 3 else d

        return pd.Series([turn(d, n) for d, n in zip(data, channels, strict=True)])

    bad = F.col("height") < 0
    return raw.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), F.when(~bad, rgb("data", "nChannels")).alias("pixels"), F.when(bad, "undecodable image").alias("error"))


def needs_ocr(layer: Column, prefer_text_layer: bool = True) -> Column:
    """Whether a page's text layer (array of texts, null if it could not be read) is too thin."""
    size = F.aggregate(layer, F.lit(0), lambda n, t: n + F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    return F.lit(True) if not prefer_text_layer else layer.isNull() | (size < LEAST_LAYER)


def quad_angle(quad: Column) -> Column:
    """Direction in degrees of the longer edge of a quadrilateral, in (-45, 45]."""
    x = lambda i: quad[i]["x"]
    y = lambda i: quad[i]["y"]
    first = (x(1) - x(0)) * (x(1) - x(0)) + (y(1) - y(0)) * (y(1) - y(0)) >= (x(2) - x(1)) * (x(2) - x(1)) + (y(2) - y(1)) * (y(2) - y(1))
    dx, dy = F.when(first, x(1) - x(0)).otherwise(x(2) - x(1)), F.when(first, y(1) - y(0)).otherwise(y(2) - y(1))
    turned = F.pmod(F.degrees(F.atan2(dy, dx)) + 45.0, F.lit(90.0)) - 45.0
    return F.when(turned == -45.0, 45.0).otherwise(turned)


_engines: dict[str, object] = {}


def one_per_worker(factory: Callable[[], object]) -> object:
    """What ``factory`` (a module's function) makes, once in each worker: engines are slow to load."""
    name = f"{factory.__module__}.{factory.__qualname__}"
    if name not in _engines:
        _engines[name] = factory()
    return _engines[name]


def recognised_lines(pages: DataFrame, engine: Callable[[bytes], list[dict]] | None = None, least_score: float = LEAST_OCR_SCORE, factory: Callable[[], Callable[[bytes], list[dict]]] | None = None, counted: Accumulator | None = None) -> DataFrame:
    """Lines of pages (file_id, page_no, content) by a pluggable engine, and error rows.

    ``engine`` is called in the workers, once for each page; ``factory`` makes one there,
    once for each worker.  What it returns are dicts of text, x0, y0, x1, y1 and, if
    known, angle and score.  A page on which it fails becomes one row with ``error`` and
    nothing else.  Scores are filtered and texts repaired by Catalyst.  ``counted`` is
    told (1, file_id) of each page (see ``plans.progress``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LINE.split(", ")] + ["error"]
        recognise = engine or one_per_worker(factory)
        for batch in batches:
            out = []
            for file_id, page_no, content in batch[["file_id", "page_no", "content"]].itertuples(index=False):
                try:
                    for n, line in enumerate(recognise(bytes(content) if content is not None else b"")):
                        out.append((file_id, page_no, n, line["text"], line["x0"], line["y0"], line["x1"], line["y1"], line.get("angle"), line.get("score"), None))
                except Exception as e:  # one bad file doesn't stop the others
                    out.append((file_id, page_no, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if counted is not None:
                    counted.add((1, file_id))
            yield pd.DataFrame(out, columns=names)

    found = pages.select("file_id", "page_no", "content").mapInPandas(run, LINE + ", error string")
    good = F.col("error").isNotNull() | (F.coalesce("score", F.lit(1.0)) >= least_score)
    return found.where(good).withColumn("text", repair(F.col("text")))


#: A page of a document with a text layer: what was read of it, or the page drawn.
PAGE_WORDS = "array<struct<text:string,x0:double,top:double,x1:double,bottom:double>>"
DRAWN_PAGE = f"file_id string, page_no int, layer {PAGE_WORDS}, content binary, error string"


def document_pages(files: DataFrame, reader: Callable[[bytes], Iterable[dict]], prefer_text_layer: bool = True) -> DataFrame:
    """(file_id, page_no, layer, content, error) of documents (path, content) by a pluggable reader.

    ``reader`` gives for each page a dict of ``layer``, a function that gives its words
    (text, x0, top, x1, bottom), and ``draw``, one that gives its image as bytes.  A page
    whose layer says enough isn't drawn.  If one page's layer can't be read, the whole
    document is drawn.  A document or page that fails becomes a row with ``error``.
    """

    def layer_of(page: dict) -> list[dict]:
        return [dict(w) for w in page["layer"]()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_id", "page_no", "layer", "content", "error"]
        for batch in batches:
            for path, content in batch[["path", "content"]].itertuples(index=False):
                try:
                    pages = list(reader(bytes(content)))
                except Exception as e:
                    yield pd.DataFrame([(path, None, None, None, f"{type(e).__name__}: {e}")], columns=names)
                    continue
                try:
                    layers = [layer_of(p) for p in pages] if prefer_text_layer else [None] * len(pages)
                except Exception:  # an unreadable layer says nothing about the page itself
                    layers = [None] * len(pages)
                for n, (page, layer) in enumerate(zip(pages, layers, strict=True), 1):
                    enough = layer is not None and sum(len(w["text"].strip()) for w in layer) >= LEAST_LAYER
                    try:
                        row = (path, n, layer if enough else None, None if enough else page["draw"](), None)
                    except Exception as e:
                        row = (path, n, None, None, f"{type(e).__name__}: {e}")
                    # One drawn page at a time.
                    yield pd.DataFrame([row], columns=names)

    return files.select("path", "content").mapInPandas(run, DRAWN_PAGE)


def layer_lines(pages: DataFrame) -> DataFrame:
    """Lines (schema LINE) of the text layers of pages: words of one height are one line."""
    from ..operators.rows import cluster_rows

    words = pages.where(F.col("layer").isNotNull()).select("file_id", "page_no", F.posexplode("layer").alias("line_no", "w"))
    boxes = words.select("file_id", "page_no", "line_no", F.col("w.text").alias("text"), F.col("w.x0").alias("x0"), F.col("w.top").alias("y0"), F.col("w.x1").alias("x1"), F.col("w.bottom").alias("y1"))
    rows = cluster_rows(boxes, ["file_id", "page_no"]).drop("members")
    return rows.select("file_id", "page_no", F.col("row_no").cast("int").alias("line_no"), repair(F.col("text")).alias("text"), "x0", "y0", "x1", "y1", F.lit(None).cast("double").alias("angle"), F.lit(None).cast("double").alias("score"))


def error_records(lines: DataFrame) -> DataFrame:
    """One low record for each file that could not be read."""
    return lines.where("error is not null").groupBy("file_id").agg(F.min("error").alias("error")).select("file_id", F.col("file_id").alias("source_file"), F.lit("low").alias("confidence"), F.array("error").alias("notes"), "error")


def silent_files(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files from which no record came."""
    return files.select(F.col("path").alias("file_id")).join(records.select("file_id").distinct(), "file_id", "left_anti")
