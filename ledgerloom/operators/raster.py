"""Receipts on page images by their ink, as rows: bands, runs of ink, components and running sums.

1. A page is dealt in bands of BAND pixel rows, each with as many rows around it as a
   pixel's surroundings reach.  A task tells the ink of a band and joins its runs (a row's
   stretches of ink) to components within the band.
2. A run on a border stands in two bands.  It names a component of each, and these
   pairs are edges: connected components of all pages make strokes whole again.  Other
   components are judged in their band.
3. Long thin lines and large sparse scribbles are strokes; their runs go, and what is left
   is opened, band by band.  Equal runs of neighbouring rows become one block.
4. Cuts: how much ink each pixel column and row of a part has is a running sum over the
   ends of blocks; gaps are what lies between inked stretches.  All parts of all pages are
   cut at once, level by level.
5. A page's few boxes are joined by their own rules.

No call sees a whole image: a task holds a band.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .layout import column_major
from .lineage import cut

# Windows, sizes and shares at 200 dpi.
LIMITS = {
    "window": 31,
    "darker": 15,
    # strokes
    "large": 80,
    "sparse": 0.15,
    "thin": 12,
    "long": 100,
    # cuts
    "gap_share": 0.7,
    "noise": 3.0,
    "noise_share": 0.008,
    "least_part": 10,
    "deepest": 6,
    # boxes
    "least_width": 80,
    "least_height": 60,
    "least_ink": 800,
    "small_height": 250,
    "column_share": 0.6,
}
#: Pixel rows of a band.
BAND = 256
_HALO = LIMITS["window"] // 2 + 1
KEYS = ["file_id", "page_no"]
_COMPONENT = "struct<label:long,x0:int,y0:int,x1:int,y1:int,area:long>"


def ink_of(grey: np.ndarray) -> np.ndarray:
    """Pixels darker than the mean of the window around them; the outermost half window is only surroundings."""
    n = LIMITS["window"]
    # Running sums may run over: what a window holds, the difference of two of them, is right all the same.
    down = grey.cumsum(axis=0, dtype=np.uint16)
    tall = down[n - 1 :].copy()
    tall[1:] -= down[:-n]
    across = tall.cumsum(axis=1, dtype=np.uint32)
    around = across[:, n - 1 :].copy()
    around[:, 1:] -= across[:, :-n]
    around = around.view(np.int32)
    r = n // 2
    # grey <= round(around / n^2) - darker, in whole numbers; n is odd, so there is no half.
    return (grey[r:-r, r:-r].astype(np.int32) + LIMITS["darker"]) * (2 * n**2) <= 2 * around + n**2


def edges_of(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ink along rows: row, first, last + 1."""
    framed = np.zeros((ink.shape[0], ink.shape[1] + 2), dtype=bool)
    framed[:, 1:-1] = ink
    row, edge = np.divmod(np.flatnonzero(framed[:, 1:] != framed[:, :-1]), ink.shape[1] + 1)
    return row[::2], edge[::2], edge[1::2]


def runs_of(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ink along rows (row, first, last + 1) and the first run of the component that each is of; corners touch."""
    row, first, last = edges_of(ink)
    # Runs of neighbouring rows that touch: a run's partners are a range of the row above.
    begin = np.searchsorted(row, np.arange(ink.shape[0] + 1))
    width = ink.shape[1] + 2
    low = np.searchsorted(row * width + last, (row - 1) * width + first)
    high = np.searchsorted(row * width + first, (row - 1) * width + last, side="right")
    low, high = np.clip(low, begin[np.maximum(row - 1, 0)], begin[row]), np.clip(high, begin[np.maximum(row - 1, 0)], begin[row])
    count = np.where(row > 0, np.maximum(high - low, 0), 0)
    own = np.repeat(np.arange(len(row)), count)
    other = np.repeat(low, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    # Smallest label over edges, halving the way to it, until nothing changes.
    label = np.arange(len(row))
    while len(own):
        least = np.minimum(label[own], label[other])
        new = label.copy()
        np.minimum.at(new, label[own], least)
        np.minimum.at(new, label[other], least)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    return row, first, last, label


def is_stroke(w: object, h: object, area: object, least: object, greatest: object) -> object:
    """Whether a component of so many pixels across, down and in all is a large sparse scribble or a long thin line; numbers, arrays or columns."""
    sparse = (greatest > LIMITS["large"]) & (area < LIMITS["sparse"] * w * h)
    return sparse | ((least <= LIMITS["thin"]) & (greatest >= LIMITS["long"]))


def _band_rows(pages: DataFrame) -> DataFrame:
    """Bands of pages (height, width, pixels) with the rows around them."""
    stride = F.expr("cast(length(pixels) / height as int)")
    bands = pages.select(*KEYS, "height", "width", "pixels", stride.alias("stride"), F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / BAND).cast("int"))).alias("band"))
    top = F.greatest(F.col("band") * BAND - _HALO, F.lit(0))
    bottom = F.least((F.col("band") + 1) * BAND + _HALO, F.col("height"))
    return bands.withColumn("top", top).withColumn("rows", bottom - top).select(*KEYS, "band", "height", "width", "top", "rows", F.expr("substring(pixels, top * stride + 1, rows * stride)").alias("pixels"))


def _read_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands -> their runs (label, row, first, last; also of one row on each side) without strokes, and what may go on in another band.

    Only components that reach a border are named, with the runs that stand in two bands;
    whether any other is a stroke is known here.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            band, height, width, top, rows = (one.column(c)[0].as_py() for c in ("band", "height", "width", "top", "rows"))
            image = np.frombuffer(one.column("pixels")[0].as_buffer(), dtype=np.uint8).reshape(rows, width, -1)
            grey = image[..., 0] if image.shape[2] == 1 else np.floor(image[..., :3] @ np.array([0.299, 0.587, 0.114]) + 0.5)
            first_row, end = band * BAND, min(height, (band + 1) * BAND)
            # One row more on each side, where the page has it; beyond the page its edge goes on.
            begin, stop, r = max(0, first_row - 1), min(height, end + 1), LIMITS["window"] // 2
            padded = np.pad(grey, ((max(0, r - (begin - top)), max(0, stop + r - (top + rows))), (r, r)), mode="edge")
            skip = max(0, begin - r - top)
            ink = ink_of(padded[skip : skip + stop - begin + 2 * r])
            row, first, last, label = runs_of(ink)
            row = row + begin
            core = (row >= first_row) & (row < end)
            names, at = np.unique(label[core], return_inverse=True)
            low, high = np.full((len(names), 2), 1 << 30), np.zeros((len(names), 2), dtype=np.int64)
            for k, (a, b) in enumerate(((first, last), (row, row + 1))):
                np.minimum.at(low[:, k], at, a[core])
                np.maximum.at(high[:, k], at, b[core])
            area = np.bincount(at, weights=(last - first)[core], minlength=len(names)).astype(np.int64)
            border = ~core | ((row == first_row) & (begin < first_row)) | ((row == end - 1) & (stop > end))
            open_ = np.isin(names, label[border])
            size = high - low
            kept = ~np.isin(label, names[~open_ & is_stroke(*size.T, area, size.min(axis=1), size.max(axis=1))])
            place = band << 32
            components = [dict(zip(("label", "x0", "y0", "x1", "y1", "area"), x, strict=True)) for x in zip((names[open_] + place).tolist(), *low[open_].T.tolist(), *high[open_].T.tolist(), area[open_].tolist(), strict=True)]
            shared = [{"y": y, "x": x, "label": n} for y, x, n in zip(row[border].tolist(), first[border].tolist(), (label[border] + place).tolist(), strict=True)]
            runs = np.stack([label[kept], row[kept], first[kept], last[kept]]).astype("<i4").tobytes()
            kinds = [pa.list_(pa.struct([("label", pa.int64()), *[(c, pa.int32()) for c in ("x0", "y0", "x1", "y1")], ("area", pa.int64())])), pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32()), ("label", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [*(one.column(c) for c in (*KEYS, "band", "height", "width")), pa.array([runs], pa.binary()), pa.array([components], kinds[0]), pa.array([shared], kinds[1])],
                names=[*KEYS, "band", "height", "width", "runs", "components", "shared"],
            )


def blocks_of(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, first, last + 1) -> blocks (row, number of rows, first, last + 1): equal runs of consecutive rows are one."""
    order = np.lexsort((row, last, first))
    row, first, last = row[order], first[order], last[order]
    goes_on = (row[1:] == row[:-1] + 1) & (first[1:] == first[:-1]) & (last[1:] == last[:-1])
    begin = np.flatnonzero(np.concatenate([np.ones(min(len(row), 1), dtype=bool), ~goes_on]))
    return row[begin], np.diff(begin, append=len(row)), first[begin], last[begin]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands' runs without those of strokes, opened by squares of two pixels -> blocks (y, rows, x0, x1) of the bands' own rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            band, height, width, strokes = (one.column(c)[0].as_py() for c in ("band", "height", "width", "strokes"))
            name, row, first, last = np.frombuffer(one.column("runs")[0].as_buffer(), dtype="<i4").reshape(4, -1)
            top, end = band * BAND, min(height, (band + 1) * BAND)
            kept = ~np.isin(name, np.array(strokes or [], dtype=np.int64) - (band << 32))
            row, first, last = row[kept] - top + 1, first[kept] + 1, last[kept] + 1
            # A frame of one pixel, in which the neighbouring bands' rows stand; runs of a row never touch.
            step = np.zeros((end - top + 2, width + 3), dtype=np.int8)
            step[row, first], step[row, last] = 1, -1
            ink = step.cumsum(axis=1, dtype=np.int8)[:, :-1].astype(bool)
            square = ink[:-1, :-1] & ink[1:, :-1] & ink[:-1, 1:] & ink[1:, 1:]
            framed = np.pad(square, 1)
            open_ = (framed[:-1, :-1] | framed[1:, :-1] | framed[:-1, 1:] | framed[1:, 1:])[1:-1, 1:-1]
            y, rows, x0, x1 = blocks_of(*edges_of(open_))
            where = pa.array(np.zeros(len(y), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(one.column(c).take(where) for c in KEYS), *(pa.array(c.astype(np.int32)) for c in (y + top, rows, x0, x1))], names=[*KEYS, "y", "rows", "x0", "x1"])


def ink_blocks(pages: DataFrame) -> DataFrame:
    """(file_id, page_no, y, rows, x0, x1): the ink of pages without strokes and specks; equal runs of neighbouring rows of a band are one block."""
    ids = [f"{k} {pages.schema[k].dataType.simpleString()}" for k in KEYS]
    shapes = ", ".join([*ids, "band int", "height int", "width int", "runs binary", f"components array<{_COMPONENT}>", "shared array<struct<y:int,x:int,label:long>>"])
    # As many tasks as are asked for: white paper is small on the wire, not in a task.
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.sparkSession.sparkContext.defaultParallelism)
    bands = cut(_band_rows(pages).repartition(tasks, *KEYS, "band").mapInArrow(_read_bands, shapes))
    shared = bands.select(*KEYS, F.explode("shared").alias("s")).select(*KEYS, "s.*")
    meets = shared.groupBy(*KEYS, "y", "x").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
    node = lambda c: F.struct(*KEYS, F.col(c).alias("label"))
    whole = connected_components(meets.select(node("a").alias("a"), node("b").alias("b")))
    whole = whole.select(*[F.col(f"node.{k}").alias(k) for k in [*KEYS, "label"]], F.col("component.label").alias("whole"))
    parts = bands.select(*KEYS, "band", F.explode("components").alias("c")).select(*KEYS, "band", "c.*")
    named = parts.join(whole, [*KEYS, "label"], "left").withColumn("whole", F.coalesce("whole", "label"))
    sizes = named.groupBy(*KEYS, "whole").agg((F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"), F.sum("area").alias("area"))
    stroke = is_stroke(F.col("w"), F.col("h"), F.col("area"), F.least("w", "h"), F.greatest("w", "h"))
    strokes = named.join(sizes.where(stroke).select(*KEYS, "whole"), [*KEYS, "whole"]).groupBy(*KEYS, "band").agg(F.collect_list("label").alias("strokes"))
    left = bands.drop("components", "shared").join(strokes, [*KEYS, "band"], "left")
    return left.mapInArrow(_opened, ", ".join([*ids, "y int", "rows int", "x0 int", "x1 int"]))


def ink_runs(pages: DataFrame) -> DataFrame:
    """(file_id, page_no, y, x0, x1): the ink of pages as runs of single rows."""
    return ink_blocks(pages).select(*KEYS, F.explode(F.sequence("y", F.col("y") + F.col("rows") - 1)).alias("y"), "x0", "x1")


def _gaps(inked: DataFrame, part: list[str], least: int) -> DataFrame:
    """Inked stretches (part, begin, finish), some of them adjoining -> the gaps between them that are long enough."""
    before = F.max("finish").over(Window.partitionBy(*part).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    return inked.withColumn("from", before).where(F.col("begin") - F.col("from") >= least).select(*part, F.col("from").alias("gap_from"), F.col("begin").alias("gap_to"))


def _inked(live: DataFrame, part: list[str], begin: Column, end: Column, weight: Column, boxes: DataFrame, noise: Column) -> DataFrame:
    """Stretches (part, begin, finish) along an axis with more ink than noise: a running sum over the ends of blocks."""
    ends = live.select(*part, F.explode(F.array(F.struct(begin.alias("at"), weight.alias("step")), F.struct(end.alias("at"), (-weight).alias("step")))).alias("e")).groupBy(*part, F.col("e.at").alias("begin")).agg(F.sum("e.step").alias("step"))
    along = Window.partitionBy(*part).orderBy("begin")
    return ends.withColumn("n", F.sum("step").over(along)).withColumn("finish", F.lead("begin").over(along)).join(boxes, part).where(F.col("n") > noise)


def cut_parts(runs: DataFrame, least_x: int, least_y: int) -> DataFrame:
    """Boxes (file_id, page_no, x0, y0, x1, y1, ink) by cutting parts at all gaps of the axis with the widest one, level by level.

    Runs (y, x0, x1) may be blocks of as many ``rows``.
    """
    part = [*KEYS, "part"]
    y1 = F.col("y") + (F.col("rows") if "rows" in runs.columns else 1)
    live, done = cut(runs.select(*KEYS, "y", y1.alias("y1"), "x0", "x1", F.lit("0").alias("part"))), []
    for depth in range(LIMITS["deepest"] + 1):
        length, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y")
        boxes = live.groupBy(*part).agg(*[F.min(c).alias(f"b{c}") for c in ("x0", "y")], *[F.max(c).alias(f"b{c}") for c in ("x1", "y1")], F.sum(length.cast("long") * height).alias("ink"))
        boxes = cut(boxes)
        noise = lambda a, b: F.greatest(F.lit(LIMITS["noise"]), LIMITS["noise_share"] * (F.col(b) - F.col(a)))
        columns = _inked(live, part, F.col("x0"), F.col("x1"), height, boxes, noise("by", "by1"))
        rows = _inked(live, part, F.col("y"), F.col("y1"), length, boxes, noise("bx0", "bx1"))
        widths = lambda df, least, axis: _gaps(df.select(*part, "begin", "finish"), part, least).withColumn("axis", F.lit(axis))
        gaps = cut(widths(columns, least_x, "x").unionByName(widths(rows, least_y, "y")))
        widest = gaps.groupBy(*part).agg(F.max(F.struct((F.col("gap_to") - F.col("gap_from")).alias("wide"), (F.col("axis") == "x").alias("x"))).alias("best")).select(*part, F.when(F.col("best.x"), "x").otherwise("y").alias("axis"))
        cuts = gaps.join(widest, [*part, "axis"]).groupBy(*part, "axis").agg(F.array_sort(F.collect_list(F.struct("gap_from", "gap_to"))).alias("gaps"))  # a few for a part
        if depth == LIMITS["deepest"] or gaps.isEmpty():
            done.append(boxes)
            break
        done.append(boxes.join(cuts, part, "left_anti"))
        # Pieces between the gaps; what stands in a gap, or in a sliver, is noise.
        x = F.col("axis") == "x"
        low, high = F.when(x, F.col("bx0")).otherwise(F.col("by")), F.when(x, F.col("bx1")).otherwise(F.col("by1"))
        begins, ends = F.concat(F.array(low), F.transform("gaps", lambda g: g["gap_to"])), F.concat(F.transform("gaps", lambda g: g["gap_from"]), F.array(high))
        pieces = F.filter(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda p: p["b"] - p["a"] >= LIMITS["least_part"])
        pieces = cuts.join(boxes, part).withColumn("pieces", pieces).select(*part, "axis", "pieces")
        split = live.join(pieces, part).select(*part, "axis", "y", "y1", "x0", "x1", F.posexplode("pieces").alias("k", "p"))
        begin, end = F.when(x, F.col("x0")).otherwise(F.col("y")), F.when(x, F.col("x1")).otherwise(F.col("y1"))
        inside = split.where((begin < F.col("p.b")) & (end > F.col("p.a")))
        clipped = lambda c, bound, along: F.when(along, bound(F.col(c), F.col("p.a" if bound is F.greatest else "p.b"))).otherwise(F.col(c)).alias(c)
        live = cut(inside.select(*KEYS, clipped("y", F.greatest, ~x), clipped("y1", F.least, ~x), clipped("x0", F.greatest, x), clipped("x1", F.least, x), F.concat_ws(".", "part", "k").alias("part")))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select(*KEYS, F.col("bx0").alias("x0"), F.col("by").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"), "ink")


def _hull(a: tuple, b: tuple) -> tuple:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def joined_columns(boxes: list[tuple], gap: float) -> list[tuple]:
    """Boxes one above the other, no further apart than ``gap``, as one: of all such pairs the one furthest left and up goes first."""
    live, queue = set(boxes), []

    def offer(a: tuple, b: tuple) -> None:
        a, b = min(a, b), max(a, b)
        if min(a[2], b[2]) - max(a[0], b[0]) >= LIMITS["column_share"] * min(a[2] - a[0], b[2] - b[0]) and max(a[1], b[1]) - min(a[3], b[3]) <= gap:
            heapq.heappush(queue, (a, b))

    for i, a in enumerate(boxes):
        for b in boxes[:i]:
            offer(a, b)
    while queue:
        a, b = heapq.heappop(queue)
        if a in live and b in live:
            live -= {a, b}
            both = _hull(a, b)
            for c in live - {both}:
                offer(both, c)
            live.add(both)
    return sorted(live)


def joined_scraps(boxes: list[tuple], gap: float) -> list[tuple]:
    """Boxes too low for a receipt as part of the nearest one that isn't, within ``gap``; the first one that has such goes first."""
    box = np.array(boxes, dtype=np.int64).reshape(-1, 4)
    while True:
        small = box[:, 3] - box[:, 1] < LIMITS["small_height"]
        s, h = np.flatnonzero(small), np.flatnonzero(~small)
        far = sum(np.maximum(0, np.maximum(box[s, None, k], box[None, h, k]) - np.minimum(box[s, None, k + 2], box[None, h, k + 2])) for k in (0, 1))
        if not far.size or not (far.min(axis=1) <= gap).any():
            return [tuple(b) for b in box.tolist()]
        i = int(np.argmax(far.min(axis=1) <= gap))
        host = h[far[i].argmin()]
        box[host] = _hull(tuple(box[host]), tuple(box[s[i]]))
        box = np.delete(box, s[i], axis=0)


def segment_images(pages: DataFrame, dpi: int = 200, dilate: int = 25, merge_gap: int = 70) -> DataFrame:
    """(file_id, page_no, region_no, x0, y0, x1, y1): receipts of pages with height, width and pixels (grey or RGB bytes), in reading order.

    Pages without pixels or of no height have none; pages are told apart by file_id and page_no.
    """
    scale = dpi / 200
    gap = int(merge_gap * scale)
    # Images move once, as bands.
    ink = ink_blocks(pages.where(F.col("pixels").isNotNull() & (F.col("height") > 0) & (F.col("width") > 0)))
    boxes = cut_parts(ink, int(max(8, int(dilate * scale)) * LIMITS["gap_share"]), gap)
    wide = (F.col("x1") - F.col("x0") > LIMITS["least_width"]) & (F.col("y1") - F.col("y0") > LIMITS["least_height"]) & (F.col("ink") > LIMITS["least_ink"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [joined_scraps(joined_columns([tuple(b.values()) for b in own], gap), 2 * gap) for own in batch.column("boxes").to_pylist()]
            where = pa.array(np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found]))
            values = np.array([b for f in found for b in f], dtype=np.int32).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in KEYS), *(pa.array(values[:, k]) for k in range(4))], names=[*KEYS, "x0", "y0", "x1", "y1"])

    kinds = ", ".join([f"{k} {pages.schema[k].dataType.simpleString()}" for k in KEYS] + [f"{c} int" for c in ("x0", "y0", "x1", "y1")])
    # A page's boxes are few.
    settled = boxes.where(wide).groupBy(*KEYS).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes")).mapInArrow(joined, kinds)
    return column_major(settled, KEYS).select(*KEYS, F.col("place").alias("region_no"), "x0", "y0", "x1", "y1")
