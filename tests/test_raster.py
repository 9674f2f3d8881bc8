"""Ink of page images as rows, against the same rules on whole images in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import raster
from ledgerloom.operators.raster import LIMITS

PAGE = "file_id string, page_no int, height int, width int, pixels binary"


def drawn(rng, height=700, width=900):
    """Receipts of small blocks, with strokes across bands, specks and scribbles."""
    image = np.full((height, width), 255, dtype=np.uint8)
    for left in range(30, width - 250, rng.choice([330, 420])):
        top = rng.randrange(10, 60)
        for y in range(top, rng.randrange(300, height - 20), 24):
            if rng.random() < 0.12:
                continue
            for x in range(left, left + rng.choice([180, 220]), 14):
                image[y : y + 12, x : x + 8] = rng.choice([0, 60])
    for _ in range(40):
        y, x = rng.randrange(height - 3), rng.randrange(width - 3)
        image[y : y + rng.choice([1, 2]), x : x + rng.choice([1, 3])] = 0
    x = rng.randrange(100, width - 100)
    image[:, x : x + 3] = 0  # a fold over all bands
    for i in range(240):  # a slanting scribble over a border of bands
        image[150 + i, 40 + i : 44 + i] = 0
    return image


def opened_by_hand(grey):
    n, r = LIMITS["window"], LIMITS["window"] // 2
    padded = np.pad(grey.astype(np.int64), r, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (n, n))
    ink = grey <= np.floor(windows.sum(axis=(2, 3)) / n**2 + 0.5) - LIMITS["darker"]
    seen = np.zeros(ink.shape, dtype=bool)
    for y, x in zip(*np.nonzero(ink)):
        if seen[y, x]:
            continue
        todo, own = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            own.append((a, b))
            for c in range(max(0, a - 1), min(ink.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(ink.shape[1], b + 2)):
                    if ink[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        ys, xs = [p[0] for p in own], [p[1] for p in own]
        w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        if max(w, h) > LIMITS["large"] and len(own) < LIMITS["sparse"] * w * h or min(w, h) <= LIMITS["thin"] and max(w, h) >= LIMITS["long"]:
            for p in own:
                ink[p] = False
    out = np.zeros(ink.shape, dtype=bool)
    for y in range(ink.shape[0] - 1):
        for x in np.flatnonzero(ink[y, :-1] & ink[y, 1:] & ink[y + 1, :-1] & ink[y + 1, 1:]):
            out[y : y + 2, x : x + 2] = True
    return out


def boxes_by_hand(ink, least_x, least_y):
    """Recursion over whole parts, their profiles looked at pixel by pixel."""

    def gaps(profile, noise, least):
        inked = [i for i, v in enumerate(profile) if v > noise]
        return [(a + 1, b) for a, b in zip(inked, inked[1:]) if b - a - 1 >= least]

    def part(x0, y0, x1, y1, depth):
        ys, xs = np.nonzero(ink[y0:y1, x0:x1])
        if not len(ys):
            return []
        x0, x1, y0, y1 = x0 + xs.min(), x0 + xs.max() + 1, y0 + ys.min(), y0 + ys.max() + 1
        own = ink[y0:y1, x0:x1]
        noise = lambda n: max(LIMITS["noise"], LIMITS["noise_share"] * n)
        along = {"x": gaps(own.sum(axis=0), noise(y1 - y0), least_x), "y": gaps(own.sum(axis=1), noise(x1 - x0), least_y)}
        widest = {k: max((b - a for a, b in g), default=0) for k, g in along.items()}
        if depth == LIMITS["deepest"] or not any(widest.values()):
            return [(int(x0), int(y0), int(x1), int(y1), int(own.sum()))]
        axis = "x" if widest["x"] >= widest["y"] else "y"
        size = x1 - x0 if axis == "x" else y1 - y0
        edges = [0, *(e for g in along[axis] for e in g), size]
        out = []
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= LIMITS["least_part"]:
                out += part(x0 + a, y0, x0 + b, y1, depth + 1) if axis == "x" else part(x0, y0 + a, x1, y0 + b, depth + 1)
        return out

    return sorted(part(0, 0, ink.shape[1], ink.shape[0], 0))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(7)
    images = {f"f{k}": drawn(rng, 700 - 60 * k, 900 - 100 * k) for k in range(3)} | {"blank": np.full((300, 200), 255, dtype=np.uint8), "one row": np.zeros((1, 5), dtype=np.uint8)}
    rows = [(k, 1, *v.shape, bytearray(v.tobytes())) for k, v in images.items()]
    return images, spark.createDataFrame(rows + [("none", 1, 5, 5, None), ("flat", 1, 0, 0, bytearray())], PAGE)


def test_ink_and_cuts(spark, pages):
    images, df = pages
    runs = raster.ink_runs(df.where("pixels is not null and height > 0")).cache()
    got = {k: np.zeros(v.shape, dtype=bool) for k, v in images.items()}
    for r in runs.collect():
        assert not got[r.file_id][r.y, r.x0 : r.x1].any()
        got[r.file_id][r.y, r.x0 : r.x1] = True
    expected = {k: opened_by_hand(v) for k, v in images.items()}
    assert all((got[k] == expected[k]).all() for k in images)
    assert any(expected[k].any() for k in images)
    found = {k: [] for k in images}
    for r in raster.cut_parts(runs, 17, 70).collect():
        found[r.file_id].append((r.x0, r.y0, r.x1, r.y1, r.ink))
    assert {k: sorted(v) for k, v in found.items()} == {k: boxes_by_hand(v, 17, 70) for k, v in expected.items()}


def test_receipts_on_pages(spark):
    image = np.full((900, 1200, 3), 255, dtype=np.uint8)
    for left in (50, 650):
        for y in range(50, 750, 24):
            for x in range(left, left + 400, 14):
                image[y : y + 12, x : x + 8] = 0
    image[:, 598:601] = 0  # a fold between the receipts
    df = spark.createDataFrame([("f", 1, 900, 1200, bytearray(image.tobytes())), ("f", 2, 900, 1200, bytearray(image[:, ::-1].tobytes()))], PAGE)
    got = sorted((r.page_no, r.region_no, r.x0, r.y0, r.x1, r.y1) for r in raster.segment_images(df).collect())
    assert got == [(1, 1, 50, 50, 450, 758), (1, 2, 650, 50, 1050, 758), (2, 1, 150, 50, 550, 758), (2, 2, 750, 50, 1150, 758)]
    assert raster.segment_images(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_boxes_are_joined_in_order(seed):
    """Against a search for the first pair, and the first scrap, before every step."""
    rng = random.Random(seed)
    for _ in range(200):
        boxes = {(x := rng.randrange(0, 900, 10), y := rng.randrange(0, 900, 10), x + rng.randrange(90, 400, 10), y + rng.choice([70, 120, 260, 400])) for _ in range(rng.randint(0, 9))}
        boxes = sorted(boxes)
        left = list(boxes)
        while True:
            left.sort()
            pairs = [(a, b) for i, a in enumerate(left) for b in left[i + 1 :] if min(a[2], b[2]) - max(a[0], b[0]) >= 0.6 * min(a[2] - a[0], b[2] - b[0]) and max(a[1], b[1]) - min(a[3], b[3]) <= 70]
            if not pairs:
                break
            a, b = pairs[0]
            left = [c for c in left if c not in (a, b)] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))]
        assert raster.joined_columns(boxes, 70) == sorted(set(left))
        rest = list(boxes)
        gap = lambda a, b: max(0, max(a[0], b[0]) - min(a[2], b[2])) + max(0, max(a[1], b[1]) - min(a[3], b[3]))
        again = True
        while again:
            again = False
            for s in rest:
                hosts = [b for b in rest if b[3] - b[1] >= 250]
                if s[3] - s[1] < 250 and hosts and min(gap(s, b) for b in hosts) <= 140:
                    h = min(hosts, key=lambda b: gap(s, b))
                    k = rest.index(h)
                    rest[k] = (min(s[0], h[0]), min(s[1], h[1]), max(s[2], h[2]), max(s[3], h[3]))
                    rest.pop(rest.index(s))
                    again = True
                    break
        assert raster.joined_scraps(boxes, 140) == rest


def test_ink_is_kept_in_blocks(spark, pages):
    """Equal runs of neighbouring rows are one row, and cuts of blocks are those of their runs."""
    _, df = pages
    df = df.where("pixels is not null and height > 0")
    blocks, runs = raster.ink_blocks(df).cache(), raster.ink_runs(df)
    assert 0 < 2 * blocks.count() < runs.count() == blocks.agg(F.sum("rows")).first()[0]
    boxes = lambda ink: sorted(map(tuple, raster.cut_parts(ink, 17, 70).collect()))
    assert boxes(blocks) == boxes(runs)


def test_components_within_a_band_are_judged_there(spark, pages):
    """Only what reaches a band's border is named outside it; a long line within a band goes all the same."""
    image = np.full((600, 400), 255, dtype=np.uint8)
    image[100:104, 20:380] = 0
    for y in range(200, 400, 24):
        image[y : y + 12, 50:58] = 0
    df = spark.createDataFrame([("f", 1, 600, 400, bytearray(image.tobytes()))], PAGE)
    kinds = "file_id string, page_no int, band int, height int, width int, runs binary, components array<struct<label:long,x0:int,y0:int,x1:int,y1:int,area:long>>, shared array<struct<y:int,x:int,label:long>>"
    named = raster._band_rows(df).mapInArrow(raster._read_bands, kinds).select(F.explode("components").alias("c")).select("c.*").collect()
    assert sorted((c.y0, c.y1, c.x0) for c in named) == [(248, 256, 50), (256, 260, 50)]
    assert {(r.y, r.rows, r.x0, r.x1) for r in raster.ink_blocks(df).collect()} >= {(200, 12, 50, 58)}
    assert raster.ink_blocks(df).where("y < 200").count() == 0


def test_pages_are_drawn_where_they_were_dealt(spark, tmp_path):
    """A filter on pixels is not moved to the one task that reads the keys."""
    from ledgerloom.plans.synthetic import drawn_pages

    spark.range(40).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    shown = drawn_pages(spark, str(tmp_path)).where("pixels is not null")
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and shown.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
