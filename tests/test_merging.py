"""Merging of groups on random pages against a loop that looks at every pair before each step."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.layout import LIMITS, cluster_receipts
from ledgerloom.operators.merging import Page, chains, merge_groups
from ledgerloom.schema import LINE

FLAGS = ["is_money", "has_date", "has_total", "is_head"]


def random_page(rng, coarse):
    """Lines in groups; on a coarse raster, so that many gaps and costs are equal."""
    step, lines = (60 if coarse else 1), []
    for g in range(rng.randint(1, 14)):
        x, y = rng.randrange(0, 1500, step), rng.randrange(0, 1200, step)
        w = rng.choice([60, 120, 180, 300, 420, 600]) if coarse else rng.randint(20, 650)
        for k in range(rng.choice([1, 1, 2, 3, 6, 12])):
            shift = 0 if coarse else rng.randint(-9, 9)
            lines.append([g, x + shift, y + 36 * k, x + w + shift, y + 36 * k + 24, rng.choice([1, 3, 9, 20])] + [rng.random() < p for p in (0.25, 0.1, 0.1, 0.08)])
    rng.shuffle(lines)
    # A group is named by its first line.
    first = {}
    for i, line in enumerate(lines):
        line[0] = first.setdefault(line[0], i)
    scale = rng.choice([1.0, 1.0, 1.0, 1.5])
    names = ["group", "x0", "y0", "x1", "y1", "n_chars", *FLAGS]
    return {**{c: [line[j] for line in lines] for j, c in enumerate(names)}, "scale": [scale] * len(lines), "height": [24.0] * len(lines)}


def by_hand(page):
    """Before every step all pairs of all groups anew, from their lines."""
    s, h, n = page["scale"][0], page["height"][0], len(page["group"])
    groups = {}
    for i in range(n):
        groups.setdefault(page["group"][i], []).append(i)
    groups = list(groups.values())
    get = lambda c, g: [page[c][i] for i in g]
    hull = lambda g: (min(get("x0", g)), min(get("y0", g)), max(get("x1", g)), max(get("y1", g)))
    centre = lambda i: ((page["x0"][i] + page["x1"][i]) / 2, (page["y0"][i] + page["y1"][i]) / 2)
    has = lambda c, g: any(get(c, g))
    lim = lambda name: LIMITS[name] * s
    narrow = lambda a, b, k: min(a[k + 2] - a[k], b[k + 2] - b[k])
    common = lambda a, b, k: min(a[k + 2], b[k + 2]) - max(a[k], b[k])
    union = lambda a, b: max(a[2], b[2]) - min(a[0], b[0])

    def side(p, q):
        a, b = hull(groups[p]), hull(groups[q])
        gap, width = -common(a, b, 0), union(a, b)
        if common(a, b, 1) < LIMITS["column_overlap"] * narrow(a, b, 1) or gap > lim("column_gap") or width > lim("widest"):
            return None
        fits = lambda w, money: money and lim("whole_width") <= w <= lim("widest")
        one, two = fits(a[2] - a[0], has("is_money", groups[p])), fits(b[2] - b[0], has("is_money", groups[q]))
        gain = int(fits(width, has("is_money", groups[p] + groups[q]))) - int(one) - int(two)
        bits = not one and not two and gap <= lim("fragment_gap") and width <= lim("fragment_width")
        if gain <= 0 and not bits and not (gap <= 0 and gain == 0):
            return None
        if gap > 0:
            if len(groups[p]) == 1 or len(groups[q]) == 1 or has("has_date", groups[p]) and has("has_date", groups[q]):
                return None
            box = (min(a[2], b[2]), max(a[1], b[1]), max(a[0], b[0]), min(a[3], b[3]))
            for k, g in enumerate(groups):
                if k not in (p, q) and any(box[0] < centre(i)[0] < box[2] and box[1] < centre(i)[1] < box[3] for i in g):
                    return None
            pairs = sum(any(abs(centre(i)[1] - centre(j)[1]) <= LIMITS["pair_level"] * h for j in groups[q]) for i in groups[p])
            if gap > lim("pair_gap") and pairs < 2:
                return None
        return -gain, gap, -p, -q

    def above(p, q):
        a, b = hull(groups[p]), hull(groups[q])
        if common(a, b, 0) < LIMITS["stack_overlap"] * narrow(a, b, 0) or union(a, b) > lim("widest"):
            return None
        up, low = (p, q) if a[1] <= b[1] else (q, p)
        top, foot = hull(groups[up]), hull(groups[low])
        gap = foot[1] - top[3]
        if gap > lim("stack_gap"):
            return None
        if not -gap > LIMITS["deep_overlap"] * narrow(a, b, 1) and has("has_total", groups[up]):
            until = foot[1] + LIMITS["head_share"] * (foot[3] - foot[1])
            early = any(page["has_date"][i] and page["y0"][i] <= until for i in groups[low])
            heads = sorted(groups[low], key=lambda i: page["y0"][i])[: LIMITS["head_lines"]]
            if early or has("is_head", heads):
                return None
        return max(gap, -1.0), p, q

    def loop(cost):
        while True:
            found = [(c, p, q) for p in range(len(groups)) for q in range(p + 1, len(groups)) if (c := cost(p, q)) is not None]
            if not found:
                return
            _, p, q = min(found)
            groups[p] = groups[p] + groups.pop(q)

    def scraps():
        tiny = lambda g: len(g) <= LIMITS["scrap_lines"] or sum(get("n_chars", g)) <= LIMITS["scrap_chars"]
        again = True
        while again and len(groups) > 1:
            again = False
            for k, g in enumerate(groups):
                if not tiny(g):
                    continue
                own = hull(g)
                fits = [j for j, x in enumerate(groups) if j != k and not tiny(x) and union(own, hull(x)) <= lim("widest")]
                safe = [j for j in fits if union(own, hull(groups[j])) - (hull(groups[j])[2] - hull(groups[j])[0]) <= lim("widen")]
                if not safe and not has("is_money", g) and not has("has_date", g):
                    groups.pop(k)
                    again = True
                    break
                safe = safe or fits
                if not safe:
                    continue
                middle = (own[0] + own[2]) / 2
                over = [j for j in safe if hull(groups[j])[0] - lim("expand") <= middle <= hull(groups[j])[2] + lim("expand")]
                j = min(over or safe, key=lambda j: max(0.0, -common(own, hull(groups[j]), 0)) + max(0.0, -common(own, hull(groups[j]), 1)))
                groups[j] = groups[j] + g
                groups.pop(k)
                again = True
                break

    loop(side)
    loop(above)
    scraps()
    loop(above)
    out = [None] * n
    for g in groups:
        for i in g:
            out[i] = min(g)
    return out


def named(found):
    """Groups by their smallest line."""
    first = {}
    for i, g in enumerate(found):
        if g is not None:
            first.setdefault(g, i)
    return [None if g is None else first[g] for g in found]


@pytest.mark.parametrize("coarse", [True, False])
def test_random_pages(coarse):
    rng, moved, dropped = random.Random(12), 0, 0
    for _ in range(600):
        page = random_page(rng, coarse)
        expected = by_hand(page)
        assert named(Page(page, LIMITS).settle()) == expected
        moved += len(set(expected) - {None}) < len(set(page["group"]))
        dropped += None in expected
    assert moved > 300 and dropped > 30


def test_the_cheapest_pair_is_first():
    """Amounts, two narrow strips and one beyond: a whole receipt comes before a pair of strips, and what is left stays alone."""
    xs = [(433, 517), (540, 677), (932, 972), (1025, 1129)]
    lines = [(k, x0, 40 * i, x1, 40 * i + 24) for k, (x0, x1) in enumerate(xs) for i in range(5)]
    page = {c: [line[j] for line in lines] for j, c in enumerate(["group", "x0", "y0", "x1", "y1"])}
    page |= {c: [c == "is_money" and line[0] == 0 for line in lines] for c in FLAGS} | {"n_chars": [9] * 20, "scale": [1.0] * 20, "height": [24.0] * 20}
    got = named(Page(page, LIMITS).settle())
    assert got == by_hand(page) == [0] * 15 + [15] * 5


def test_a_page_of_scraps_keeps_one():
    lines = [(k, 900 * (k % 3), 500 * k, 900 * (k % 3) + 30, 500 * k + 24) for k in range(10)]
    page = {c: [line[j] for line in lines] for j, c in enumerate(["group", "x0", "y0", "x1", "y1"])}
    page |= {c: [False] * 10 for c in FLAGS} | {"n_chars": [2] * 10, "scale": [1.0] * 10, "height": [24.0] * 10}
    assert named(Page(page, LIMITS).settle()) == [None] * 9 + [9] == by_hand(page)


def test_a_page_of_ten_thousand_lines():
    import time

    rng = random.Random(3)
    lines = [(k, x := rng.randrange(60_000), y := rng.randrange(60_000), x + rng.randint(20, 200), y + 24) for k in range(10_000)]
    page = {c: [line[j] for line in lines] for j, c in enumerate(["group", "x0", "y0", "x1", "y1"])}
    page |= {c: [rng.random() < 0.3 for _ in lines] for c in FLAGS} | {"n_chars": [9] * len(lines), "scale": [1.0] * len(lines), "height": [24.0] * len(lines)}
    began = time.process_time()
    Page(page, LIMITS).settle()
    assert time.process_time() - began < 60


def test_pages_in_tasks(spark):
    """Many pages, some over the borders of Arrow batches, as each alone."""
    rng, rows, expected = random.Random(4), [], {}
    for p in range(40):
        page = random_page(rng, p % 2 == 0)
        for i, g in enumerate(by_hand(page)):
            expected[f"f{p}", i] = g
        rows += [(f"f{p}", 1, i, *(page[c][i] for c in ("group", "x0", "y0", "x1", "y1", "scale", "height", "n_chars", *FLAGS)), False) for i in range(len(page["group"]))]
    lines = spark.createDataFrame(rows, "file_id string, page_no int, line_no int, group int, x0 int, y0 int, x1 int, y1 int, scale double, height double, n_chars int, is_money boolean, has_date boolean, has_total boolean, is_head boolean, is_side boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {}
        for r in merge_groups(lines.repartition(7), ["file_id", "page_no"], LIMITS).collect():
            got.setdefault(r.file_id, {})[r.line_no] = r.group
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p in range(40):
        n = sum(1 for f, _ in expected if f == f"f{p}")
        assert named([got.get(f"f{p}", {}).get(i) for i in range(n)]) == [expected[f"f{p}", i] for i in range(n)]


def test_no_pages(spark):
    assert cluster_receipts(spark.createDataFrame([], LINE)).where(F.col("region_no").isNotNull()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_lines_are_chained_as_all_pairs_say(seed):
    """From the top, with a reach, against every pair of lines; weak lines stay alone."""
    rng = random.Random(seed)
    joined = 0
    for k in range(300):
        n = rng.randint(0, 30)
        step = 25 if k % 2 else 1
        boxes = [(x := rng.randrange(0, 900, step), y := rng.randrange(0, 700, step), x + rng.randrange(0, 400, step), y + rng.randrange(0, 100, step)) for _ in range(n)]
        page = {c: [float(b[j]) for b in boxes] for j, c in enumerate(("x0", "y0", "x1", "y1"))}
        page |= {"is_weak": [rng.random() < 0.2 for _ in boxes], "scale": [rng.choice([0.3, 1.0])] * n, "height": [rng.choice([20.0, 25.0, 40.0])] * n}
        label = list(range(n))
        for _ in range(n):
            for i in range(n):
                for j in range(n):
                    a, b = boxes[i], boxes[j]
                    reach = max(LIMITS["vertical_break"] * page["scale"][0], LIMITS["vertical_lines"] * page["height"][0])
                    gap, common = max(a[1], b[1]) - min(a[3], b[3]), min(a[2], b[2]) - max(a[0], b[0])
                    if i != j and not page["is_weak"][i] and not page["is_weak"][j] and common >= LIMITS["link_overlap"] * min(a[2] - a[0], b[2] - b[0]) and -LIMITS["vertical_overlap"] * page["height"][0] <= gap <= reach:
                        label[i] = label[j] = min(label[i], label[j])
        assert chains(page, LIMITS) == label
        joined += len(label) - len(set(label))
    assert joined > 300


def test_receipts_are_found_without_checkpoints_and_pairs_of_lines(spark):
    """Lines are moved once by page and once for their numbers, and nothing is written on the way, whatever the pages hold."""
    import os

    from ledgerloom.operators.lineage import shared_folder

    rows = [("f%d" % p, 1, i, "Total 5.00" if i else "x", 700.0 * (i % 2), 40.0 * (i // 2), 700.0 * (i % 2) + 400, 40.0 * (i // 2) + 25, 0.0, 0.99) for p in range(5) for i in range(14)]
    lines = spark.createDataFrame(rows, LINE)
    shared = shared_folder(spark).removeprefix("file:")
    count = lambda: sum(len(f) for _, _, f in os.walk(shared))
    before, found = count(), cluster_receipts(lines, tasks=3)
    assert {(r.line_no % 2, r.region_no) for r in found.collect()} == {(0, 1), (1, 2)}
    assert count() == before
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
