"""A page's lines chained to groups, and these merged into receipts, one cheapest pair after the other.

Lines chain only within a page, so they are chained where the page is held anyway: pairs of
lines are never rows that are shuffled.

A pair's right to merge and its cost depend on its two groups and on where the page's
lines stand, which never changes.  So a pair is judged once, when the later one of its
groups comes to be, and waits in a priority queue; an entry one of whose groups has been
merged meanwhile is passed over when it comes up.  A merged group takes the place of its
earlier part, with a hull, flags and sorted heights put together from both.  Groups and line
centres stand in a grid of square cells, so a group is only tried with what is near it.

Pages are dealt by key and stream through a task one at a time.
"""

from __future__ import annotations

import heapq
import itertools
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(eq=False)
class Group:
    """Lines that belong together; ``place`` is its rank on the page, by which ties are settled."""

    place: int
    x0: float
    y0: float
    x1: float
    y1: float
    n: int
    chars: int
    money: bool
    date: bool
    total: bool
    first_date: float  # top of its highest line with a date
    heads: list[tuple[float, bool]]  # its highest lines: top, and whether it is a slip's head
    lines: list[int]
    centres: list[float]  # heights of its lines' middles, sorted
    alive: bool = True
    cells: list[tuple[int, int]] = field(default_factory=list)

    @property
    def width(self) -> float:
        return self.x1 - self.x0


def united_width(a: Group, b: Group) -> float:
    return max(a.x1, b.x1) - min(a.x0, b.x0)


def apart(a: Group, b: Group, axis: str) -> float:
    """The gap between two groups along an axis; negative for what they have in common."""
    if axis == "x":
        return max(a.x0, b.x0) - min(a.x1, b.x1)
    return max(a.y0, b.y0) - min(a.y1, b.y1)


def chains(lines: dict[str, list], limits: dict[str, float]) -> list[int]:
    """For each line the first of those that are chained: above one another and near; weak ones are no bridge and stay alone.

    From the top, a line is only tried with those that begin within reach of its foot.
    """
    x0, y0, x1, y1, weak, height = (lines[c] for c in ("x0", "y0", "x1", "y1", "is_weak", "height"))
    n = len(x0)
    root = list(range(n))
    if not n:
        return root
    reach, deep = max(limits["vertical_break"] * lines["scale"][0], limits["vertical_lines"] * height[0]), -limits["vertical_overlap"] * height[0]
    overlap = limits["link_overlap"]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    order = sorted((i for i in range(n) if not weak[i]), key=y0.__getitem__)
    for k, i in enumerate(order):
        left, right, foot = x0[i], x1[i], y1[i]
        for j in map(order.__getitem__, range(k + 1, len(order))):
            if y0[j] - foot > reach:
                break
            if min(right, x1[j]) - max(left, x0[j]) >= overlap * min(right - left, x1[j] - x0[j]) and deep <= y0[j] - min(foot, y1[j]) <= reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


class Page:
    """The groups of one page, with its scale and line height."""

    def __init__(self, lines: dict[str, list], limits: dict[str, float]) -> None:
        self.limits, self.scale, self.height = limits, lines["scale"][0], lines["height"][0]
        self.size = max(1.0, self.scaled("column_gap"))
        self.x = [(a + b) / 2 for a, b in zip(lines["x0"], lines["x1"], strict=True)]
        self.y = [(a + b) / 2 for a, b in zip(lines["y0"], lines["y1"], strict=True)]
        self.owner: list[Group | None] = [None] * len(self.x)
        self.line_cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in range(len(self.x)):
            self.line_cells[int(self.x[i] // self.size), int(self.y[i] // self.size)].append(i)
        self.groups: list[Group] = []
        self.grid: dict[tuple[int, int], set[Group]] = defaultdict(set)
        members: dict[int, list[int]] = defaultdict(list)
        for i, g in enumerate(lines["group"]):
            members[g].append(i)
        take = lambda name, own: [lines[name][i] for i in own]
        for place, own in enumerate(members.values()):  # in the order of their first lines
            tops = take("y0", own)
            dated = [y for y, d in zip(tops, take("has_date", own), strict=True) if d]
            heads = sorted(zip(tops, take("is_head", own), strict=True), key=lambda h: h[0])
            self.put(
                Group(
                    place, min(take("x0", own)), min(tops), max(take("x1", own)), max(take("y1", own)), len(own), sum(take("n_chars", own)), any(take("is_money", own)), bool(dated), any(take("has_total", own)),
                    min(dated, default=float("inf")), heads[: limits["head_lines"]], own, sorted(self.y[i] for i in own),
                )
            )

    def scaled(self, name: str) -> float:
        return self.limits[name] * self.scale

    def cells_of(self, x0: float, y0: float, x1: float, y1: float) -> list[tuple[int, int]]:
        s = self.size
        return [(i, j) for i in range(int(x0 // s), int(x1 // s) + 1) for j in range(int(y0 // s), int(y1 // s) + 1)]

    def put(self, g: Group) -> None:
        self.groups.append(g)
        g.cells = self.cells_of(g.x0, g.y0, g.x1, g.y1)
        for c in g.cells:
            self.grid[c].add(g)
        for i in g.lines:
            self.owner[i] = g

    def remove(self, g: Group) -> None:
        g.alive = False
        for c in g.cells:
            self.grid[c].discard(g)

    def near(self, g: Group, reach_x: float, reach_y: float) -> set[Group]:
        """The other groups whose hulls are at most so far from the group's."""
        found = {h for c in self.cells_of(g.x0 - reach_x, g.y0 - reach_y, g.x1 + reach_x, g.y1 + reach_y) for h in self.grid.get(c, ())}
        found.discard(g)
        return found

    def merge(self, a: Group, b: Group) -> Group:
        """``b`` goes to ``a``, whose place the new group has."""
        self.remove(a)
        self.remove(b)
        heads = sorted([*a.heads, *b.heads], key=lambda h: h[0])[: self.limits["head_lines"]]
        both = Group(
            a.place, min(a.x0, b.x0), min(a.y0, b.y0), max(a.x1, b.x1), max(a.y1, b.y1), a.n + b.n, a.chars + b.chars, a.money or b.money, a.date or b.date, a.total or b.total,
            min(a.first_date, b.first_date), heads, a.lines + b.lines, sorted(a.centres + b.centres),
        )
        self.put(both)
        return both

    def live(self) -> list[Group]:
        return sorted((g for g in self.groups if g.alive), key=lambda g: g.place)

    # --- pairs side by side

    def whole(self, width: float, money: bool) -> bool:
        return money and self.scaled("whole_width") <= width <= self.scaled("widest")

    def bridged(self, a: Group, b: Group) -> bool:
        """Whether a line of a third group stands between two strips, where both have lines."""
        x0, x1 = min(a.x1, b.x1), max(a.x0, b.x0)
        y0, y1 = max(a.y0, b.y0), min(a.y1, b.y1)
        if x1 <= x0 or y1 <= y0:
            return False
        for c in self.cells_of(x0, y0, x1, y1):
            for i in self.line_cells.get(c, ()):
                if x0 < self.x[i] < x1 and y0 < self.y[i] < y1 and self.owner[i] is not a and self.owner[i] is not b:
                    return True
        return False

    def level(self, a: Group, b: Group, enough: int = 2) -> bool:
        """Whether so many lines of ``a`` have one of ``b`` at their height."""
        reach, found = self.limits["pair_level"] * self.height, 0
        for y in a.centres:
            # The bound itself is tried by the difference, as it may be rounded.
            i = bisect_left(b.centres, y - reach)
            if any(abs(y - c) <= reach for c in b.centres[max(0, i - 1) : i + 2]):
                found += 1
                if found == enough:
                    return True
        return False

    def side_by_side(self, a: Group, b: Group) -> tuple | None:
        """The cost of merging two strips, ``a`` the earlier one; none if they may not."""
        gap, width = apart(a, b, "x"), united_width(a, b)
        if -apart(a, b, "y") < self.limits["column_overlap"] * min(a.y1 - a.y0, b.y1 - b.y0) or gap > self.scaled("column_gap") or width > self.scaled("widest"):
            return None
        done = self.whole(a.width, a.money), self.whole(b.width, b.money)
        gain = int(self.whole(width, a.money or b.money)) - sum(done)
        fragments = not any(done) and gap <= self.scaled("fragment_gap") and width <= self.scaled("fragment_width")
        if not (gain > 0 or fragments or gap <= 0 and gain >= 0):
            return None
        if gap > 0:
            if min(a.n, b.n) < 2 or a.date and b.date or self.bridged(a, b):
                return None
            if gap > self.scaled("pair_gap") and not self.level(a, b):
                return None
        # The greatest gain, the smallest gap, and of equal ones the last pair.
        return -gain, gap, -a.place, -b.place

    # --- pairs above one another

    def opens(self, g: Group) -> bool:
        """Whether a group can be the head of another receipt."""
        return g.first_date <= g.y0 + (g.y1 - g.y0) * self.limits["head_share"] or any(h for _, h in g.heads)

    def stacked(self, a: Group, b: Group) -> tuple | None:
        if -apart(a, b, "x") < self.limits["stack_overlap"] * min(a.width, b.width) or united_width(a, b) > self.scaled("widest"):
            return None
        upper, lower = (a, b) if a.y0 <= b.y0 else (b, a)
        gap = lower.y0 - upper.y1
        if gap > self.scaled("stack_gap"):
            return None
        deep = -gap > self.limits["deep_overlap"] * min(a.y1 - a.y0, b.y1 - b.y0)
        if not deep and upper.total and self.opens(lower):
            return None  # a seam
        return max(gap, -1.0), a.place, b.place

    # --- rounds

    def agglomerate(self, cost: Callable[[Group, Group], tuple | None], reach_x: float, reach_y: float) -> None:
        """Merge the cheapest pair until there is none; pairs further apart than the reach have no cost."""
        queue: list[tuple] = []
        number = 0  # so that groups are never compared

        def offer(g: Group, others: set[Group]) -> None:
            nonlocal number
            for h in others:
                a, b = (g, h) if g.place < h.place else (h, g)
                c = cost(a, b)
                if c is not None:
                    number += 1
                    heapq.heappush(queue, (c, number, a, b))

        for g in self.live():
            offer(g, {h for h in self.near(g, reach_x, reach_y) if h.place > g.place})
        while queue:
            _, _, a, b = heapq.heappop(queue)
            if a.alive and b.alive:
                both = self.merge(a, b)
                offer(both, self.near(both, reach_x, reach_y))

    def settle_scraps(self) -> None:
        """Groups of a line or two go to a group near them that they don't widen much; else those that say nothing go.

        In their order, while there is more than one group.  Only other groups take
        scraps in, and those only grow: a scrap that finds none never will.
        """
        small = lambda g: g.n <= self.limits["scrap_lines"] or g.chars <= self.limits["scrap_chars"]
        live = self.live()
        hosts = [g for g in live if not small(g)]
        left = len(live)
        for g in live:
            if left < 2:
                return
            if not small(g):
                continue
            fits = [h for h in hosts if united_width(g, h) <= self.scaled("widest")]
            safe = [h for h in fits if united_width(g, h) - h.width <= self.scaled("widen")]
            if not safe and not g.date and not g.money:
                self.remove(g)
                for i in g.lines:
                    self.owner[i] = None
                left -= 1
                continue
            safe = safe or fits
            if not safe:
                continue
            middle, expand = (g.x0 + g.x1) / 2, self.scaled("expand")
            over = [h for h in safe if h.x0 - expand <= middle <= h.x1 + expand]
            home = min(over or safe, key=lambda h: max(0.0, apart(g, h, "x")) + max(0.0, apart(g, h, "y")))
            hosts[hosts.index(home)] = self.merge(home, g)
            left -= 1

    def settle(self) -> list[int | None]:
        """The group of each line, by the place of its first line among all; null for those that are dropped."""
        self.agglomerate(self.side_by_side, self.scaled("column_gap"), 0.0)
        stacks = lambda: self.agglomerate(self.stacked, 0.0, self.scaled("stack_gap"))
        stacks()
        self.settle_scraps()
        stacks()
        return [g.place if g is not None else None for g in self.owner]


_READ = ["x0", "y0", "x1", "y1", "scale", "height", "n_chars", "is_money", "has_date", "has_total", "is_head"]


def _changes(keys: list[pa.Array]) -> list[int]:
    """Rows whose key isn't that of the row before; nulls are equal to one another."""
    changed = np.zeros(max(len(keys[0]) - 1, 0), dtype=bool)
    for k in keys:
        here, before = k.slice(1), k.slice(0, len(changed))
        for differs in (pc.fill_null(pc.not_equal(here, before), False), pc.xor(here.is_null(), before.is_null())):
            changed |= differs.to_numpy(zero_copy_only=False)
    return (np.flatnonzero(changed) + 1).tolist()


def _values(table: pa.Table, name: str) -> list:
    """A column's values; the short way knows no nulls."""
    column = table.column(name)
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def _whole_pages(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole pages, and where in them pages begin, with the end."""
    held: pa.Table | None = None  # the page that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        bounds = [0, *_changes([table.column(k).combine_chunks() for k in keys])]
        if len(bounds) > 1:
            yield table.slice(0, bounds[-1]), bounds
        held = table.slice(bounds[-1])
    if held is not None:
        yield held, [0, held.num_rows]


def merge_groups(lines: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """Lines (keys, line_no, group, their boxes and flags) with ``group`` by receipt; lines of groups that are dropped are left out.

    Memory of a task: one page and one Arrow batch.
    """
    names = lines.columns
    count = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartition(count, *keys).sortWithinPartitions(*keys, "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_pages(batches, keys):
            read = {c: _values(table, c) for c in ["group", *_READ]}
            group = [g for a, b in itertools.pairwise(bounds) for g in Page({c: v[a:b] for c, v in read.items()}, limits).settle()]
            table = table.set_column(names.index("group"), "group", pa.array(group, pa.int64()))
            yield from table.filter(table.column("group").is_valid()).combine_chunks().to_batches()

    dealt = dealt.withColumn("group", F.col("group").cast("long"))
    return dealt.mapInArrow(run, dealt.schema)


def page_receipts(lines: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """Lines (keys, line_no, their boxes and flags), in tasks by page and there sorted -> a row for each receipt: hull, n, flags, its lines.

    Memory of a task: one page and one Arrow batch.
    """
    line_no = lines.schema["line_no"].dataType.simpleString()
    names = ["group", "x0", "y0", "x1", "y1", "n", "is_money", "has_date", "has_total"]
    kinds = [pa.int64(), *[pa.float64()] * 4, pa.int64(), *[pa.bool_()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_pages(batches, keys):
            read = {c: _values(table, c) for c in ["is_weak", "line_no", *_READ]}
            where, rows, own = [], [], []
            for a, b in itertools.pairwise(bounds):
                lines = {c: v[a:b] for c, v in read.items()}
                page = Page({**lines, "group": chains(lines, limits)}, limits)
                page.settle()
                for g in page.live():
                    where.append(a)
                    rows.append((g.place, g.x0, g.y0, g.x1, g.y1, g.n, g.money, g.date, g.total))
                    own.append([lines["line_no"][i] for i in g.lines])
            of = pa.array(where, pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            made = [*(table.column(k).combine_chunks().take(of) for k in keys), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)), pa.array(own, pa.list_(table.schema.field("line_no").type))]
            yield from pa.Table.from_arrays(made, names=[*keys, *names, "lines"]).combine_chunks().to_batches()

    shapes = [f"{k} {lines.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} {t}" for c, t in zip(names, ["long", *["double"] * 4, "long", *["boolean"] * 3], strict=True)]
    return lines.mapInArrow(run, ", ".join([*shapes, f"lines array<{line_no}>"]))
