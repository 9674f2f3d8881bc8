"""Runs of words that repeat with a period, by refining classes of equal factors.

Two places of a text are in one class of level l if the same l words start there.
Classes are refined from level to level (Crochemore): places i and j stay together
if i + 1 and j + 1 were together one level before.  Of the parts that a class fell
into, all but the largest (the smaller halves) are enough to refine the next level, so a
place is moved at most log2(n) times, and a level costs what it moves.

Each class is a list in text order.  Where the neighbour of place i in its class of level l
is i + l, the l words at i are repeated at once: a square.  Squares of one period at
consecutive places are a run, and the squares of level l are all those of primitive
period l, since a shorter period would have put a nearer neighbour into the class.

A run of ``least`` words or more repeats least / 2 words at a distance of its
period, so classes start there, and most texts have none: the words of a whole Arrow
batch are tried for it at once.  Periods up to that level are read off its classes
(two periods within it would have a common divisor as a shorter one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_text, bound_batches, released

RUNS = "array<struct<start:long,length:long,period:long>>"


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers, from 0, that are equal where both are."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def repeated_factors(words: np.ndarray, texts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, classes): of the places whose ``level`` words stand more than once in their text, in text order; classes are numbered from 0.

    words: numbers of the words of several texts, one after the other; texts: the text each is of.
    """
    starts = np.flatnonzero(texts[: len(texts) - level + 1] == texts[level - 1 :]) if len(words) >= level else np.empty(0, dtype=np.int64)
    # A hash first, by which most places are alone; then numbers that are equal where the words are.
    name = texts[starts].astype(np.uint64)
    for k in range(level):
        name = (name ^ words[starts + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    order = np.argsort(name)
    same = name[order][1:] == name[order][:-1]
    shared = np.zeros(len(starts), dtype=bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    starts = starts[shared]
    classes = texts[starts].astype(np.int64)
    for k in range(level):
        classes = _pairs(classes, words[starts + k])
    alone = np.bincount(classes)[classes] < 2 if len(classes) else np.empty(0, dtype=bool)
    starts, classes = starts[~alone], classes[~alone]
    return starts, np.unique(classes, return_inverse=True)[1]


class Partition:
    """Classes of two places or more that start with the same ``level`` words, as linked lists in text order."""

    def __init__(self, places: list[int], classes: list[int], level: int) -> None:
        self.level = level
        self.of: dict[int, int] = dict(zip(places, classes, strict=True))
        self.next: dict[int, int] = {}
        self.before: dict[int, int] = {}
        self.head: list[int] = []
        self.tail: list[int] = []
        self.size: list[int] = []
        #: By distance the places whose neighbour came to stand there; some have lost it again.
        self.gaps: dict[int, list[int]] = {}
        for p, c in zip(places, classes, strict=True):
            while len(self.head) <= c:
                self._new()
            self._append(p, c)
        #: Lists of places by which the next level is refined; at first by all classes, also those of one place.
        self.smaller: list[list[int]] = []
        self._first = True

    def _new(self) -> int:
        self.head.append(-1)
        self.tail.append(-1)
        self.size.append(0)
        return len(self.head) - 1

    def _gap(self, place: int, follower: int) -> None:
        self.gaps.setdefault(follower - place, []).append(place)

    def _append(self, place: int, to: int) -> None:
        last = self.tail[to]
        self.of[place] = to
        self.before[place] = last
        self.next[place] = -1
        if last < 0:
            self.head[to] = place
        else:
            self.next[last] = place
            self._gap(last, place)
        self.tail[to] = place
        self.size[to] += 1

    def _remove(self, place: int) -> None:
        c, a, b = self.of[place], self.before[place], self.next[place]
        if a < 0:
            self.head[c] = b
        else:
            self.next[a] = b
        if b < 0:
            self.tail[c] = a
        else:
            self.before[b] = a
            if a >= 0:
                self._gap(a, b)
        self.size[c] -= 1

    def members(self, c: int) -> list[int]:
        out, p = [], self.head[c]
        while p >= 0:
            out.append(p)
            p = self.next[p]
        return out

    def squares(self, period: int) -> list[int]:
        """The places whose neighbour in its class stands ``period`` further, in text order."""
        return sorted({p for p in self.gaps.get(period, ()) if self.next[p] == p + period})

    def refine(self) -> bool:
        """To the next level; false if no class can be parted any more."""
        if self._first:
            # Every class parts, also one of a single place, which stands for all that is in no list.
            self._first = False
            lists: list[list[int]] = [self.members(c) for c in range(len(self.head))]
            lists += [[p + 1] for p in self.of if p + 1 not in self.of]
        else:
            lists = self.smaller
        of, size = self.of, self.size
        parts: dict[int, list[int]] = {}
        for places in lists:
            made: dict[int, int] = {}
            for p in places:
                c = of.get(p - 1)
                if c is None or size[c] < 2 and c not in made:
                    continue  # nothing to part
                to = made.get(c)
                if to is None:
                    to = made[c] = self._new()
                    parts.setdefault(c, []).append(to)
                self._remove(p - 1)
                self._append(p - 1, to)
        self.level += 1
        self.gaps.pop(self.level - 1, None)
        self.smaller = []
        for c, made_of in parts.items():
            family = [x for x in (c, *made_of) if size[x]]
            largest = max(family, key=size.__getitem__)
            self.smaller += [self.members(x) for x in family if x != largest]
        return bool(self.smaller)


def runs_of(places: list[int], classes: list[int], level: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` words or more, by start and period, from the repeated factors of ``level`` words of one text."""
    partition = Partition(places, classes, level)
    out = []

    def read(period: int) -> None:
        squares = partition.squares(period)
        at = 0
        while at < len(squares):
            end = at
            while end + 1 < len(squares) and squares[end + 1] == squares[end] + 1:
                end += 1
            # The words from the first place to the last one's neighbour and the factor there.
            length = squares[end] - squares[at] + period + partition.level
            if length >= max(least, 2 * period):
                out.append((squares[at], length, period))
            at = end + 1

    for period in range(1, level + 1):
        read(period)
    while partition.refine():
        read(partition.level)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def batch_runs(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (lists of words)."""
    level = max(1, least // 2)
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    words = pa.array([w for text in texts for w in text], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    places, classes = repeated_factors(words, np.repeat(np.arange(len(texts)), lengths), level)
    offsets = np.append(0, np.cumsum(lengths))
    edges = np.searchsorted(places, offsets)
    out: list[list[tuple[int, int, int]]] = []
    for i in range(len(texts)):
        a, b = edges[i], edges[i + 1]
        if a == b:
            out.append([])
            continue
        own = np.unique(classes[a:b], return_inverse=True)[1]
        out.append(runs_of((places[a:b] - offsets[i]).tolist(), own.tolist(), level, least))
    return out


def periodic_runs(docs: DataFrame, least: int = 12, keep: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: a struct ``row`` of the kept columns, ``runs`` and ``collapsed``.

    Words are what stands between spaces and the signs U+0009 to U+000D.  runs: every
    maximal stretch of ``least`` (an even number) words or more and at least two periods
    long, as (start, length, smallest period), by start and period.  collapsed: the words,
    joined by one space, without those that some run holds after its first period.

    A null text is empty; a text without words has no runs and collapses to the empty
    string.  Null and repeated ids and repeated rows are rows as any other, each decided
    by itself; an empty table gives an empty result; no other column is looked at, and kept
    ones may have any name.  A text is one task's work: n log n steps at most, and memory
    for its words.
    """
    if least % 2:
        raise ValueError("least must be even")
    bound_batches(docs.sparkSession)
    rows = beside_text(docs, keep or [id_column], text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bytes split at exactly these signs.
            texts = [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = batch_runs(texts, least)
            kept = pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            runs = pa.array([[{"start": a, "length": n, "period": p} for a, n, p in r] for r in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), runs, kept], names=["row", "runs", "collapsed"])

    return rows.mapInArrow(released(run), f"row {rows.schema['row'].dataType.simpleString()}, runs {RUNS}, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of the greatest length, of these the one of the smallest start, then period; null if there is none."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)
