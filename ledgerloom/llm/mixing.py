"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are cut into blocks.  With weight w, a share of all, the j-th block
(from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w).  In each
slot the released block with the earliest deadline runs.  Weights are exact fractions,
never rounded to slots, so at every slot each source is less than one block away from
its share, however long the phase is.  The schedule repeats after as many slots as the
weights' common denominator.

So the driver makes one table of slots for each phase; a phase ends at the slot at
which a source runs out, after which the others share its weight in proportion.  A
table has as many slots as the common denominator, or as the phase if that is
shorter: 20 equal sources need 20 slots, weights in thousandths 1,000, weights without
a small common denominator one for each block of the phase.  Each block's slot then follows from its
number by arithmetic.  The tables' size is counted while they are made; beyond
MOST_ENTRIES it is an error that names the remedy, not a coarser schedule.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slots of a repeated table at least: short schedules are tabled several times over.
PERIOD = 512
#: Salted groups in which a source's rows are numbered: so many at least, and rows in one of them.
SALTS, SALT_ROWS = 256, 50_000
#: Sources times phases and slots of tables that the driver makes at most.
MOST_ENTRIES = 20_000_000
#: Entries up to which the tables are broadcast; larger ones are written out by block and joined in a shuffle.
BROADCAST_ENTRIES = 1 << 20
#: Places of a table in one row of those.
PLACES = 4096


def tempered(counts: dict[str, int], exponent: float = 0.5, least: int = 100) -> dict[str, int]:
    """Target weights by a power of the sources' sizes: with 0.5 a source a hundred times as large gets ten times the weight.

    Whole numbers; the smallest is ``least``, so every ratio of two is true within 1 / ``least``
    however many sources there are and however unlike.  An empty source counts as one row.
    """
    power = {s: max(n, 1) ** exponent for s, n in counts.items()}
    unit = least / min(power.values(), default=1.0)
    return {s: round(unit * x) for s, x in power.items()}


def source_counts(docs: DataFrame, source_column: str = "source") -> dict[str, int]:
    """Rows by source; a null source is ''."""
    source = F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("mix_source")
    return {r[0]: r[1] for r in docs.select(source).groupBy("mix_source").agg(F.count(F.lit(1))).collect()}


def _exact(weight: float) -> Fraction:
    """The weight as a fraction: the simplest one if it is the same float, as 1/3 or 1/10, else the float's own."""
    simple = Fraction(weight).limit_denominator(10**9)
    return simple if float(simple) == float(weight) else Fraction(weight)


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the given ratios."""
    exact = {s: _exact(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    return {s: int(x * scale) for s, x in exact.items()}


def schedule(slots: np.ndarray, period: int, most: np.ndarray | None = None) -> np.ndarray:
    """Earliest deadline first among released blocks, for one period or until a source has placed its ``most`` blocks: the source of each slot.

    slots: of a period that each source has, together ``period``.  Of blocks with one
    deadline that of the first source goes first.
    """
    n = len(slots)
    limit = slots if most is None else np.minimum(slots, most)
    # The slot by which the first source has surely placed its last block.
    end = period if most is None else int(min([period, *(-(-limit * period // slots))[limit == most]]))
    released = np.minimum(limit, -(-(end * slots) // period)).astype(np.int64)  # blocks that are released before the end
    source = np.repeat(np.arange(n), released)
    block = (np.arange(len(source)) - np.repeat(np.cumsum(released) - released, released)).astype(slots.dtype)
    release = (block * period // slots[source]).astype(np.int64)
    due = -(-((block + 1) * period) // slots[source])
    order = np.argsort(release, kind="stable")
    codes = (due * n + source)[order].tolist()
    bounds = np.searchsorted(release[order], np.arange(end), side="right").tolist()
    found, waiting, at = [], [], 0
    push, pop, put = heapq.heappush, heapq.heappop, heapq.heappushpop
    for to in bounds:
        if to == at:
            found.append(pop(waiting))
            continue
        for code in codes[at : to - 1]:
            push(waiting, code)
        found.append(put(waiting, codes[to - 1]))
        at = to
    out = (np.array(found, dtype=slots.dtype) % n).astype(np.int64)
    if most is None:
        return out
    # Up to the slot at which a source places its last block.
    own = np.argsort(out, kind="stable")
    counts = np.bincount(out, minlength=n)
    over = np.flatnonzero((limit == most) & (counts >= limit))
    lasts = own[(np.cumsum(counts) - counts)[over] + limit[over].astype(np.int64) - 1]
    return out[: lasts.min(initial=end - 1) + 1]


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> dict[str, list[tuple[int, int, list[int], int]]]:
    """Where each source's blocks go: for each source its stretches (first, n, places, stride).

    Block b of a stretch, first <= b < first + n, stands at
    places[(b - first) mod len(places)] + stride * ((b - first) div len(places)).
    """
    exact = whole_weights({s: w for s, w in weights.items() if blocks.get(s, 0) > 0})
    # Of one deadline the larger weight goes first, then the first name.
    names = sorted(exact, key=lambda s: (-exact[s], s))
    rest = np.array([blocks[s] for s in names], dtype=np.int64)
    done = np.zeros(len(names), dtype=np.int64)
    live = np.arange(len(names))
    out: dict[str, list[tuple[int, int, list[int], int]]] = {s: [] for s in names}
    once: list[np.ndarray] = []  # sources of slots that are not repeated
    at = entries = 0

    def write(sources: np.ndarray, begin: int, times: int) -> None:
        """The slots from ``begin`` on, which are repeated: so many times after one another."""
        order = np.argsort(sources, kind="stable")
        bounds = np.searchsorted(sources[order], np.arange(len(names) + 1)).tolist()
        places = (begin + order).tolist()
        for i in np.unique(sources).tolist():
            own = places[bounds[i] : bounds[i + 1]]
            out[names[i]].append((int(done[i]), times * len(own), own, len(sources) if times > 1 else 0))
        done[:] += times * np.bincount(sources, minlength=len(names))

    def flush() -> None:
        if once:
            slots = np.concatenate(once)
            write(slots, at - len(slots), 1)
            once.clear()

    while len(live):
        own = [exact[names[i]] for i in live.tolist()]
        common = math.gcd(*own)
        span = sum(own) // common
        times = -(-period // span)
        span *= times
        # Whole numbers of 64 bits where they suffice.
        large = (max(own) // common * times + 1) * span * len(own) >= 1 << 62
        q = np.array([x // common * times for x in own], dtype=object if large else np.int64)
        whole = int(((rest[live] - 1) // q).min())  # tables in which no source runs out
        last = int((-(-(rest[live] - whole * q) * span // q)).min())  # slots of the one in which one does
        entries += len(live) + min(last, span) + (span if whole else 0)
        if entries > MOST_ENTRIES:
            raise ValueError(f"the schedule of {len(blocks)} sources has more than {MOST_ENTRIES} entries: give weights of a smaller common denominator, larger blocks or fewer sources")
        if whole:
            flush()
            write(live[schedule(q, span)], at, whole)
            rest[live] -= whole * q.astype(np.int64)
            at += whole * span
        # The table in which a source runs out, up to that slot.
        slots = live[schedule(q, span, rest[live].astype(q.dtype))]
        once.append(slots)
        rest -= np.bincount(slots, minlength=len(names))
        at += len(slots)
        live = live[rest[live] > 0]
    flush()
    return out


def block_slots(spark: SparkSession, table: list) -> DataFrame:
    """(mix_source, block, block_slot) of all blocks of the stretches, written out by tasks: a row for PLACES places goes to each."""
    parts = [(s, first + i, length, repeats, stride, places[i : i + PLACES]) for s, own in table for first, n, places, stride in own for length in [len(places)] for repeats in [n // len(places)] for i in range(0, length, PLACES)]
    rows = spark.createDataFrame(parts, "mix_source string, first long, length long, repeats long, stride long, places array<long>")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mix_source", "first")
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
    rows = rows.select("mix_source", "first", "length", "stride", "again", F.posexplode("places").alias("i", "place"))
    return rows.select("mix_source", (F.col("first") + F.col("again") * F.col("length") + F.col("i")).alias("block"), (F.col("place") + F.col("again") * F.col("stride")).alias("block_slot"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 16, period: int = PERIOD, source_column: str = "source", id_column: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Interleave all rows so that every prefix has the sources in their target weights.

    Columns doc_id, source, block (number in its source), block_slot (the block's
    place, gapless from 0), place_in_block or, with ``keep``, a struct ``row`` of
    those input columns before the last three.  Up to the slot at which the first
    source runs out, each source is less than one block from its share; from
    there on the same holds for the sources that are left, in proportion to their
    weights.  No row is dropped or repeated.

    ``weights``: by source; None or an empty one gives every source the same.  A source that is not
    in it gets the smallest weight given; weights must be positive.  A null source
    is a source of its own, named ''.  Rows of a source are numbered by a hash of
    all their columns, then the id: a hot source is spread over groups of about
    SALT_ROWS rows, whatever its ids are; only rows equal in all columns share one.
    Repeated rows and null ids are rows as any other, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    kept = F.struct(*[F.col(f"`{c}`") for c in (keep or [id_column, source_column])])
    source = F.coalesce(F.col(source_column).cast("string"), F.lit(""))
    totals = source_counts(docs, source_column)
    salts = max(SALTS, max(totals.values(), default=0) // SALT_ROWS)
    # The hash is over the whole row: rows that share an id, or have none, do not meet in one group.
    mark = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = docs.select(kept.alias("row"), source.alias("mix_source"), F.pmod(mark, F.lit(salts)).cast("int").alias("salt"), mark.alias("mark"), F.col(id_column).alias("mix_id"))
    sizes = rows.select("mix_source", "salt").groupBy("mix_source", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_source").orderBy("salt")) - F.col("n")
    offsets = sizes.withColumn("before", before)
    least = min(weights.values()) if weights else 1.0
    wanted = {s: float((weights or {}).get(s, least)) for s in totals}
    blocks = {s: -(-n // block_rows) for s, n in totals.items()}
    table = [(s, [tuple(x) for x in stretches]) for s, stretches in phases(blocks, wanted, period).items()]
    entries = sum(1 + len(places) for _, own in table for _, _, places, _ in own)
    inside = Window.partitionBy("mix_source", "salt").orderBy("mix_id", "mark")
    numbered = rows.withColumn("rank", F.row_number().over(inside)).join(offsets.select("mix_source", "salt", "before"), ["mix_source", "salt"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("rank") - 1)
    numbered = numbered.withColumn("block", F.floor(F.col("number") / block_rows)).withColumn("place_in_block", F.pmod("number", F.lit(block_rows)).cast("int"))
    if entries <= BROADCAST_ENTRIES:
        stretches = spark.createDataFrame(table, "mix_source string, stretches array<struct<first:long,n:long,places:array<long>,stride:long>>")
        mixed = numbered.join(F.broadcast(stretches), "mix_source").withColumn("own", F.filter("stretches", lambda x: (F.col("block") >= x["first"]) & (F.col("block") < x["first"] + x["n"]))[0])
        within = F.col("block") - F.col("own.first")
        length = F.size("own.places")
        mixed = mixed.withColumn("block_slot", F.element_at("own.places", (F.pmod(within, length) + 1).cast("int")) + F.col("own.stride") * F.floor(within / length))
    else:
        # Rows meet their block, of which none has more than block_rows.
        mixed = numbered.join(block_slots(spark, table), ["mix_source", "block"])
    if keep:
        return mixed.select("row", "block", "block_slot", "place_in_block")
    return mixed.select(F.col("row")[id_column].alias("doc_id"), F.col("row")[source_column].alias("source"), "block", "block_slot", "place_in_block")
