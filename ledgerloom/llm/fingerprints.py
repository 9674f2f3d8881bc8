"""Document fingerprints from locally consistent parsing.

A text's code points are level-0 names.  At each level runs of one name become a
single symbol, neighbours are told apart by deterministic coin tossing (the lowest
bit in which a name differs from its left neighbour, and that bit's value, again and
again until labels are few), and every local minimum of the labels starts a phrase.
A phrase's name is a hash of the names in it.  A boundary depends on a handful of
names to its left and one to its right, so equal substrings are parsed alike in
their interior wherever they stand.  The fingerprint is a bottom-k sketch of the
phrase names of all levels from ``FIRST_LEVEL`` up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_of

#: Rounds of coin tossing: 32-bit names to labels below 64, below 12, below 8.
TOSSES = 3
#: Phrases of about a dozen code points; those of the level below are common to unrelated texts.
FIRST_LEVEL = 2
LAST_LEVEL = 12
#: Names kept of each text.
SKETCH = 64

_A = np.uint32(0x9E3779B1)
_B = np.uint32(0x85EBCA6B)
_POWER = 0x2C1B3C6D  # odd, so it has an inverse modulo 2^32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * _B
    return x ^ (x >> np.uint32(13))


def _coin(bits: int) -> np.ndarray:
    """Label of (left, own) for every pair of labels of so many bits, by index left << bits | own."""
    left, own = np.divmod(np.arange(1 << (2 * bits)), 1 << bits)
    differ = left ^ own
    k = np.where(differ > 0, np.frexp((differ & -differ).astype(np.float64))[1] - 1, 0)
    return ((k << 1) | ((own >> k) & 1)).astype(np.uint8)


#: Labels after the first toss have 6 bits, after the second 4.
_SECOND, _THIRD = _coin(6), _coin(4)


def _shifted(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The left neighbours; a text's first symbol has its own complement."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[starts] = ~x[starts]
    return left


def _labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Few labels, different for neighbours with different names, from each name and TOSSES to its left."""
    differ = names ^ _shifted(names, starts)
    low = (differ & (~differ + np.uint32(1))).astype(np.float32)
    k = ((low.view(np.uint32) >> np.uint32(23)) - np.uint32(127)) & np.uint32(31)  # names that collide differ in no bit
    x = ((k << np.uint32(1)) | ((names >> k) & np.uint32(1))).astype(np.uint16)
    x = _SECOND[((_shifted(x, starts) & np.uint16(63)) << np.uint16(6)) | x].astype(np.uint16)
    return _THIRD[((_shifted(x, starts) & np.uint16(15)) << np.uint16(4)) | x].astype(np.int8)


_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint32), np.ones(1, dtype=np.uint32)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _POWER and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_POWER, pow(_POWER, -1, 1 << 32))):
            out = np.full(2 * n, base, dtype=np.uint32)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out, dtype=np.uint32)
    return _powers[0], _powers[1]


def _level(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and where each text starts among them; no text is empty here."""
    n = len(names)
    # Runs of one name become one symbol.
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[starts] = True
    if not new.all():
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, n)).astype(np.uint32)
        starts = np.searchsorted(at, starts)
        names = names[at]
        runs = length > 1
        names[runs] = _mix(names[runs] ^ (length[runs] * _A))
        n = len(names)
    labels = _labels(names, starts)
    # Local minima start phrases, and so does every text.
    first = np.zeros(n, dtype=bool)
    if n > 2:
        first[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] <= labels[2:])
    # A phrase has two symbols at least, so none starts at a text's second or last symbol.
    first[starts[starts < n - 1] + 1] = False
    first[np.append(starts[1:], n) - 1] = False
    first[starts] = True
    at = np.flatnonzero(first)
    powers, inverse = _power_tables(n)
    named = _mix(np.add.reduceat(_mix(names + _A) * powers[:n], at, dtype=np.uint32) * inverse[at])
    return named, np.searchsorted(at, starts)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted SKETCH smallest 32-bit phrase names, or all if fewer."""
    out = [np.empty(0, dtype=np.uint32)] * len(texts)
    live = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
    if not len(live):
        return out
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    names = _mix((np.frombuffer(raw, dtype="<u4") + np.uint32(1)) * _A)
    lengths = np.array([len(texts[i]) for i in live], dtype=np.int64)
    starts = np.append(0, np.cumsum(lengths)[:-1])
    keyed = []  # text number << 32 | phrase name, of all levels
    for level in range(1, LAST_LEVEL + 1):
        if not len(live):
            break
        names, starts = _level(names, starts)
        counts = np.diff(np.append(starts, len(names)))
        if level >= FIRST_LEVEL:
            keyed.append(np.repeat(live.astype(np.uint64) << np.uint64(32), counts) | names)
        # A text that is down to one phrase goes no further, but not before it has a name in the sketch.
        more = (counts > 1) | (level < FIRST_LEVEL)
        if not more.all():
            names = names[np.repeat(more, counts)]
            live, counts = live[more], counts[more]
            starts = np.append(0, np.cumsum(counts)[:-1]) if len(live) else counts
    every = np.concatenate(keyed)
    every.sort()
    new = np.empty(len(every), dtype=bool)
    new[0] = True
    np.not_equal(every[1:], every[:-1], out=new[1:])
    every = every[new]
    edges = np.searchsorted(every, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    kept = every.astype(np.uint32)
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        out[i] = kept[a : min(b, a + SKETCH)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The part of phrases in common, estimated from two sketches; 1 for two empty texts."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    union = len(both) - int(twice.sum())
    if union <= SKETCH:
        return float(twice.sum() / union)
    # The sketch of the union is the first SKETCH different names.
    place = np.cumsum(np.append(True, ~twice)) - 1
    return float((twice & (place[1:] < SKETCH)).sum() / SKETCH)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row's whole text (null: empty, fingerprint ''); no shuffle.

    Null ids stay null, repeated rows get a row each, an empty table an empty
    result, and other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .encoding import by_bytes

        for batch in batches:
            texts = batch.column("text").to_pylist()
            out: list[str] = []
            for a, b in by_bytes(texts, 1 << 18):
                out += map(written, sketches(texts[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {id_type}, fingerprint string")


#: Rows of one group of consecutive ids, and groups at most.
GROUP_ROWS, MOST_GROUPS = 16_384, 100_000
_LEAST = -(1 << 63)


def _group(bounds: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many of the sorted bounds are at most (key, tie), by halving: log2 of their number of comparisons a row."""
    if not bounds:
        return F.lit(0)
    keys, ties = F.lit([k for k, _ in bounds]), F.lit([t for _, t in bounds])

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        at = F.get(keys, middle)
        right = (s["low"] < s["high"]) & ((at < key) | ((at == key) & (F.get(ties, middle) <= tie)))
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    span = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), span, halve, lambda s: s["low"])


def with_next(docs: DataFrame, groups: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, int]:
    """Rows (group, doc_id, tie, text, guest) from which every text's next one can be read in one pass, and the number of groups.

    The order is by id, null ids first, then by a hash of the text (``tie``).  Bounds are
    quantiles of the ids; an id that several of them fall on is cut further by the tie.
    The first row of each group is known, so it is also sent, as a guest, to the group
    before, and the first row of all to the last group.  The whole text moves once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("tie", F.xxhash64("text"))
    # Two passes over the ids alone; at most MOST_GROUPS numbers reach the driver.
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low")).first()
    groups = groups or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_GROUPS, whole.n // GROUP_ROWS))
    marks = [(i + 1) / groups for i in range(groups - 1)]
    found = rows.agg(F.percentile_approx("key", marks or [0.5], 100_000).alias("b")).first().b or []
    times = Counter(found if marks else [])
    hot = max(times.values(), default=0) > 1 or whole.low in times
    bounds = []
    for b in sorted(times):
        parts = times[b] + (b == whole.low)
        bounds += [(b, _LEAST + (k << 64) // parts) for k in range(parts) if k or b != whole.low]
    key, tie = F.col("key"), F.col("tie")
    first = (whole.low, None)
    if hot:
        # Where an id fills groups of its own, their first rows are looked up.
        firsts = sorted(tuple(r.first) for r in rows.groupBy(_group(bounds, key, tie).alias("group")).agg(F.min(F.struct("key", "tie")).alias("first")).collect())
        first, bounds = firsts[0], firsts[1:]
    group = _group(bounds, key, tie)
    leads = []
    if bounds:
        at = F.col("group") - 1
        opens = (F.get(F.lit([k for k, _ in bounds]), at) == key) & (F.get(F.lit([t for _, t in bounds]), at) == tie if hot else F.lit(True))
        leads.append(F.when((at >= 0) & opens, at))
    leads.append(F.when((key == F.lit(first[0])) & (tie == F.lit(first[1]) if hot else F.lit(True)), F.lit(len(bounds))))
    places = F.filter(F.array(F.struct(F.col("group").alias("group"), F.lit(False).alias("guest")), *[F.struct(x.alias("group"), F.lit(True).alias("guest")) for x in leads]), lambda p: p["group"].isNotNull())
    dealt = rows.withColumn("group", group).select("doc_id", "tie", "text", F.explode(places).alias("p")).select(F.col("p.group").alias("group"), F.col("p.guest").alias("guest"), "doc_id", "tie", "text")
    return dealt, len(bounds) + 1


def edited_fingerprints(docs: DataFrame, groups: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited one whose last floor(n/2) code points are the next text's first.

    Next: by ascending id, null ids first, equal ids by a hash of their text; after
    the last comes the first.  Columns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  Null text: empty.  A lone row is
    its own next.  Repeated rows get a row each, an empty table an empty result.
    """
    import hashlib

    spark = docs.sparkSession
    bound_batches(spark)
    dealt, count = with_next(docs, groups, id_column, text_column)
    # A partition for each group: hashes would put several into one.
    dealt = dealt.repartitionById(count, "group").sortWithinPartitions("group", F.col("guest").asc(), F.col("doc_id").asc_nulls_first(), "tie", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def lines(held: list[tuple[int | None, str]], follow: tuple[int | None, str]) -> pa.RecordBatch:
        """The rows of consecutive texts, the last of them followed by ``follow``."""
        texts = [t for _, t in held]
        after = [*texts[1:], follow[1]]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, after, strict=True)]
        own = sketches([*texts, follow[1]])
        new = sketches(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in held], pa.int64()),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                pa.array(list(map(written, own[:-1])), pa.string()),
                pa.array(list(map(written, new)), pa.string()),
                pa.array(list(map(likeness, own, new)), pa.float64()),
                pa.array(list(map(likeness, own[:-1], own[1:])), pa.float64()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, now, over = 0, None, True
        for batch in batches:
            for group, guest, i, text in zip(*(batch.column(c).to_pylist() for c in ("group", "guest", "doc_id", "text")), strict=True):
                if group != now:
                    now, over, held, size = group, False, [], 0
                if over:
                    continue  # a later guest: a copy of the first row's id
                if guest:
                    over = True
                if held and (guest or size >= 1 << 18):
                    yield lines(held, (i, text))
                    held, size = [], 0
                if not guest:
                    held.append((i, text))
                    size += len(text) + 16

    return dealt.select("group", "guest", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
