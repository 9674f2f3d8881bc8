"""SimHash near duplicates by covering locality-sensitive hashing.

1. A text's fingerprint: of the hashes of its shingles each of 64 bits is set if over half
   of them have it.  Equal fingerprints are one node, so copies are counted, not compared.
2. Structured masks (a covering): every bit has a vector of radius + 1 bits, none of
   them zero, and the table of a vector v looks at the bits whose vector has an odd
   product with v.  The vectors of ``radius`` differing bits span less than the
   space, so some v is orthogonal to all of them, and in its table the two fingerprints
   are equal: every pair within the radius meets in one of 2^(radius + 1) - 1 tables,
   with certainty.
3. A table's bucket of more than LIMIT fingerprints is dealt again by a covering of the
   bits that its table doesn't look at.  At a radius of 2 a table looks at 36 of 64 bits
   and the second one at 15 or 16 more, so no group has more than 2^12 fingerprints,
   however many the corpus has.
4. Within a group the components of the links are told exactly, by distances of what
   has been reached to what hasn't, and leave the task as chains, never as pairs.
5. Components of the chains by label propagation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, released, text_of
from .jaccard_join import components

#: Fingerprints of a group whose distances are looked at directly.
LIMIT = 1 << 12
#: A bucket of more than this share of all fingerprints, or a fingerprint of more than this share of all rows, isn't sent through one task; there are few of these.
SHARE = 2000
SEED = 42


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = SEED) -> int:
    """64 bits, as a signed number: those set in over half of the XXH64 hashes of the shingles; of all words if they are fewer, 0 if there are none."""
    import xxhash

    if not words:
        return 0
    n = min(shingle, len(words))
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    hashed = xxhash.xxh64_intdigest
    found = [hashed(text[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 16):
        part = np.array(found[at : at + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(found), bitorder="little").view("<i8")[0])


def covering(bits: list[int], radius: int) -> list[int]:
    """Masks over ``bits``: any two numbers that differ in at most ``radius`` of them are equal under one of the masks.

    The bits are dealt evenly to the vectors 1 .. 2^(radius + 1) - 1.
    """
    every = (1 << (radius + 1)) - 1
    vector = {b: 1 + i % every for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, every + 1)]


def tables(radius: int) -> list[tuple[int, list[int]]]:
    """Each table's mask with the masks by which its large buckets are dealt again."""
    return [(m, [m | n for n in covering([b for b in range(64) if not m >> b & 1], radius)]) for m in covering(list(range(64)), radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(fingerprints: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(t).alias("bucket_table"), fingerprints.bitwiseAND(F.lit(_signed(m))).alias("bucket_key")) for t, m in enumerate(masks)]))


def linked(values: np.ndarray, radius: int) -> np.ndarray:
    """By place the number of its component: places link where their values differ in ``radius`` bits at most."""
    label = np.full(len(values), -1, dtype=np.int64)
    rest, name = np.arange(len(values)), 0
    while len(rest):
        front, rest = rest[:1], rest[1:]
        label[front] = name
        while len(front) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(values[front[at : at + 256], None] ^ values[None, rest]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            label[front] = name
        name += 1
    return label


def _chains(radius: int, limit: int):
    """Rows sorted by bucket and fingerprint -> edges (a, b), each the next one of its component in its bucket; (a, null) for a fingerprint of a bucket beyond the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the bucket that may go on in the next batch
        count, beyond, last = 0, False, None

        def edges(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            label = linked(group.view(np.uint64), radius)
            order = np.argsort(label, kind="stable")
            same = label[order][1:] == label[order][:-1]
            return group[order][:-1][same], group[order][1:][same]

        def out(a: np.ndarray, b: np.ndarray | None, table: int) -> pa.RecordBatch:
            second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
            return pa.RecordBatch.from_arrays([pa.array(a), second, pa.array(np.full(len(a), table, dtype=np.int32))], names=["a", "b", "bucket_table"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, beyond
            if beyond:
                yield out(np.concatenate(held), None, last[0]) if held else out(np.empty(0, dtype=np.int64), None, 0)
            elif count > 1:
                yield out(*edges(np.concatenate(held)), last[0])
            held, count, beyond = [], 0, False

        for batch in batches:
            if not batch.num_rows:
                continue
            table, key, value = (batch.column(c).to_numpy() for c in ("bucket_table", "bucket_key", "fingerprint"))
            bounds = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(key)], strict=True):
                own = (int(table[a]), int(key[a]))
                if own != last:
                    yield from close()
                    last = own
                held.append(value[a:b])
                count += b - a
                if count > limit:
                    # Too many to hold: they are passed on to be dealt again.
                    beyond = True
                    yield out(np.concatenate(held), None, own[0])
                    held = []
        yield from close()

    return run


def _dealt(keyed: DataFrame, radius: int, limit: int) -> DataFrame:
    count = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket_table", "bucket_key", "fingerprint"]
    sorted_rows = keyed.select(*order).repartition(count, "bucket_table", "bucket_key").sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(released(_chains(radius, limit)), "a long, b long, bucket_table int")


def near_edges(fingerprints: DataFrame, radius: int = 2, limit: int = LIMIT) -> DataFrame:
    """(a, b): edges between different fingerprints (column fingerprint) that connect what links of ``radius`` bits or fewer connect."""
    every = tables(radius)
    keyed = fingerprints.select("fingerprint", _keyed(F.col("fingerprint"), [m for m, _ in every]).alias("k")).select("fingerprint", "k.*")
    # Buckets of a great share of all: as many as the tables times SHARE at most, so their broadcast has a bound.
    total = fingerprints.count()
    great = keyed.groupBy("bucket_table", "bucket_key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > limit) & (F.col("n") * SHARE > total)).select("bucket_table", "bucket_key")
    great = cut(great)
    found = cut(_dealt(keyed.join(F.broadcast(great), ["bucket_table", "bucket_key"], "left_anti"), radius, limit))
    again = found.where("b is null").select(F.col("a").alias("fingerprint"), "bucket_table").unionByName(keyed.join(F.broadcast(great), ["bucket_table", "bucket_key"]).select("fingerprint", "bucket_table"))
    edges = found.where("b is not null").select("a", "b")
    if great.isEmpty() and found.where("b is null").isEmpty():
        return edges
    deeper = None
    for t, (_, masks) in enumerate(every):
        own = again.where(F.col("bucket_table") == t).select("fingerprint", _keyed(F.col("fingerprint"), masks).alias("k"))
        own = own.select("fingerprint", (F.col("k.bucket_table") + len(masks) * t).alias("bucket_table"), "k.bucket_key")
        deeper = own if deeper is None else deeper.unionByName(own)
    # No bucket of these has more fingerprints than bits that are in neither mask allow.
    bound = max(1 << (64 - m.bit_count()) for _, masks in every for m in masks)
    return edges.unionByName(cut(_dealt(deeper, radius, bound)).select("a", "b"))


def fingerprinted(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the text's fingerprint as a long."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bytes: A-Z alone are lower-cased, and they split at U+0009 to U+000D and spaces alone.
            found = [fingerprint(t.lower().split(), shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def simhash_components(docs: DataFrame, radius: int = 2, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    component_id: the smallest id reachable over links between fingerprints that
    differ in ``radius`` bits or fewer, the row's own included.

    A null text is empty; texts without words have the fingerprint zero and link as any
    other.  A null id is never the smallest; component_id is null only where no row of the
    component has an id.  Repeated rows are rows as any other, an empty table gives an
    empty result, and other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    found = cut(fingerprinted(docs, shingle, id_column, text_column))
    nodes = cut(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = cut(components(near_edges(nodes.select("fingerprint"), radius)))
    named = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(firsts, "root").select("fingerprint", "n", "component_id"))
    # Fingerprints of a great share of the rows, fewer than SHARE, are looked up by a broadcast; the others meet in a shuffle.
    total = found.count()
    hot = F.broadcast(named.where(F.col("n") * SHARE > total).select("fingerprint", F.struct("component_id").alias("hot")))
    marked = found.join(hot, "fingerprint", "left")
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    few = marked.where("hot is null").select("doc_id", "fingerprint").join(named.select("fingerprint", "component_id"), "fingerprint")
    return marked.where("hot is not null").select("doc_id", shown, F.col("hot.component_id")).unionByName(few.select("doc_id", shown, "component_id"))
