"""Resampling of documents towards a target distribution, by hashed n-grams of words.

1. The words of an Arrow batch become numbers, document after document with a
   separator between them, and the numbers a suffix array: positions sorted by the
   ``max_n`` words that start there, with the length of the common prefix of
   neighbours (LCP).
2. Neighbours with an LCP of n or more form a run, which is one n-gram with all its
   occurrences.  It is hashed once, from the hash of its first n - 1 words, and the bucket
   goes back to the run's positions.
3. Buckets are counted over all documents and over the target texts; a task adds up
   its own counts first, so at most ``buckets`` rows of each task are shuffled.  A
   bucket's gain is the logarithm of the ratio of its smoothed shares.
4. A second pass gives every document the floored mean of its features' gains.
   Gumbel noise from a hash of the id turns the weights into keys; the documents of the
   highest keys are a sample without replacement in proportion to exp(weight / 1000).
5. Ranks are global without a global sort in one task: rows are dealt by ranges of the
   order, and a row's rank is its place in its range plus the sizes of those before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, released, text_of

#: Words of one suffix array; longer stretches are cut, with the words after the cut in sight.
CHUNK = 1 << 20

#: Bytes of words, A-Z lower-cased; 0 for all other bytes.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
_LOWER[0x41:0x5B] += 32


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(numbers, owner, dictionary) of all words of an array of strings: each word's number in the dictionary and its text's place."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    lowered = _LOWER[raw]
    inside = lowered != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A word ends with its text.
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.append(0, np.cumsum(stops - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(lowered[inside])]).dictionary_encode()
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return words.indices.to_numpy().astype(np.int64), owner, words.dictionary.to_pylist()


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): positions sorted by the ``depth`` symbols from there on, and how many of them each shares with the one before it.

    0 separates texts: it is never shared, so an lcp ends with its text.
    """
    rank, length = symbols, 1
    while length < depth:  # prefix doubling
        step = min(length, depth - length)
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        rank = rank * (max(int(rank.max(initial=0)), int(ahead.max(initial=0))) + 1) + ahead
        length += step
        if length < depth:  # small numbers again, from 1
            rank = 1 + np.unique(rank, return_inverse=True)[1]
    order = np.argsort(rank)
    padded = np.append(symbols, np.zeros(depth, dtype=symbols.dtype))
    lcp = np.zeros(len(order), dtype=np.int64)
    going = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(depth):
        own = padded[order + k]
        going &= (own[1:] == own[:-1]) & (own[1:] != 0)
        lcp[1:] += going
    return order, lcp


def occurrences(symbols: np.ndarray, own: int, dictionary: list[bytes], max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of all n-grams, n from 1 to ``max_n``, that start in the first ``own`` symbols; words are numbered from 1.

    Each run of equal n-grams is hashed once; the hash is the CRC32 of the words joined by spaces.
    """
    order, lcp = suffix_array(symbols, max_n)
    room = np.zeros(len(symbols), dtype=np.int64)  # words from here to the text's end, at most max_n
    full = symbols != 0
    for n in range(max_n):
        full[: len(full) - n] &= symbols[n:] != 0
        full[len(full) - n :] = False
        room += full
    tails = [b" " + w for w in dictionary]
    hashes = np.zeros(len(symbols), dtype=np.int64)
    for n in range(1, max_n + 1):
        kept = room[order] >= n
        at = order[kept]
        opens = lcp[kept] < n
        heads = at[opens]
        if n == 1:
            found = map(zlib.crc32, map(dictionary.__getitem__, (symbols[heads] - 1).tolist()))
        else:
            found = map(zlib.crc32, map(tails.__getitem__, (symbols[heads + n - 1] - 1).tolist()), hashes[heads].tolist())
        run = np.fromiter(found, dtype=np.int64, count=len(heads))
        hashes[at] = run[np.cumsum(opens) - 1]
        first = at[at < own]
        yield first, hashes[first]


def features(texts: pa.Array, max_n: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, an iterator of (texts, hashes) of all occurrences of n-grams)."""
    numbers, owner, dictionary = word_numbers(texts)
    # One separator after each text.
    symbols = np.zeros(len(numbers) + len(texts), dtype=np.int64)
    symbols[np.arange(len(numbers)) + owner] = numbers + 1
    text_of_symbol = np.repeat(np.arange(len(texts)), np.bincount(owner, minlength=len(texts)) + 1)

    def run() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(symbols), CHUNK):
            for places, hashes in occurrences(symbols[at : at + CHUNK + max_n - 1], CHUNK, dictionary, max_n):
                yield text_of_symbol[places + at], hashes

    return np.bincount(owner, minlength=len(texts)), run()


def bucket_counts(texts: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """Occurrences of n-grams by bucket, over all rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, hashes in features(batch.column("text"), max_n)[1]:
                total += np.bincount(hashes % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    found = texts.mapInArrow(released(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in found.collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket floor(1000 ln of the target's smoothed share over the source's)."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    rows = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in rows], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, max_n: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of all features, 0 where there are none."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, found = features(batch.column("text"), max_n)
            total, count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for owners, hashes in found:
                # Whole numbers below 2^53: sums of doubles are exact.
                total += np.bincount(owners, weights=gain[hashes % len(gain)], minlength=n).astype(np.int64)
                count += np.bincount(owners, minlength=n)
            weight = total // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(count), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order, which must have no ties: dealt by ranges, whose sizes are added up."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(count, *order).sortWithinPartitions(*order))
    # The number of a checkpoint's row: its partition's number above, its place below.
    placed = dealt.withColumn("at", F.monotonically_increasing_id())
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # One row for each partition.
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + place + 1).drop("at", "part", "before")


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, max_n: int = 2, buckets: int = 10_000, least_words: int = 20, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    The documents with at least ``least_words`` words take part in the draw; the
    floor(percent / 100) of them with the highest scores are drawn and have a rank from
    1, ties going to the smaller id (null last), then to any row of equal id.  Weight and
    score are given for all.

    A null text has no words: no features and weight 0, as an empty one; it is never drawn
    unless ``least_words`` is 0.  A null id counts as an empty string in the
    noise, so rows of equal id have equal noise.  Repeated rows are rows as any other.  An
    empty table gives an empty result, an empty target the gains of a uniform one.  Other
    columns are not looked at.  A task holds some 30 bytes for each byte of its longest text.
    """
    bound_batches(docs.sparkSession)
    source = bucket_counts(docs.select(text_of(text_column).alias("text")), max_n, buckets)
    wanted = bucket_counts(target.select(text_of(target_column).alias("text")), max_n, buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = cut(weighed(docs, gains(source, wanted), max_n, id_column, text_column).withColumn("score", F.col("weight") + gumbel))
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    # Rows of a checkpoint keep their numbers, which part those of equal score and id.
    numbered = scored.where(able).withColumn("row", F.monotonically_increasing_id())
    placed = ranked(numbered, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")])
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
