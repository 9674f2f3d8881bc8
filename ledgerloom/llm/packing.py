"""Best-fit packing of token pieces into sequences under several capacities.

Vector best fit.  A sequence has residual tokens, documents and attention cost
(the sum of squared lengths).  Pieces are taken by falling length; among the open
sequences that can hold a piece under every residual, it goes to the one with the
largest weighted dot product of need and use so far (``score="dot"``) or the
smallest weighted norm of what would be left (``score="norm"``).

A piece's needs depend on its length alone, so the plan is made from the counts
of pieces by length, of which there are at most ``max_tokens``: sequences in the
same state are handled as one, with a multiplicity.  The plan's size is bounded by
the capacities, not by the corpus: at 2,048 tokens it had 9,373 rows for 12 million
pieces and 3,143 for ten thousand million, made in a fifth of a second.  Pieces then
find their places by their number among the pieces of the same length, which is
counted in salted groups so that one frequent length does not meet in one task.

With windows (of a mix of sources, say) each window's pieces are packed among
themselves, and the windows' plans are made side by side in tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, released, text_of
from .encoding import by_bytes, encoder_of

#: Salted groups into which the pieces of one length are dealt for numbering.
SALTS = 64
#: Rows of plans up to which they are broadcast; more are joined in a shuffle.
BROADCAST_ROWS = 20_000


def plan(counts: dict[int, int], max_tokens: int, max_documents: int, max_attention: int, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "dot") -> list[tuple[int, int, int, int, int]]:
    """Vector best fit over counts of pieces by length.

    Rows (length, first_item, n_items, first_sequence, offset): items
    first_item.. of that length go to sequences first_sequence.., one each, at
    that offset.
    """
    caps = np.array([max_tokens, max_documents, max_attention], dtype=float)
    w = np.array(weights)
    #: state (residual tokens, residual documents, residual attention) -> ranges [first, count] of sequences
    states: dict[tuple[int, int, int], list[list[int]]] = {}
    opened = 0
    out = []
    for length in sorted(counts, reverse=True):
        if length < 1 or length > max_tokens or length * length > max_attention or max_documents < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        need = (length, 1, length * length)
        left, item = counts[length], 0
        while left:
            fitting = [s for s in states if s[0] >= length and s[1] >= 1 and s[2] >= need[2]]
            if fitting:
                residual = np.array(fitting, dtype=float) / caps
                if score == "dot":
                    value = ((1 - residual) * (np.array(need) / caps) * w).sum(axis=1)
                else:
                    value = -(((residual - np.array(need) / caps) ** 2) * w).sum(axis=1)
                best = max(range(len(fitting)), key=lambda i: (value[i], -fitting[i][0], fitting[i]))
                state = fitting[best]
                first, n = states[state].pop()
                if not states[state]:
                    del states[state]
                if n > left:
                    states.setdefault(state, []).append([first + left, n - left])
                    n = left
            else:
                state = (max_tokens, max_documents, max_attention)
                # as many new sequences as the rest of this length fills, each to be filled by the rounds that follow
                each = min(max_tokens // length, max_documents, max_attention // need[2])
                n, first = -(-left // each), opened
                opened += n
            out.append((length, item, n, first, max_tokens - state[0]))
            after = (state[0] - need[0], state[1] - need[1], state[2] - need[2])
            if after[0] > 0 and after[1] > 0:
                states.setdefault(after, []).append([first, n])
            left -= n
            item += n
    return out


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int, id_column: str = "doc_id", text_column: str = "text", window: Column | None = None) -> DataFrame:
    """The pieces of each document's ids followed by ``end_id``; only the first of a long one is shorter."""
    bound_batches(docs.sparkSession)
    window = F.lit("") if window is None else window.cast("string")
    rows = docs.select(window.alias("window"), F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, keep_ids=True, ranked=True)
        crc = zlib.crc32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            row, piece, start, length, check = [], [], [], [], []
            at = 0
            for a, b in by_bytes(texts):
                for raw in encoder.encode(texts[a:b]):
                    raw += end
                    n = len(raw) // 4
                    first = n % max_tokens or max_tokens
                    begin = 0
                    for k, stop in enumerate(range(first, n + 1, max_tokens)):
                        row.append(at)
                        piece.append(k)
                        start.append(begin)
                        length.append(stop - begin)
                        check.append(crc(raw[begin * 4 : stop * 4]))
                        begin = stop
                    at += 1
            ids, where = (batch.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "window"))
            yield pa.RecordBatch.from_arrays([where, ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())], names=["window", "doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(released(run), f"window string, doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, max_tokens: int = 2048, max_documents: int | None = None, max_attention: int | None = None, score: str = "dot", id_column: str = "doc_id", text_column: str = "text", window: Column | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``max_tokens`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    By default the document and attention capacities are as wide as the token
    capacity allows, so that as few sequences as possible are used; narrower ones
    bind as they are given.  ``window``: only pieces of documents with the same value
    share a sequence, and sequence numbers rise with it; a null one is a value of
    its own, the first.

    A null text is empty and takes one token (the end id); a null id stays null;
    rows that repeat are packed each; an empty table gives an empty result; other
    columns are not looked at.

    The pieces, a few dozen bytes each, are checkpointed, so texts are encoded once.
    """
    spark = docs.sparkSession
    max_documents = max_documents or max_tokens
    max_attention = max_attention or max_tokens**2
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    pieces = pieces_of(docs, tokenizer_path, end_id, max_tokens, id_column, text_column, window)
    pieces = cut(pieces.withColumn("window", F.coalesce("window", F.lit(""))).withColumn("salt", salt))
    sizes = pieces.groupBy("window", "length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("window", "length").orderBy("salt")
    sizes = cut(sizes.withColumn("before", F.sum("n").over(before) - F.col("n")))  # at most max_tokens * SALTS rows a window
    counts = sizes.groupBy("window", "length").agg(F.sum("n").alias("n"))
    # A window has a count for each length: max_tokens at most.
    windows = counts.groupBy("window").agg(F.map_from_entries(F.collect_list(F.struct("length", "n"))).alias("counts"))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["length", "first_item", "n_items", "first_sequence", "offset"]
        for batch in batches:
            for window, of_window in zip(batch.column("window").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                rows = plan(dict(of_window), max_tokens, max_documents, max_attention, score=score)
                yield pa.RecordBatch.from_arrays([pa.array([window] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))], names=["window", *names])

    plans = cut(windows.mapInArrow(planned, "window string, length long, first_item long, n_items long, first_sequence long, offset long"))
    # Windows one after another: as many rows as windows.
    used = plans.groupBy("window").agg(F.max(F.col("first_sequence") + F.col("n_items")).alias("used"))
    begin = used.withColumn("begin", F.sum("used").over(Window.orderBy("window").rowsBetween(Window.unboundedPreceding, 0)) - F.col("used")).select("window", "begin")
    placed = plans.join(begin, "window")
    if plans.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    within = Window.partitionBy("window", "length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("rank", F.row_number().over(within)).join(sizes.select("window", "length", "salt", "before"), ["window", "length", "salt"]).withColumn("item", F.col("before") + F.col("rank") - 1)
    hit = (F.col("item") >= F.col("first_item")) & (F.col("item") < F.col("first_item") + F.col("n_items"))
    return (
        numbered.alias("i")
        .join(placed.alias("p"), (F.col("i.window") == F.col("p.window")) & (F.col("i.length") == F.col("p.length")) & hit)
        .select("doc_id", "piece", "start", F.col("i.length").alias("length"), "ids_crc32", (F.col("begin") + F.col("first_sequence") + F.col("item") - F.col("first_item")).alias("sequence_id"), "offset")
    )
