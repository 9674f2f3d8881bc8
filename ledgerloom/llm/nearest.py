"""Approximate nearest neighbours by largest inner product, with an adaptive dimension scan.

Equal vectors are one point that carries its smallest ids: of copies at the same
score only the ``k`` + 1 smallest ids can be among a query's k nearest, so the other
ids can't appear in any result.  Points are rotated by a fixed random orthogonal
matrix and dealt into lists by nearest centroid; a list is held in column blocks.

A query probes lists in order of their centroids' inner product, in two rounds.  The
first lists are searched whole and give the query its k-th score so far.  With that
it goes to the others, but for lists whose centroid and radius prove that they hold
nothing better.  Within a list, the blocks of columns give partial distances one after
another.  After rotation these estimate the whole distance, so a hypothesis test
abandons a candidate early if its scaled partial distance is larger, by more than
chance allows, than the distance at which it would enter the query's current k best.
What is left is scored exactly on the original vectors, in double precision.

How many lists a query visits in all is measured, not given: on a bounded sample, as
many as hold the wanted share of true neighbours.  Vectors with structure need few;
random directions, which have none, need most of them, and work then grows with the
number of queries times that of points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut

SEED = 5
#: Points of the sample on which lists and the share of them to visit are fitted; every point is indexed.
SAMPLE = 20_000
#: Sample points that ask when the share is measured.
ASKING = 500
#: Share of true neighbours that the visited lists must hold in the sample.
HELD = 0.96
#: Part of the visited lists that the first round takes.
FIRST = 0.15
#: Significance of the abandoning test: larger abandons less.
EPSILON = 2.5
#: Columns of a block.
COLUMNS = 16
#: Share of pairs below which those left are scanned one by one.
MANY = 0.08
#: Points of one part of a list: a longer list is dealt into parts, all of which are probed.
PART = 8192
#: Points of a list on average, at least; few points are one list, searched whole.
LEAST_POINTS = 64
#: Groups in which the copies of one vector are folded before they meet.
SALTS = 64


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means on the sample, by inner product of unit vectors."""
    rng = np.random.default_rng(SEED)
    centre = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 2048] @ centre.T - 0.5 * (centre**2).sum(axis=1)).argmax(axis=1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centre)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=len(centre))
        full = counts > 0
        centre[full] = sums[full] / counts[full, None]
    return centre


def lists_to_visit(sample: np.ndarray, centre: np.ndarray, k: int, held: float) -> int:
    """The number of lists, in a query's order, that hold the share ``held`` of the k nearest within the sample."""
    own = np.concatenate([(sample[i : i + 2048] @ centre.T - 0.5 * (centre**2).sum(axis=1)).argmax(axis=1) for i in range(0, len(sample), 2048)])
    asking = np.random.default_rng(SEED).choice(len(sample), min(ASKING, len(sample)), replace=False)
    score = sample[asking] @ sample.T
    score[np.arange(len(asking)), asking] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centre)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(sample[asking] @ centre.T), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1), axis=None)
    return int(ranks[min(len(ranks) - 1, math.ceil(held * len(ranks)) - 1)]) + 1


def scan(queries: np.ndarray, floors: np.ndarray, points: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) that the tests keep and that may be among the query's k best there, ties included.

    All are rotated.  floors: inner products below which a candidate can't count.
    """
    d = points.shape[1]
    q, p = queries.astype(np.float32), points.astype(np.float32)
    nq, np_ = (q * q).sum(axis=1), (p * p).sum(axis=1)
    # The squared distance at which a candidate has the floor's inner product is nq - 2 floor + np_.
    reach = np.where(np.isfinite(floors), nq - 2 * floors, np.float32(np.inf)).astype(np.float32)
    who = what = partial = None
    slack = 1e-5 * (1 + np_)
    whole = np.zeros((len(q), len(p)), dtype=np.float32)
    alive = np.ones(whole.shape, dtype=bool)
    at = 0
    for end in [*range(COLUMNS, d, COLUMNS), d]:
        a, b = q[:, at:end], p[:, at:end]
        limit = (1 + epsilon / math.sqrt(end)) ** 2 * end / d if end < d else 1.0
        if who is None:
            # As long as many are left, a block of columns is one product of matrices for all pairs.
            whole += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            alive &= whole <= np.maximum(limit * (reach[:, None] + np_[None, :]), 0) + slack[None, :]
            if end == d and len(p) > k:
                # All pairs have their value: what is below a query's k-th goes before anything is sorted.
                value = np.where(alive, (nq[:, None] + np_[None, :] - whole) / 2, -np.inf)
                last = np.partition(value, len(p) - k, axis=1)[:, len(p) - k]
                alive &= value >= (last - 1e-4 * (1 + np.abs(last)))[:, None]
            if end == d or np.count_nonzero(alive) < MANY * alive.size:
                who, what = np.nonzero(alive)
                partial = whole[who, what]
        else:
            for i in range(0, len(who), 1 << 18):
                step = a[who[i : i + (1 << 18)]] - b[what[i : i + (1 << 18)]]
                partial[i : i + (1 << 18)] += np.einsum("ij,ij->i", step, step)
            keep = partial <= np.maximum(limit * (reach[who] + np_[what]), 0) + slack[what]
            who, what, partial = who[keep], what[keep], partial[keep]
        at = end
    value = (nq[who] + np_[what] - partial) / 2
    # The k best of each query, and what is tied with the last of them but for rounding.
    order = np.lexsort((-value, who))
    who, what, value = who[order], what[order], value[order]
    first = np.searchsorted(who, np.arange(len(q)))
    count = np.diff(np.append(first, len(who)))
    last = value[np.minimum(first + k - 1, max(len(who) - 1, 0))] if len(who) else value
    least = np.where(count >= k, last, -np.inf)[who] if len(who) else value
    good = value >= least - 1e-4 * (1 + np.abs(value))
    return who[good], what[good]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, lists: int | None = None, held: float = HELD, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Each query's k nearest other rows: query_id, rank (from 1), vec_id, score.

    Queries: rows whose id is divisible by ``every``.  score: the inner product of
    the original vectors in double precision; ties go to the smaller id.  ``held``
    is the share of true neighbours that the lists a query visits must hold.  Rows
    whose id or vector is null, or whose vector is empty, zero or holds null or
    non-finite components, take no part.  An inner product needs vectors of one
    length: those of each length are searched among themselves.  Repeated rows (same
    id and vector) are one row.  Fewer candidates than k: all of them.  An empty
    table gives an empty result; other columns are not looked at.

    Work for one query is bounded by the lists it visits; a list is dealt into parts
    of PART points, so copies or a dense region never meet in one task.  The number of
    lists grows with the root of the points' as far as the sample can place centroids.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    # -0.0 counts as 0.0: vectors are compared as bytes.
    rows = rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    single = vectors.schema[vector_column].dataType.simpleString() == "array<float>"
    lengths = [r.d for r in rows.select(F.size("v").alias("d")).distinct().collect()]
    parts = [_nearest_of_length(rows.where(F.size("v") == d), d, k, every, lists, held, np.dtype("<f4" if single else "<f8")) for d in sorted(lengths)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _nearest_of_length(rows: DataFrame, d: int, k: int, every: int, lists: int | None, held: float, kind: np.dtype) -> DataFrame:
    """``nearest`` for (id, v) with good vectors of one length, which are kept as bytes of numbers of ``kind``."""
    spark = rows.sparkSession

    def points_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies within a batch become one row with its k + 1 smallest ids, and its ids that are queries."""
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(kind)
            found: dict[bytes, set[int]] = {}
            for i, raw in zip(batch.column("id").to_pylist(), (r.tobytes() for r in np.ascontiguousarray(flat)), strict=True):
                found.setdefault(raw, set()).add(i)
            keys = list(found)
            low = [sorted(found[x])[: k + 1] for x in keys]
            asked = [sorted(i for i in found[x] if i % every == 0) for x in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(low, pa.list_(pa.int64())), pa.array(asked, pa.list_(pa.int64()))], names=["raw", "ids", "asked"])

    name = F.unhex(F.md5("raw"))
    partial = rows.mapInArrow(points_in, "raw binary, ids array<long>, asked array<long>").withColumn("point", name)
    # What batches have of one vector is folded in salted groups first, so no list is longer than a bound.
    fold = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    salt = F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int").alias("salt")
    points = cut(partial.groupBy("point", "raw", salt).agg(fold).groupBy("point", "raw").agg(fold))
    asked = cut(partial.where(F.size("asked") > 0).select("point", "raw", F.explode("asked").alias("query_id")).distinct())
    n = points.count()
    draw = F.pmod(F.xxhash64("point", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    drawn = points.where(draw < min(1.0, SAMPLE / max(n, 1))).select("raw").collect()  # about SAMPLE rows at most
    if not drawn:
        drawn = points.select("raw").limit(100).collect()
    turn = rotation(d)
    sample = np.array(sorted(np.frombuffer(r.raw, dtype=kind).tolist() for r in drawn), dtype=np.float64) @ turn
    lists = lists or max(1, min(SAMPLE // 8, round(math.sqrt(n) / 2), n // LEAST_POINTS))
    centre = centroids(sample, lists)
    visited = lists_to_visit(sample, centre, k, held)
    half = 0.5 * (centre**2).sum(axis=1)

    def rotated(raws: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(raws), dtype=kind).reshape(-1, d).astype(np.float64) @ turn

    def in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rotated(batch.column("raw").to_pylist())
            own = (x @ centre.T - half).argmax(axis=1)
            far = np.sqrt(((x - centre[own]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("raw"), batch.column("ids"), pa.array(own, pa.int32()), pa.array(far)], names=["point", "raw", "ids", "list", "far"])

    indexed = cut(points.mapInArrow(in_lists, "point binary, raw binary, ids array<long>, list int, far double"))
    # As many rows as lists.
    measured = {r.list: (r.n, r.far) for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    size = np.array([measured.get(i, (0, 0.0))[0] for i in range(len(centre))])
    radius = np.array([measured.get(i, (0, 0.0))[1] for i in range(len(centre))]) * (1 + 1e-6)
    parts = -(-size // PART)
    pieces = F.element_at(F.lit([int(x) for x in np.maximum(parts, 1)]), F.col("list") + 1)
    dealt = indexed.withColumn("part", F.pmod(F.xxhash64("point", F.lit(9)), pieces).cast("int"))
    first_lists = max(1, math.ceil(FIRST * visited))

    def probing(final: bool):
        """Questions (point, raw, floor) -> one row for each part of each list that the round visits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raws = batch.column("raw").to_pylist()
                names = batch.column("point").to_pylist()
                floors = batch.column("floor").to_numpy(zero_copy_only=False)
                for at in range(0, len(raws), 256):
                    q = rotated(raws[at : at + 256])
                    score = q @ centre.T
                    near = np.argsort(-score, axis=1, kind="stable")
                    # The first round takes lists enough to fill the result.
                    enough = np.cumsum(size[near], axis=1) - size[near] < 4 * (k + 1)
                    rank = np.arange(len(centre))[None, :]
                    begin = (rank < first_lists) | enough
                    take = begin
                    if final:
                        # No point of a list beats its centroid's score by more than radius times norm.
                        best = np.take_along_axis(score + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :], near, axis=1)
                        take = ~begin & (rank < visited) & (best >= floors[at : at + 256][:, None] - 1e-9)
                    take = take & (parts[near] > 0)
                    who, place = np.nonzero(take)
                    where = near[who, place]
                    times = parts[where]
                    who, where = np.repeat(who, times), np.repeat(where, times)
                    part = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[at + i] for i in who.tolist()], pa.binary()), pa.array([raws[at + i] for i in who.tolist()], pa.binary()), pa.array(floors[at + who]), pa.array(where, pa.int32()), pa.array(part, pa.int32())],
                        names=["point", "raw", "floor", "list", "part"],
                    )

        return run

    def answers(held: list[tuple], asked_here: list[tuple]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The k + 1 best ids of a part for each of its queries."""
        points_raw = [r[1] for r in held]
        original = np.frombuffer(b"".join(points_raw), dtype=kind).reshape(-1, d).astype(np.float64)
        q = np.frombuffer(b"".join(r[1] for r in asked_here), dtype=kind).reshape(-1, d).astype(np.float64)
        who, what = scan(q @ turn, np.array([r[2] for r in asked_here]), original @ turn, k + 1)
        # The exact measure on the original vectors, then one row for each id of a point.
        score = np.concatenate([(original[what[i : i + 65536]] * q[who[i : i + 65536]]).sum(axis=1) for i in range(0, len(what), 65536)]) if len(what) else np.empty(0)
        number = np.array([len(r[2]) for r in held])[what] if len(what) else np.empty(0, dtype=int)
        ids = np.array([i for j in what.tolist() for i in held[j][2]], dtype=np.int64)
        who, score = np.repeat(who, number), np.repeat(score, number)
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        good = rank <= k
        return [asked_here[i][0] for i in who[good].tolist()], ids[good], score[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if held and waiting:
                who, ids, scores = answers(held, waiting)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.binary()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["point", "vec_id", "score"])

        for batch in batches:
            for where, part, is_question, point, raw, floor, ids in zip(*(batch.column(c).to_pylist() for c in ("list", "part", "kind", "point", "raw", "floor", "ids")), strict=True):
                if now != (where, part):
                    yield from flush()
                    now, held, waiting = (where, part), [], []
                if is_question == 0:
                    held.append((point, raw, ids))
                else:
                    waiting.append((point, raw, floor))
                    if len(waiting) >= 512:
                        yield from flush()
                        waiting = []
        yield from flush()

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))), 1, k + 1)

    def visit(questions: DataFrame) -> DataFrame:
        """point, best: the k + 1 best (score, id) that a round finds; lists of as many as a query visits, each of k + 1."""
        both = dealt.select("list", "part", F.lit(0).alias("kind"), "point", "raw", F.lit(0.0).alias("floor"), "ids").unionByName(questions.select("list", "part", F.lit(1).alias("kind"), "point", "raw", "floor", F.lit(None).cast("array<long>").alias("ids")))
        both = both.repartition(count, "list", "part").sortWithinPartitions("list", "part", "kind")
        return both.mapInArrow(run, "point binary, vec_id long, score double").groupBy("point").agg(best.alias("best"))

    schema = "point binary, raw binary, floor double, list int, part int"
    questions = asked.select("point", "raw").distinct()
    begun = cut(visit(questions.withColumn("floor", F.lit(float("-inf"))).mapInArrow(probing(False), schema)))
    floor = F.when(F.size("best") > k, -F.get("best", F.lit(k))["s"]).otherwise(F.lit(float("-inf")))
    found = begun
    if visited > first_lists:
        tightened = questions.join(begun.select("point", floor.alias("floor")), "point", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = begun.unionByName(visit(tightened.select("point", "raw", "floor").mapInArrow(probing(True), schema)))
    top = found.groupBy("point").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    # The best k + 1 of each question: a query's own id may be one of them.
    ranked = asked.select("point", "query_id").join(top, "point").select("query_id", F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
