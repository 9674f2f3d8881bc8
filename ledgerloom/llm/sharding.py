"""Reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Groups in which rows are numbered before the groups' offsets are added.
GROUPS = 4096
#: Copies of one row that a task writes at a time.
RUN = 4096
ROUNDS = 8
#: A prime below 2^31: products of two residues stay within a long.
PRIME = 2147483647


def radices(n: int) -> tuple[int, int]:
    """a * b >= n with a near the root of n and as little excess as can be found.

    The walk leaves [0, n) for at most a * b - n steps in a row, so the excess
    is a proven bound of the walk's length.
    """
    if n <= 3:
        return 2, max(1, math.ceil(n / 2))
    root = math.isqrt(n)
    low = max(2, root // 2)
    a = min(range(root, low - 1, -1), key=lambda x: (-n % x, -x))
    return a, -(-n // a)


def _mixed(value: Column, k: Column) -> Column:
    """A round function: residues of a quadratic with the round's numbers."""
    t = F.pmod(F.pmod(value, F.lit(PRIME)) * k["m"] + k["c"], F.lit(PRIME))
    return F.pmod(t * t + t * F.pmod(k["m"], F.lit(65_537)) + k["c"], F.lit(PRIME))


def permuted(x: Column, n: int, key: int) -> Column:
    """The place of row number ``x`` among ``n`` under the permutation of ``key``."""
    a, b = radices(n)
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")
    rounds = []
    for r in range(ROUNDS):
        m = (key * 1_000_003 + r * 7_919 + 12_345) % (PRIME - 1) + 1
        c = (key * 69_621 + r * 104_729 + 54_321) % PRIME
        rounds.append(F.struct(F.lit(r % 2 == 0).alias("left"), F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")))

    def step(s: Column, k: Column) -> Column:
        left = F.when(k["left"], F.pmod(s["l"] + _mixed(s["r"], k), la)).otherwise(s["l"])
        right = F.when(k["left"], s["r"]).otherwise(F.pmod(s["r"] + _mixed(s["l"], k), lb))
        return F.struct(left.alias("l"), right.alias("r"))

    def once(v: Column) -> Column:
        halves = F.struct(F.floor(v / lb).cast("long").alias("l"), F.pmod(v, lb).alias("r"))
        return F.aggregate(F.array(*rounds), halves, step, lambda s: s["l"] * lb + s["r"])

    first = once(x.cast("long"))
    excess = a * b - n
    if excess == 0:
        return first
    steps = F.sequence(F.lit(1), F.lit(excess))
    return F.aggregate(steps, first, lambda y, _: F.when(y < F.lit(n), y).otherwise(once(y)))


def shard(docs: DataFrame, shards: int = 8, key: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows dealt into ``shards`` shards; the law is ``rows``: their counts differ by one at most.

    Columns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless
    from 0 in each shard), grown_shard (null: this law moves rows when a shard is
    added), row_number.  A row's shard is its permuted number modulo ``shards`` and
    its slot the quotient, so both can be computed, and inverted, without the data.

    The global number: rows are grouped by a hash of (id, size, crc), numbered in
    each group in that order, and the groups' offsets added.  It depends on the rows
    alone, not on files, partitions or retries.  Rows equal in all three are counted
    before the shuffle and numbered as a run, which is written out in parts of RUN, so
    repeats meet in no task.  A null
    text is empty (size 1, crc 0), a null id is a value as any other, an empty table
    gives an empty result, and other columns are not looked at.
    """
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    counted = cut(counted.withColumn("group", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(GROUPS)).cast("int")))
    # At most GROUPS rows reach the driver and are broadcast.
    totals = sorted((r["group"], r.total) for r in counted.groupBy("group").agg(F.sum("copies").alias("total")).collect())
    offsets, n = [], 0
    for group, total in totals:
        offsets.append((group, n))
        n += total
    offsets = docs.sparkSession.createDataFrame(offsets, "group int, offset long")
    inside = Window.partitionBy("group").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    numbered = counted.withColumn("first", F.sum("copies").over(inside) - F.col("copies")).join(F.broadcast(offsets), "group").withColumn("first", F.col("first") + F.col("offset"))
    # A row of many copies is cut into runs, which are dealt over the tasks before they are written out.
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long")))
    many = numbered.where(F.col("copies") > RUN).withColumn("run", runs).select("doc_id", "size", "text_crc32", (F.col("first") + F.col("run")).alias("first"), F.least(F.col("copies") - F.col("run"), F.lit(RUN)).alias("copies"))
    many = many.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "first")
    few = numbered.where(F.col("copies") <= RUN).select("doc_id", "size", "text_crc32", "first", "copies")
    single = few.unionByName(many).withColumn("row_number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    place = permuted(F.col("row_number"), max(n, 1), key)
    return single.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
