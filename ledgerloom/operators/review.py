"""Human review: a log of edits, its latest state, and what is exported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def initial_events(enriched: DataFrame) -> DataFrame:
    """The first event of every record: its defaults."""
    return enriched.select("record_id", F.lit(0).cast("long").alias("seq"), F.col("date_default").alias("date"), F.col("amount_default").cast("decimal(18,2)").alias("amount"), F.col("confirm_default").alias("confirmed"), F.lit(False).alias("deleted"))


def latest_state(events: DataFrame) -> DataFrame:
    """The state after the last event of each record; an event's null fields keep what was before."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy("record_id").agg(*map(last, ("date", "amount", "confirmed", "deleted")), F.max("seq").alias("seq"))


def transition(records: DataFrame, kind: str, seq: int) -> DataFrame:
    """Events that delete, restore, confirm or reopen the given records (record_id)."""
    known = {"delete": (None, True), "restore": (None, False), "confirm": (True, None), "reopen": (False, None)}
    confirmed, deleted = known[kind]
    return records.select("record_id", F.lit(seq).cast("long").alias("seq"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("decimal(18,2)").alias("amount"), F.lit(confirmed).cast("boolean").alias("confirmed"), F.lit(deleted).cast("boolean").alias("deleted"))


def export_rows(state: DataFrame, only_confirmed: bool = False) -> DataFrame:
    """Rows to export: not deleted, confirmed if asked, with a date or an amount."""
    date = F.when(F.trim(F.coalesce("date", F.lit(""))) != "", F.trim("date"))
    kept = state.where(~F.coalesce("deleted", F.lit(False))).withColumn("invoice_date", date)
    if only_confirmed:
        kept = kept.where(F.coalesce("confirmed", F.lit(False)))
    return kept.where(F.col("invoice_date").isNotNull() | F.col("amount").isNotNull()).select("record_id", "invoice_date", F.col("amount").alias("total_incl_tax"))


def counters(state: DataFrame) -> DataFrame:
    """total, confirmed, deleted and left."""
    live = ~F.coalesce("deleted", F.lit(False))
    return state.agg(F.count(F.lit(1)).alias("total"), F.count_if(live & F.coalesce("confirmed", F.lit(False))).alias("confirmed"), F.count_if(~live).alias("deleted"), F.count_if(live & ~F.coalesce("confirmed", F.lit(False))).alias("left"))


def review_colour(records: DataFrame) -> DataFrame:
    """Add colour: red for low or incomplete records, yellow for medium ones."""
    incomplete = F.col("invoice_date").isNull() | F.col("total_incl_tax").isNull()
    return records.withColumn("colour", F.when((F.col("confidence") == "low") | incomplete, "red").when(F.col("confidence") == "medium", "yellow"))


def replace_split(records: DataFrame, parent_id: str, children: DataFrame) -> DataFrame:
    """Records with one of them replaced by the records of its parts."""
    return records.where(F.col("record_id") != parent_id).unionByName(children, allowMissingColumns=True)


def bands(width: int, height: int, parts: int, overlap: float = 0.02) -> list[tuple[int, int, int, int]]:
    """Overlapping bands of a crop along its longer side: x0, y0, x1, y1."""
    long, tall = (height, True) if height >= width else (width, False)
    extra = int(long * overlap)
    out = []
    for i in range(max(1, parts)):
        a, b = max(0, long * i // parts - extra), min(long, long * (i + 1) // parts + extra)
        out.append((0, a, width, b) if tall else (a, 0, b, height))
    return out


def neighbours(state: DataFrame, order: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """Previous and next record that is not deleted, around each in order; within ``keys`` if given.

    Without keys the rows are dealt into ranges of the order, numbered and looked up
    across their borders, so no task has them all.  ``order`` must tell rows apart.
    """
    if keys:
        at = Window.partitionBy(*keys).orderBy(order)
        return state.withColumn("previous_id", F.lag("record_id").over(at)).withColumn("next_id", F.lead("record_id").over(at))
    count = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(state.repartitionByRange(count, order).withColumn("range", F.spark_partition_id()))
    at = Window.partitionBy("range").orderBy(order)
    inside = ranged.withColumn("previous_id", F.lag("record_id").over(at)).withColumn("next_id", F.lead("record_id").over(at))
    # As many rows as ranges.
    ends = sorted(ranged.groupBy("range").agg(F.min_by("record_id", order).alias("first"), F.max_by("record_id", order).alias("last")).collect())
    before = {b["range"]: a["last"] for a, b in zip(ends, ends[1:], strict=False)}
    after = {a["range"]: b["first"] for a, b in zip(ends, ends[1:], strict=False)}
    kind = state.schema["record_id"].dataType
    known = lambda found: F.element_at(F.create_map(*[F.lit(x) for pair in found.items() for x in pair]), F.col("range")).cast(kind) if found else F.lit(None).cast(kind)
    return inside.select(*state.columns, F.coalesce("previous_id", known(before)).alias("previous_id"), F.coalesce("next_id", known(after)).alias("next_id"))
