"""Records of one transaction: exact blocking, verdicts, groups and their survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SUSPECT_GAP_DAYS, TIP_RATIO_PERCENT, LinkSettings
from .components import connected_components
from .lineage import cut

#: Cents of a band in which equal amounts meet.
CENTS_BAND = 4


def date_set(candidates: Column, single: Column) -> Column:
    """Distinct legal dates of a record's readings, or of its one date if it has no others."""
    given = F.when(F.size(candidates) > 0, candidates).otherwise(F.array(single))
    return F.array_distinct(F.array_compact(F.transform(given, lambda d: F.try_to_date(d, "yyyy-MM-dd"))))


def gap_days(a: Column, b: Column) -> Column:
    """Days between the nearest two dates of two sets; -1 if one is empty."""
    gaps = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(F.datediff(x, y)))))
    return F.coalesce(F.array_min(gaps), F.lit(-1))


def dates_match(a: Column, b: Column, days: int) -> Column:
    """Whether two date sets come within so many days; null if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(None).cast("boolean")).otherwise(gap_days(a, b) <= days)


def _keys(records: DataFrame, id_column: str, scope: list[str]) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    found = records.where(F.col("total_incl_tax").isNotNull())
    return found.select(F.col(id_column).alias("id"), *scope, F.col("doc_kind").alias("kind"), cents("total_incl_tax").alias("cents"), cents("printed_total").alias("printed"), date_set(F.col("date_candidates"), F.col("invoice_date")).alias("dates"))


def verdict(tolerance: int) -> Column:
    """dup, suspect, suspect_gap or null for a pair whose columns are prefixed l_ and r_."""
    exact = F.abs(F.col("l_cents") - F.col("r_cents")) <= 1
    cross = F.array_sort(F.array("l_kind", "r_kind")) == F.array(F.lit("card_slip"), F.lit("invoice"))
    cross = F.coalesce(cross, F.lit(False))
    left = F.col("l_kind") == "invoice"
    invoice = F.when(left, F.col("l_cents")).otherwise(F.col("r_cents"))
    printed = F.when(left, F.col("l_printed")).otherwise(F.col("r_printed"))
    slip = F.when(left, F.col("r_cents")).otherwise(F.col("l_cents"))
    tip_on_card = (invoice < slip) & (slip * 100 <= invoice * TIP_RATIO_PERCENT)
    tip_in_cash = F.coalesce((F.abs(slip - printed) <= 1) & (slip < invoice) & (invoice * 100 <= slip * TIP_RATIO_PERCENT), F.lit(False))
    close = dates_match(F.col("l_dates"), F.col("r_dates"), tolerance)
    near = F.coalesce(dates_match(F.col("l_dates"), F.col("r_dates"), SUSPECT_GAP_DAYS), F.lit(False))
    equal = F.when(close, "dup").when(close.isNull(), F.when(cross, "dup").otherwise("suspect")).when(cross & near, "suspect_gap")
    unequal = F.when(cross & (tip_on_card | tip_in_cash), F.when(F.coalesce(close, F.lit(False)), "dup").when(near, "suspect_gap"))
    return F.when(exact, equal).otherwise(unequal)


def _classes(keys: DataFrame, scope: list[str]) -> DataFrame:
    """One row for all records that read alike: reading, id (the smallest), n.

    Records of one reading have the same verdict with any other record, so classes
    are compared, however many records share an amount on one day.
    """
    reading = F.struct(*scope, "kind", "cents", "printed", F.array_sort("dates").alias("dates")).alias("reading")
    found = keys.select("id", reading).groupBy("reading").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return found.select("id", "n", "reading", "reading.*")


def _band(cents: str) -> Column:
    """Amounts of one band differ by less than the ratio of a tip; those that may be a bill and its slip are of one band or two neighbouring ones."""
    return F.floor(F.log(F.greatest(F.col(cents), F.lit(1)).cast("double")) / F.log(F.lit(TIP_RATIO_PERCENT / 100)))


def _bands(of: Column, width: int, reach: int) -> Column:
    """The one or two bands of so many values that hold all values up to ``reach`` away; a band is wider than twice that."""
    return F.array_distinct(F.array(F.floor((of - reach) / width), F.floor((of + reach) / width)))


def _class_pairs(classes: DataFrame, tolerance: int, scope: list[str]) -> DataFrame:
    """(a, b, verdict, gap) of classes a < b with a verdict, by three exact blockings."""
    days = max(tolerance, SUSPECT_GAP_DAYS)
    left = classes.select(*scope, *[F.col(c).alias(f"l_{c}") for c in ("id", "kind", "cents", "printed", "dates")])
    right = classes.select(*scope, *[F.col(c).alias(f"r_{c}") for c in ("id", "kind", "cents", "printed", "dates")])
    around = lambda c, n: F.explode(F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda k: F.col(c) + k))
    # Days and cents by bands, as wide as what is looked for: a row is in one or two of each, not in one for every day and cent around it.
    on_days = lambda dates, reach: F.explode(F.array_distinct(F.flatten(F.transform(dates, lambda d: _bands(F.unix_date(d), 2 * days + 1, reach)))))
    left_day, right_day = left.withColumn("days", on_days("l_dates", days)), right.withColumn("days", on_days("r_dates", 0))
    about = F.explode(_bands(F.col("l_cents"), CENTS_BAND, 1))
    apart = F.abs(F.col("l_cents") - F.col("r_cents"))
    # Equal amounts, both dated.
    dated = left_day.withColumn("cents", about).join(right_day.withColumn("cents", F.floor(F.col("r_cents") / CENTS_BAND)), [*scope, "cents", "days"]).where(apart <= 1).drop("cents", "days")
    # Equal amounts, one without a date: on either side.
    undated = left.where(F.size("l_dates") == 0).withColumn("cents", around("l_cents", 1)).join(right.withColumn("cents", F.col("r_cents")), [*scope, "cents"]).drop("cents")
    undated_right = left.where(F.size("l_dates") > 0).withColumn("cents", around("l_cents", 1)).join(right.where(F.size("r_dates") == 0).withColumn("cents", F.col("r_cents")), [*scope, "cents"]).drop("cents")
    # Unequal amounts of different kinds, on near days: a tip on the card by band of the ratio, one in cash by the printed total.
    bills, slips = left_day.where("l_kind = 'invoice'"), right_day.where("r_kind = 'card_slip'")
    tip = (F.col("l_cents") < F.col("r_cents")) & (F.col("r_cents") * 100 <= F.col("l_cents") * TIP_RATIO_PERCENT)
    on_card = bills.withColumn("band", F.explode(F.array(_band("l_cents"), _band("l_cents") + 1))).join(slips.withColumn("band", _band("r_cents")), [*scope, "days", "band"]).where(tip).drop("days", "band")
    in_cash = bills.where("l_printed is not null").withColumn("cents", around("l_printed", 1)).join(slips.withColumn("cents", F.col("r_cents")), [*scope, "cents", "days"]).drop("cents", "days")
    unequal = on_card.unionByName(in_cash).where(apart > 1)
    every = dated.unionByName(undated).unionByName(undated_right).where(F.col("l_id") < F.col("r_id")).unionByName(unequal)
    judged = every.withColumn("verdict", verdict(tolerance)).where(F.col("verdict").isNotNull())
    # A pair may meet in several bands.
    return judged.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), "verdict", gap_days(F.col("l_dates"), F.col("r_dates")).alias("gap")).distinct()


def duplicate_edges(classes: DataFrame, tolerance: int, scope: list[str]) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of classes with the verdict dup, but no more than a few for each class.

    Classes of one day and amount are one transaction, so each is tied to the smallest of
    its cell only, and cells to the cells beside them.  Undated bills and slips of about
    one amount are tied to one of the other kind, and that one to all of these.  The
    slips that a bill with its tip may stand for are one range of sorted amounts: a sweep
    puts the bill in one run with the first slip of its range, and a slip with the next one
    if a range holds both; a run is tied to its smallest member, so that no chain as long as
    a day is left.  Sweeps run by scope, day and band over different amounts, not records.
    """
    known = classes
    for c in scope:
        known = known.where(F.col(c).isNotNull())
    known = known.select(*scope, "id", "kind", "cents", "printed", "dates")
    cell = [*scope, "day", "cents"]
    dated = known.withColumn("day", F.explode("dates")).drop("dates")
    only = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("id")))
    cells = cut(dated.groupBy(*cell).agg(F.min("id").alias("least"), only("invoice").alias("bill"), only("card_slip").alias("slip")))
    own = dated.join(cells, cell).select(F.col("id").alias("a"), F.col("least").alias("b"))
    steps = [(0, k) for k in range(1, tolerance + 1)] + [(1, k) for k in range(-tolerance, tolerance + 1)]
    beside = F.explode(F.array(*[F.struct(F.lit(c).alias("cents"), F.lit(k).alias("days")) for c, k in steps]))
    shifted = cells.withColumn("step", beside).select(*scope, F.date_add("day", F.col("step.days")).alias("day"), (F.col("cents") + F.col("step.cents")).alias("cents"), F.col("least").alias("a"))
    next_to = shifted.join(cells, cell).select("a", F.col("least").alias("b"))
    # Without a date: bills and slips only.
    around = lambda c: F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)]))
    either = known.where(F.col("kind").isin("invoice", "card_slip")).withColumn("other", F.when(F.col("kind") == "invoice", "card_slip").otherwise("invoice"))
    first = lambda rows, name: rows.groupBy(*scope, "cents", F.col("kind").alias("other")).agg(F.min("id").alias(name))
    bare = either.where(F.size("dates") == 0)
    asking = lambda rows: rows.select(*scope, "other", F.col("id").alias("a"), around("cents").alias("cents"))
    # All bills and slips ask here, so those without a date are told to the cents beside theirs.
    to_bare = either.select(*scope, "other", F.col("id").alias("a"), "cents").join(first(bare, "b").withColumn("cents", around("cents")), [*scope, "cents", "other"]).select("a", "b")
    from_bare = asking(bare).join(first(either, "b"), [*scope, "cents", "other"]).select("a", "b")
    # A tip on the card: slips from a cent more up to the ratio.
    days = F.explode(F.array(*[F.date_add("day", F.lit(k)) for k in range(-tolerance, tolerance + 1)]))
    ranges = cells.where("bill is not null and cents > 0").select(*scope, days.alias("day"), (F.col("cents") + 1).alias("at"), F.floor(F.col("cents") * TIP_RATIO_PERCENT / 100).cast("long").alias("upto"), F.col("bill").alias("id")).where("at <= upto")
    ranges = ranges.withColumn("band", F.explode(F.sequence(_band("at"), _band("upto")))).withColumn("is_slip", F.lit(False))
    points = cells.where("slip is not null").select(*scope, "day", F.col("cents").alias("at"), F.lit(None).cast("long").alias("upto"), F.col("slip").alias("id"), _band("cents").alias("band"), F.lit(True).alias("is_slip"))
    swept = Window.partitionBy(*scope, "day", "band")
    rising, falling = swept.orderBy("at", "is_slip"), swept.orderBy(F.desc("at"), F.desc("is_slip"))
    following = F.last(F.when(F.col("is_slip"), F.col("at")), ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.when(F.col("is_slip"), F.max("upto").over(rising.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("upto"))
    sweep = ranges.unionByName(points).withColumn("following", following).withColumn("tied", F.coalesce(F.col("following") <= reach, F.lit(False)))
    # Slips tied to the next one, and the bills tied to any of these, are one run: all its members are tied to its smallest.
    run = F.count(F.when(F.col("is_slip") & ~F.col("tied"), 1)).over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = sweep.withColumn("run", run).where(F.col("is_slip") | F.col("tied"))
    on_card = runs.withColumn("least", F.min("id").over(Window.partitionBy(*scope, "day", "band", "run"))).select(F.col("id").alias("a"), F.col("least").alias("b")).where("a <> b")
    # A tip in cash: the slip says what is printed.
    bills = dated.where("kind = 'invoice' and printed is not null").withColumn("total", F.col("cents")).withColumn("day", days).withColumn("cents", around("printed"))
    fits = (F.col("cents") < F.col("total")) & (F.col("total") * 100 <= F.col("cents") * TIP_RATIO_PERCENT)
    in_cash = bills.where(fits).join(cells.where("slip is not null").select(*cell, "slip"), cell).select(F.col("id").alias("a"), F.col("slip").alias("b"))
    every = own.unionByName(next_to).unionByName(to_bare).unionByName(from_bare).unionByName(on_card).unionByName(in_cash)
    return every.where("a <> b").distinct()


def transactions(records: DataFrame, tolerance: int = 0, id_column: str = "ord", scope: list[str] | None = None) -> DataFrame:
    """(id, component): the smallest id of the records that are one transaction with this one, by any chain of dup verdicts.

    No pairs are written, so records without a scope may all fall on one day.  Records
    without a total, and those with no other one, are alone and their own component.
    """
    scope = scope or []
    keys = _keys(records, id_column, scope)
    classes = cut(_classes(keys, scope))
    found = connected_components(duplicate_edges(classes, tolerance, scope)).select(F.col("node").alias("class"), "component")
    joint = classes.join(found, F.col("id") == F.col("class"), "left").select("reading", F.coalesce("component", F.when(F.size("dates") > 0, F.col("id"))).alias("component"))
    reading = F.struct(*scope, "kind", "cents", "printed", F.array_sort("dates").alias("dates"))
    placed = keys.select("id", reading.alias("reading")).join(joint, "reading").select("id", "component")
    every = records.select(F.col(id_column).alias("id")).join(placed, "id", "left")
    return every.select("id", F.coalesce("component", "id").alias("component"))


def _within(classes: DataFrame) -> tuple[Column, Column]:
    """Verdict and gap of two records of one class: one transaction if dated, else suspected."""
    dated = F.size("dates") > 0
    return F.when(dated, "dup").otherwise("suspect"), F.when(dated, F.lit(0)).otherwise(F.lit(-1))


def link_pairs(records: DataFrame, tolerance: int = 0, id_column: str = "ord", scope: list[str] | None = None) -> DataFrame:
    """(a, b, verdict, gap) of all pairs a < b with a verdict, never by comparing all pairs.

    Records that read alike are one class; classes meet in three exact blockings,
    which together hold every pair that can have a verdict: both dated and equal to
    the cent or one off, by (amount, day); one without a date and equal, by amount;
    unequal ones of different kinds, by (day, ratio band).  Pairs of classes are then
    written out for their records, which is what is asked for here; ``deduplicate``
    needs no pairs of records.
    """
    scope = scope or []
    keys = _keys(records, id_column, scope)
    classes = cut(_classes(keys, scope))
    pairs = _class_pairs(classes, tolerance, scope)
    reading = F.struct(*scope, "kind", "cents", "printed", F.array_sort("dates").alias("dates"))
    members = keys.select(F.col("id").alias("member"), reading.alias("reading")).join(classes.select("reading", "id", "n"), "reading").select("member", "id", "n", F.col("reading.dates").alias("dates"))
    left, right = members.select(F.col("member").alias("l"), F.col("id").alias("a")), members.select(F.col("member").alias("r"), F.col("id").alias("b"))
    across = pairs.join(left, "a").join(right, "b").select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "verdict", "gap")
    kind, gap = _within(classes)
    several = members.where("n > 1").select(F.col("member").alias("l"), F.col("id").alias("b"), kind.alias("verdict"), gap.alias("gap"))
    inside = several.join(right, "b").where("l < r").select(F.col("l").alias("a"), F.col("r").alias("b"), "verdict", "gap")
    return across.unionByName(inside)


def near_equal(rows: DataFrame, days: int, id_column: str, cents: str, day: str, scope: list[str]) -> DataFrame:
    """(a, b), a < b: rows of one scope a cent and so many days apart at most, whatever else they say.

    Neighbouring cents are enumerated, so it is an equi-join.
    """
    left = rows.select(F.col(id_column).alias("a"), *scope, F.col(day).alias("da"), F.explode(F.array(*[F.col(cents) + k for k in (-1, 0, 1)])).alias("cents"))
    right = rows.select(F.col(id_column).alias("b"), *scope, F.col(day).alias("db"), F.col(cents).alias("cents"))
    return left.join(right, [*scope, "cents"]).where((F.col("a") < F.col("b")) & (F.abs(F.datediff("da", "db")) <= days)).select("a", "b")


def _note(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _first_of(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The ``most`` rows of each key that come first: tasks keep no more than these of a key before they meet, and salted groups no more again."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(64)))
    for by in ([key, "salt"], [key]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("place") <= most).drop("place")
    return salted.drop("salt")


def priority() -> Column:
    """Order of a group's members: the smallest survives."""
    rank = lambda c, names: F.coalesce(*[F.when(F.col(c) == n, F.lit(i)) for i, n in enumerate(names)], F.lit(names.index("card_slip") if "card_slip" in names else 2))
    fields = sum((F.col(c).isNotNull().cast("int") for c in ("subtotal", "tax", "tip", "invoice_date")), F.lit(0))
    return F.struct(rank("doc_kind", ["invoice", "card_slip"]).alias("kind"), rank("invoice_type", ["vat", "western", "unknown"]).alias("type"), rank("confidence", ["high", "medium", "low"]).alias("confidence"), (-fields).alias("fields"), F.col("ord").alias("ord"))


def deduplicate(records: DataFrame, settings: LinkSettings = LinkSettings(), scope: list[str] | None = None) -> DataFrame:
    """Records with those of one transaction merged (skip) or marked (mark).

    Adds ``component`` (smallest ord of the group), ``is_primary`` and slip_verified.
    Suspected pairs are noted and lose confidence first, so that this counts in the
    choice of survivors.  A group takes its largest total and a slip's date.  Notes
    name each reading once, with the number of further records that read alike; beyond
    ``settings.most_named`` readings the first are named and the rest's records counted.
    """
    if not settings.enabled:
        return records.withColumn("component", F.col("ord")).withColumn("is_primary", F.lit(True)).withColumn("slip_verified", F.lit(False))
    scope = scope or []
    reading = F.struct(*scope, "kind", "cents", "printed", F.array_sort("dates").alias("dates"))
    keys = _keys(records, "ord", scope).select(F.col("id").alias("ord"), reading.alias("reading"))
    files = records.select("ord", "source_file")
    classes = cut(_classes(_keys(records, "ord", scope), scope))
    pairs = cut(_class_pairs(classes, settings.date_tolerance_days, scope).where("verdict <> 'dup'"))
    found = connected_components(duplicate_edges(classes, settings.date_tolerance_days, scope)).select(F.col("node").alias("id"), "component")
    # Records of a dated reading are one transaction; those of an undated one only by way of another class.
    joint = classes.join(found, "id", "left").withColumn("joined", (F.size("dates") > 0) | F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "id"))
    ends = keys.join(files, "ord").groupBy("reading").agg(F.min_by("source_file", "ord").alias("first_file"), F.max_by("source_file", "ord").alias("last_file"))
    joint = cut(joint.join(ends, "reading").select("reading", "id", "n", "component", "joined", "first_file", "last_file"))
    placed = keys.join(joint, "reading").select("ord", F.col("id").alias("class"), F.when(F.col("joined"), F.col("component")).otherwise(F.col("ord")).alias("component"))
    grouped = records.join(placed, "ord", "left").withColumn("component", F.coalesce("component", "ord"))
    # Suspects within one group have been confirmed otherwise; classes not joined are groups of one each.
    side = lambda i: joint.select(F.col("id").alias(i), F.col("component").alias(f"c{i}"), F.col("joined").alias(f"j{i}"), F.col("n").alias(f"n{i}"), F.col("first_file").alias(f"f{i}"))
    apart = ~(F.col("ja") & F.col("jb") & (F.col("ca") == F.col("cb")))
    open_pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(apart)
    told = lambda own, peer: open_pairs.select(F.col(own).alias("class"), F.col(peer).alias("peer"), "verdict", "gap", F.col(f"f{peer}").alias("file"), F.col(f"n{peer}").alias("n"))
    both = told("a", "b").unionByName(told("b", "a"))
    more = F.when(F.col("n") > 1, F.concat(F.lit("+"), (F.col("n") - 1).cast("string")))
    # One note for each of the first readings that are suspected, with the number of further records that read so.
    readings = both.select("class", "peer", F.concat_ws(" ", "verdict", F.col("gap").cast("string"), "file", more).alias("text"), "n")
    named = _first_of(readings, "class", "peer", settings.most_named).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("peer", "text", "n"))).alias("named"))
    rest = readings.groupBy("class").agg(F.count(F.lit(1)).alias("readings"), F.sum("n").alias("peers"))
    further = F.when(F.col("readings") > F.size("named"), F.array(F.concat(F.lit("suspect +"), (F.col("peers") - F.aggregate("named", F.lit(0).cast("long"), lambda x, s: x + s["n"])).cast("string")))).otherwise(F.array().cast("array<string>"))
    suspected = named.join(rest, "class").select("class", F.concat(F.transform("named", lambda s: s["text"]), further).alias("others"))
    alike = joint.where((F.col("n") > 1) & ~F.col("joined")).select(F.col("id").alias("class"), "first_file", "last_file", "n")
    suspected = suspected.join(alike, "class", "full")
    peer = F.when(F.col("ord") == F.col("class"), F.col("last_file")).otherwise(F.col("first_file"))
    same = F.when(F.col("n").isNotNull(), F.array(F.concat_ws(" ", F.lit("suspect -1"), peer, F.when(F.col("n") > 2, F.concat(F.lit("+"), (F.col("n") - 2).cast("string"))))))
    none = F.array().cast("array<string>")
    suspected = placed.join(suspected, "class").select("ord", F.concat(F.coalesce("others", none), F.coalesce(same, none)).alias("suspects"))
    noted = grouped.join(suspected, "ord", "left").withColumn("notes", F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.coalesce("suspects", F.array().cast("array<string>"))))
    noted = noted.withColumn("confidence", F.when(F.col("suspects").isNotNull() & (F.col("confidence") != "low"), "medium").otherwise(F.col("confidence")))
    # Groups, their notes and their facts are taken of the same rows: joined once.
    noted = cut(noted.withColumn("priority", priority()))
    cents = F.round(F.col("total_incl_tax") * 100).cast("long")
    slip = F.col("doc_kind") == "card_slip"
    # Members that read alike are told once, with their number: a list grows with the readings of a group, not with its records.
    alike = noted.groupBy("component", "class", "doc_kind").agg(F.min("priority").alias("first"), F.max("priority").alias("last"), F.min_by("source_file", "priority").alias("file"), F.max_by("source_file", "priority").alias("other"), F.count(F.lit(1)).alias("n"))
    # The survivor's own reading comes first, so it is always among those that are named.
    told_of = _first_of(alike.select("component", "first", "file", "other", "doc_kind", "n"), "component", "first", settings.most_named + 1)
    lists = told_of.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("first", "file", "other", "doc_kind", "n"))).alias("every"), F.sum("n").alias("told"))
    lists = lists.join(alike.groupBy("component").agg(F.count(F.lit(1)).alias("readings"), F.sum("n").alias("all")).where("all > 1"), "component")
    shown = lambda name, kind, n: F.concat(name, F.lit("("), F.coalesce(kind, F.lit("")), F.lit(")"), F.when(n > 1, F.concat(F.lit(" +"), (n - 1).cast("string"))).otherwise(F.lit("")))
    head = F.get("every", F.lit(0))
    others = F.transform(F.slice("every", F.lit(2), F.greatest(F.size("every") - 1, F.lit(0))), lambda m: shown(m["file"], m["doc_kind"], m["n"]))
    own = F.when(head["n"] > 1, F.array(shown(head["other"], head["doc_kind"], head["n"] - 1))).otherwise(none)
    left_out = F.when(F.col("readings") > F.size("every"), F.array(F.concat(F.lit("+"), (F.col("all") - F.col("told")).cast("string")))).otherwise(none)
    lists = lists.select("component", F.array_join(F.concat(own, others, left_out), ", ").alias("merged"), head["file"].alias("primary_file"))
    facts = noted.groupBy("component").agg(
        F.min("priority").alias("first"),
        F.count(F.lit(1)).alias("members"),
        F.max("total_incl_tax").alias("best_total"),
        (F.max(cents) - F.min(cents)).alias("spread"),
        (F.max(slip.cast("int")) + F.max((F.col("doc_kind") == "invoice").cast("int")) == 2).alias("verified"),
        F.min_by("invoice_date", F.when(slip & F.col("invoice_date").isNotNull(), F.col("priority"))).alias("slip_date"),
    )
    facts = facts.join(lists, "component", "left")
    joined = noted.join(facts, "component").withColumn("is_primary", F.col("priority") == F.col("first"))
    many, lead = F.col("members") > 1, F.col("is_primary")
    takes_date = many & lead & (F.col("doc_kind") != "card_slip") & F.col("slip_date").isNotNull()
    takes_total = many & lead & F.col("best_total").isNotNull() & ~F.col("total_incl_tax").eqNullSafe(F.col("best_total"))
    verified = many & lead & F.col("verified")
    alone = ~many & slip & F.col("suspects").isNull()
    notes = F.array_compact(
        F.array(
            F.when(alone, F.lit("slip_alone")),
            F.when(many & lead, _note("merged", F.col("merged"))),
            F.when(takes_total, _note("total_of_group", F.col("best_total"), F.coalesce(F.col("total_incl_tax").cast("string"), F.lit("-")))),
            F.when(verified, F.when(F.col("spread") <= 1, F.lit("slip_verified")).otherwise(F.lit("slip_verified_without_tip"))),
            F.when(takes_date & ~F.col("invoice_date").eqNullSafe(F.col("slip_date")), _note("date_of_slip", F.col("slip_date"), F.coalesce("invoice_date", F.lit("-")))),
            F.when(many & ~lead, _note("duplicate_of", F.col("primary_file"))),
        )
    )
    done = (
        joined.withColumn("notes", F.concat("notes", notes))
        .withColumn("confidence", F.when(many & ~lead, "low").when(verified & (F.col("spread") <= 1), "high").otherwise(F.col("confidence")))
        .withColumn("total_incl_tax", F.when(takes_total, F.col("best_total")).otherwise(F.col("total_incl_tax")))
        .withColumn("invoice_date", F.when(takes_date, F.col("slip_date")).otherwise(F.col("invoice_date")))
        .withColumn("slip_verified", verified)
    )
    if settings.mode == "skip":
        done = done.where("is_primary")
    return done.select(*[c for c in records.columns if c != "slip_verified"], "slip_verified", "component", "is_primary")
