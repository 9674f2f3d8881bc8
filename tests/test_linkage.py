"""Linkage verdicts, groups, consensus and review."""

from decimal import Decimal

import pytest

from ledgerloom.config import LinkSettings
from ledgerloom.operators import consensus, linkage, review
from ledgerloom.operators.components import connected_components
from ledgerloom.schema import RECORD

RECORD = RECORD.replace("ord struct<file_id:string,page_no:int,region_no:int,part:int>", "ord long")  # a batch of plain records is numbered
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def make(spark, rows):
    data = []
    for i, r in enumerate(rows):
        base = dict.fromkeys(NAMES) | {"record_id": f"r{i}", "ord": i, "file_id": "f", "page_no": 1, "region_no": i, "source_file": f"s{i}", "doc_kind": "invoice", "invoice_type": "western", "confidence": "medium", "notes": [], "date_candidates": []} | r
        for k in ("subtotal", "tax", "tip", "total_incl_tax", "printed_total"):
            base[k] = None if base[k] is None else Decimal(str(base[k]))
        if base["invoice_date"] and not base["date_candidates"]:
            base["date_candidates"] = [base["invoice_date"]]
        data.append(tuple(base[n] for n in NAMES))
    return spark.createDataFrame(data, RECORD)


def inv(total, date=None, **more):
    return {"total_incl_tax": total, "invoice_date": date, **more}


def slip(total, date=None, **more):
    return {"total_incl_tax": total, "invoice_date": date, "doc_kind": "card_slip", **more}


CASES = {
    "L1": (inv(100, "2026-03-07"), slip(100.01, "2026-03-07"), "dup"),
    "L2": (inv(100), slip(100, "2026-03-07"), "dup"),
    "L3": (inv(100), inv(100, "2026-03-07"), "suspect"),
    "L4": (inv(100, "2026-03-07"), slip(120, "2026-03-07"), "dup"),
    "L5": (inv(120, "2026-03-07", printed_total=100), slip(100, "2026-03-07"), "dup"),
    "L6": (inv(100, "2026-03-07"), slip(120, "2026-03-09"), "suspect_gap"),
    "L7": (inv(100, "2026-03-07"), slip(136, "2026-03-07"), None),
    "L8": (inv(100, "2026-03-07", date_candidates=["2026-03-07", "2026-07-03"]), slip(100, "2026-07-03"), "dup"),
    "L10": (inv(100, "2026-03-07"), inv(100, "2026-03-09"), None),
}


@pytest.mark.parametrize("name", CASES)
def test_verdicts(spark, name):
    a, b, expected = CASES[name]
    found = linkage.link_pairs(make(spark, [a, b])).collect()
    assert [r.verdict for r in found] == ([expected] if expected else [])


def test_near_rows_meet_in_one_or_two_bands(spark):
    from pyspark.sql import functions as F

    for width, reach in ((7, 3), (linkage.CENTS_BAND, 1)):
        found = spark.range(-40, 40).select("id", linkage._bands(F.col("id"), width, reach).alias("bands"), linkage._bands(F.col("id"), width, 0).alias("own")).collect()
        own = {r.id: r.own[0] for r in found}
        for r in found:
            assert len(r.own) == 1 and len(r.bands) <= 2
            assert set(r.bands) >= {own[k] for k in range(r.id - reach, r.id + reach + 1) if k in own}
        assert sum(len(r.bands) for r in found) < 2 * len(found)


def test_blocking_is_complete(spark):
    import random

    rng = random.Random(5)
    days = [None, "2026-03-05", "2026-03-06", "2026-03-09", "2026-02-31"]
    rows = [rng.choice([inv, slip])(rng.choice([100, 100.01, 100.02, 120, 134.99, 135, 136]), rng.choice(days), printed_total=rng.choice([None, 100, 100.01])) for _ in range(60)]
    df = make(spark, rows)
    for tolerance in (0, 2):
        got = {(r.a, r.b, r.verdict) for r in linkage.link_pairs(df, tolerance).collect()}
        keys = linkage._keys(df, "ord", [])
        left = keys.toDF(*[f"l_{c}" for c in keys.columns])
        right = keys.toDF(*[f"r_{c}" for c in keys.columns])
        brute = left.join(right, left.l_id < right.r_id).withColumn("verdict", linkage.verdict(tolerance)).where("verdict is not null")
        assert got == {(r.l_id, r.r_id, r.verdict) for r in brute.collect()}


def test_deduplicate(spark):
    rows = [inv(100, "2026-03-07"), slip(120, "2026-03-07"), inv(50), slip(50, "2026-03-01"), slip(9, "2026-03-02"), inv(70), inv(70, "2026-03-03")]
    out = {r.ord: r for r in linkage.deduplicate(make(spark, rows)).collect()}
    assert sorted(out) == [0, 2, 4, 5, 6]
    assert (out[0].total_incl_tax, out[0].slip_verified, out[0].confidence) == (Decimal("120.00"), True, "medium")
    assert (out[2].invoice_date, out[2].confidence) == ("2026-03-01", "high")
    assert out[4].notes == ["slip_alone"]
    assert out[5].notes == ["suspect -1 s6"] and out[5].confidence == "medium"
    marked = linkage.deduplicate(make(spark, rows), LinkSettings(mode="mark"))
    assert {r.ord for r in marked.where("confidence = 'low'").collect()} == {1, 3}
    with pytest.raises(ValueError):
        LinkSettings(mode="other")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert set(found.values()) == {0, 100} and len(found) == 33
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    """A chain of 600 nodes in no order, and a star: as they are joined, in few rounds."""
    import random

    from ledgerloom.operators import components

    names = random.Random(1).sample(range(10**9), 700)
    edges = list(zip(names[:600], names[1:600])) + [(names[600], x) for x in names[601:]]
    cuts = []
    whole = components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or whole(df))
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: min(names[:600]) for x in names[:600]} | {x: min(names[600:]) for x in names[600:]}
    assert len(cuts) <= 2 + 2 * 14


def test_rounds_of_components_shrink(spark, monkeypatch):
    """A chain of 300 names in order: what all rounds write is a few times the nodes, not all nodes for each round."""
    from ledgerloom.operators import components

    names = [f"n{k:03d}" for k in range(300)]
    written = []
    whole = components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append((done := whole(df)).count()) or done)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")).collect()}
    assert found == dict.fromkeys(names, "n000")
    assert sum(written) <= 12 * 300



@pytest.mark.parametrize(
    ("dates", "expected"),
    [
        (["2026-03-05", "2026-03-06", "2026-03-07", "2020-03-06"], ("2026-03-06", "low")),
        (["2026-01-02", "2026-01-03", "2026-01-04", "2025-12-30"], ("2025-12-30", "low")),
        (["2026-01-02", "2025-12-30"], ("2025-12-30", "medium")),
        (["2024-01-02", "2025-01-02", "2026-01-02"], ("2026-01-02", "medium")),
    ],
)
def test_years(spark, dates, expected):
    out = consensus.repair_years(make(spark, [inv(i + 1, d) for i, d in enumerate(dates)])).orderBy("ord").collect()
    assert (out[-1].invoice_date, out[-1].confidence) == expected


def test_review(spark):
    rows = [inv(1, "2026-01-01", confidence="high"), inv(2, "2026-01-01"), inv(3), inv(4, date_candidates=["2026-02-02"]), inv(None, "2026-01-05", confidence="high")]
    enriched = consensus.enrich_review(make(spark, rows))
    out = enriched.orderBy("ord").collect()
    assert [r.status for r in out] == ["ok", "review", "missing", "missing", "missing"]
    assert [(r.date_default, r.date_guess_src) for r in out[2:4]] == [("2026-01-01", "page"), ("2026-02-02", "candidate")]
    events = review.initial_events(enriched)
    ids = enriched.where("ord = 0").select("record_id")
    state = review.latest_state(events.unionByName(review.transition(ids, "delete", 1)))
    assert review.counters(state).first().asDict() == {"total": 5, "confirmed": 0, "deleted": 1, "left": 4}
    assert review.export_rows(state).count() == 4 and review.export_rows(state, True).count() == 0
    tips = {r.ord: r.suggestions for r in consensus.date_suggestions(make(spark, rows)).collect()}
    assert tips[3][0] == "2026-02-02" and tips[2][0] == "2026-01-01"


def test_a_hot_reading_links_in_bounded_lists(spark):
    """20,000 records of one amount, day and kind, and 20,000 undated ones: no pairs of records are made."""
    from pyspark.sql import functions as F

    few = make(spark, [inv(100, "2026-03-07"), slip(100, "2026-03-07"), inv(55)])
    many = few.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19999)))).where("ord <> 1 or k < 3")
    many = many.withColumn("ord", F.col("ord") * 100000 + F.col("k")).withColumn("source_file", F.concat("source_file", F.lit("-"), F.col("k").cast("string"))).drop("k")
    done = linkage.deduplicate(many, LinkSettings(mode="mark"))
    groups = {r.component: r["count"] for r in done.groupBy("component").count().where("count > 1").collect()}
    assert groups == {0: 20003}
    first = done.where("ord = 0").first()
    assert first.notes == ["merged s0-19999(invoice) +19998, s1-0(card_slip) +2", "slip_verified"] and first.confidence == "high"
    lone = {r.ord: r for r in done.where("ord in (200000, 200001)").collect()}
    assert lone[200000].notes == ["suspect -1 s2-19999 +19998"] and lone[200001].notes == ["suspect -1 s2-0 +19998"]
    assert lone[200001].component == 200001 and lone[200001].confidence == "medium"


def test_undated_records_are_joined_by_another_class(spark):
    rows = [inv(70), inv(70), slip(70, "2026-03-03"), inv(70)]
    marked = linkage.deduplicate(make(spark, rows), LinkSettings(mode="mark")).orderBy("ord").collect()
    assert [r.component for r in marked] == [0, 0, 0, 0]
    assert not any(n.startswith("suspect") for r in marked for n in r.notes)


def test_records_known_by_structs(spark):
    from pyspark.sql import functions as F

    df = make(spark, [inv(100, "2026-03-07"), slip(120, "2026-03-07"), inv(3)]).withColumn("ord", F.struct("file_id", "ord"))
    out = linkage.deduplicate(df).orderBy("ord").collect()
    assert [r.ord.ord for r in out] == [0, 2] and [r.component.ord for r in out] == [0, 2]


def test_neighbours_across_ranges(spark):
    state = spark.createDataFrame([(f"r{i}", (i * 37) % 101) for i in range(101)], "record_id string, seq long").repartition(5)
    order = sorted(((i * 37) % 101, f"r{i}") for i in range(101))
    expected = {r: (order[k - 1][1] if k else None, order[k + 1][1] if k < 100 else None) for k, (_, r) in enumerate(order)}
    assert {r.record_id: (r.previous_id, r.next_id) for r in review.neighbours(state).collect()} == expected
    one = review.neighbours(state.withColumn("k", F_lit(spark)), keys=["k"])
    assert {r.record_id: (r.previous_id, r.next_id) for r in one.collect()} == expected


def F_lit(spark):
    from pyspark.sql import functions as F

    return F.lit(1)


@pytest.mark.parametrize("seed", [1, 2])
def test_transactions_without_pairs(spark, seed):
    """Components of the few edges are those of all pairs that are dup by the verdict itself."""
    import random

    rng = random.Random(seed)
    days = [None, "2026-03-05", "2026-03-06", "2026-03-09", "2026-03-12", "2026-02-31"]
    kinds = [inv, inv, slip, lambda t, d, **m: inv(t, d, **m | {"doc_kind": None})]
    amount = lambda: rng.choice([100, 100.01, 100.02, 110, 134.99, 135, 136]) if rng.random() < 0.3 else rng.randrange(1, 90_000) / 100
    rows = []
    for _ in range(70):
        total, day = amount(), rng.choice(days)
        printed = rng.choice([None, None, total, amount(), round(total / 1.2, 2)])
        several = {"date_candidates": rng.sample(days[1:], 2)} if rng.random() < 0.2 else {}
        rows.append(rng.choice(kinds)(total, day, printed_total=printed, **several))
    rows += [inv(None, "2026-03-05"), slip(0, "2026-03-05"), inv(0, "2026-03-05"), inv(-5, "2026-03-06")]
    df = make(spark, rows)
    for tolerance in (0, 2):
        keys = linkage._keys(df, "ord", [])
        left, right = keys.toDF(*[f"l_{c}" for c in keys.columns]), keys.toDF(*[f"r_{c}" for c in keys.columns])
        brute = left.join(right, left.l_id < right.r_id).where(linkage.verdict(tolerance) == "dup").select("l_id", "r_id").collect()
        root = list(range(len(rows)))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in brute:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        found = {r.id: r.component for r in linkage.transactions(df, tolerance).collect()}
        assert found == {x: top(x) for x in range(len(rows))}


def test_a_day_of_many_amounts_has_few_edges(spark):
    """60,000 bills and slips of different amounts on one day: about one edge each, where pairs would be hundreds of millions."""
    from pyspark.sql import functions as F

    few = make(spark, [inv(100, "2026-03-07"), slip(100, "2026-03-07")])
    many = few.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29999)))).withColumn("ord", F.col("ord") + 2 * F.col("k"))
    many = many.withColumn("total_incl_tax", (F.lit(100000) + F.col("k") * 7 + F.col("ord") % 2 * 3).cast("decimal(18,2)") / 100).drop("k")
    classes = linkage._classes(linkage._keys(many, "ord", []), [])
    assert linkage.duplicate_edges(classes, 0, []).count() <= 4 * 60_000
    assert {r.component for r in linkage.transactions(many).select("component").distinct().collect()} == {0}


def test_bounded_notes(spark):
    """A reading with 3,000 suspected peers, and a group of 3,000 readings: the first are named, the rest counted."""
    from pyspark.sql import functions as F

    few = make(spark, [inv(55), inv(55, "2026-03-07"), inv(80, "2026-03-07")])
    many = few.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2999)))).where("ord > 0 or k = 0")
    many = many.withColumn("date_candidates", F.when(F.col("ord") == 1, F.array(F.date_add(F.lit("2026-03-07"), F.col("k")).cast("string"))).otherwise(F.col("date_candidates")))
    many = many.withColumn("printed_total", F.when(F.col("ord") == 2, F.col("k").cast("decimal(18,2)")))
    many = many.withColumn("ord", F.col("ord") * 10000 + F.col("k")).withColumn("source_file", F.concat(F.lit("s"), F.col("ord").cast("string"))).drop("k")
    done = linkage.deduplicate(many, LinkSettings(mode="mark", most_named=5))
    lone = done.where("ord = 0").first()
    assert lone.notes == [f"suspect -1 s{10000 + k}" for k in range(5)] + ["suspect +2995"]
    head = done.where("ord = 20000").first()
    assert head.notes == ["merged " + ", ".join(f"s{20000 + k}(invoice)" for k in range(1, 6)) + ", +2994"]
    plan = linkage._first_of(many.select("ord", "doc_kind"), "doc_kind", "ord", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
