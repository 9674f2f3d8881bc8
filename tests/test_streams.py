"""Links and components of streams against those of whole tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.operators.components import connected_components
from ledgerloom.streaming.groups import StoredComponents
from ledgerloom.streaming.links import dropped_late, links_by_day


def components(nodes, pairs):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in nodes}


def test_components_by_batch(spark, tmp_path):
    """Any split, batches repeated, and one that failed before its last table: as of all edges at once."""
    rng = random.Random(3)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(75)] + [(None, 4), (95, 95)]
    expected = components({x for e in edges if None not in e for x in e}, [e for e in edges if None not in e])
    whole = {r.node: r.component for r in connected_components(spark.createDataFrame([e for e in edges if None not in e], "a long, b long")).collect()}
    assert whole == {n: c for n, c in expected.items() if n in whole}
    stored = StoredComponents(spark, str(tmp_path / "c"))
    for n, (at, end) in enumerate([(0, 20), (20, 21), (21, 21), (21, 50), (50, 77)]):
        batch = spark.createDataFrame(edges[at:end], "a long, b long")
        stored.add(batch, n)
        if n == 1:
            stored.add(batch, n)
        if n == 3:  # its nodes are lost, its merges are there
            spark.createDataFrame([], "node long, label long").write.mode("overwrite").parquet(str(tmp_path / "c" / "members" / "batch=3"))
            stored.add(batch, n)
        so_far = [e for e in edges[:end] if None not in e]
        assert {r.node: r.component for r in stored.current(spark).collect()} == components({x for e in so_far for x in e}, so_far)
    assert stored.current(spark).count() == len(expected)


def drained(spark, df, path, batches, days, late):
    """Links of ``df`` read in so many batches in order of ``n``, and the query's progress."""
    for k in batches:
        df.where(f"batch = {k}").drop("batch").coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    found = links_by_day(stream, ["user"], days=days, late=late)
    q = found.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "state")).outputMode("append").start()
    q.processAllAvailable()
    progress = q.recentProgress
    q.stop()
    return spark.read.schema(found.schema).parquet(str(path / "out")), progress


def test_links_by_day(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"r{i:03d}", f"u{rng.randrange(2)}", 86400 * (100 + i // 8) + 3600 * rng.randrange(24), rng.choice([99, 100, 101, 199, 200, 250, 251, -1, 0]), i // 40) for i in range(120)]
    rows += [(None, "u0", 86400 * 100, 99, 0), ("x", "u0", None, 99, 0), ("y", "u0", 86400 * 100, None, 0)]
    df = spark.createDataFrame(rows, "record_id string, user string, s long, cents long, batch int").withColumn("ts", F.col("s").cast("timestamp")).drop("s")
    got, progress = drained(spark, df, tmp_path, range(3), 3, "20 days")
    got = [(r.record_id, r.of, r.gap) for r in got.collect()]
    expected, first = [], {}
    for k in range(3):
        for name, user, s, cents, _ in sorted((r for r in rows if r[4] == k and None not in r), key=lambda r: (r[2], r[0])):
            for (u, c, d), of in first.items():
                if u == user and abs(c - cents) <= 1 and abs(d - s // 86400) <= 3:
                    expected.append((name, of, abs(d - s // 86400)))
            first.setdefault((user, cents, s // 86400), name)
    assert sorted(got) == sorted(expected) and len(got) > 100 and dropped_late(progress) == 0
    # The links' components are those of all linked pairs.
    good = [r for r in rows if None not in r]
    pairs = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[1] == b[1] and abs(a[3] - b[3]) <= 1 and abs(a[2] // 86400 - b[2] // 86400) <= 3]
    names = {r[0] for r in good}
    assert components(names, [(a, b) for a, b, _ in got]) == components(names, pairs)


def test_hot_amount_keeps_one_record_a_day(spark, tmp_path):
    """30,000 records of one amount in two batches, then one that is late: each has at most a link a day, and the late one is counted."""
    hot = spark.range(30_000).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("record_id"), F.lit("u").alias("user"), (F.lit(86400 * 200) + F.col("id") * 20).cast("timestamp").alias("ts"), F.lit(550).cast("long").alias("cents"), (F.col("id") / 15_000).cast("int").alias("batch"))
    late = spark.createDataFrame([("z", "u", 86400 * 100, 550, 3), ("zz", "u", 86400 * 206, 550, 2)], "record_id string, user string, s long, cents long, batch int").select("record_id", "user", F.col("s").cast("timestamp").alias("ts"), "cents", "batch")
    got, progress = drained(spark, hot.unionByName(late), tmp_path, range(4), 1, "2 days")
    assert got.groupBy("record_id").count().agg(F.max("count")).first()[0] <= 3
    assert got.where("record_id in ('z')").count() == 0 and dropped_late(progress) == 1
    assert got.where("record_id like 'r%'").select("record_id").distinct().count() == 29_999


def test_calls_do_not_grow_with_amounts(spark, tmp_path):
    """3,000 groups of amounts and users, null keys among them, are dealt to at most 16 states, with the links that any other number of states gives."""
    kinds = "record_id string, user long, batch int, cents long, day int"
    rng = random.Random(5)
    rows = [(f"r{i:04d}", rng.choice([None, 2**60 + 1, 2**60 + 2]), i // 2000, rng.choice([k * 100 + e for k in range(1000) for e in (-1, 0, 50)]), rng.randrange(3)) for i in range(4000)]
    df = spark.createDataFrame(rows, kinds).withColumn("ts", ((F.col("day") + 100) * 86400).cast("timestamp")).drop("day")
    found = {}
    for states in (16, 1000):
        path = tmp_path / str(states)
        for k in range(2):
            df.where(f"batch = {k}").drop("batch").coalesce(1).write.mode("append").parquet(str(path / "in"))
        stream = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
        linked = links_by_day(stream, ["user"], days=1, late="9 days", states=states)
        q = linked.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "state")).start()
        q.processAllAvailable()
        kept = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
        q.stop()
        assert kept <= states
        found[states] = sorted(tuple(r) for r in spark.read.schema(linked.schema).parquet(str(path / "out")).select("record_id", F.coalesce("user", F.lit(0)), "cents", "of", "gap").collect())
    by_id = {r[0]: r for r in rows}
    assert found[16] == found[1000] and len(found[16]) > 500
    expected, first = [], {}
    for name, user, _, cents, day in sorted(rows, key=lambda r: (r[2], r[4], r[0])):
        for c in (-1, 0, 1):
            for d in (-1, 0, 1):
                of = first.get((user, cents + c, day + d))
                if of:
                    expected.append((name, user or 0, cents, of, abs(d)))
        first.setdefault((user, cents, day), name)
    assert found[16] == sorted(expected) and all(by_id[r[0]][1] == by_id[r[3]][1] for r in found[16])
