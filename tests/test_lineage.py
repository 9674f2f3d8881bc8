"""What is written out is joined by sorting; costly rows are dealt by their number."""

from pyspark.sql import functions as F

from ledgerloom.operators.lineage import cut, spread


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checkpoint_is_not_sent_through_the_driver(spark):
    # The estimate of an exploded table is that of what it was exploded from.
    wide = cut(spark.range(1000).select("id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k")))
    for joined in (wide.join(spark.range(10_000_000).withColumnRenamed("id", "k"), "k"), wide.withColumn("j", F.explode(F.array("k", "id"))).where("j > 3").join(wide.select("id", F.col("k").alias("l")), "id")):
        assert "Broadcast" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)


def test_asked_for_broadcast_stays(spark):
    few = cut(spark.range(3))
    assert "BroadcastHashJoin" in plan_of(spark.range(1000).join(F.broadcast(few), "id"))


def test_tasks_grow_with_rows_not_what_they_hold(spark):
    few, many = spark.range(0, 4000, 1, 4), spark.range(0, 400_000, 1, 4)
    assert spread(few, rows=10_000).rdd.getNumPartitions() == 4
    assert spread(many, rows=10_000).rdd.getNumPartitions() == 40
    sizes = spread(many.select((F.col("id") / 4).cast("long").alias("page"), "id"), "page", rows=10_000).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("pages")).collect()
    assert max(r.n for r in sizes) < 12_000 and sum(r.pages for r in sizes) == 100_000
