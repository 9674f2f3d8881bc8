"""Connected components of edges that come batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.lineage import cut


class StoredComponents:
    """Labels of a growing graph in a folder that driver and executors share.

    Two tables, in a part for each batch: ``members`` (node, label: the component the node
    was in after its first batch) and ``merges`` (label, onto: components that a later
    edge has made one).  A batch writes its own new nodes and merges and rewrites no
    label of another, so what it writes grows with its edges; what it reads of the rest
    is nodes and labels, once.  It reads only parts of earlier batches and replaces its
    own, so a batch that is run again, after a failure in the middle too, changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str = "long") -> None:
        self.folder, self.kind = folder, kind
        for name, columns in (("members", "node {0}, label {0}"), ("merges", "label {0}, onto {0}")):
            spark.createDataFrame([], columns.format(kind)).write.mode("ignore").parquet(f"{folder}/{name}/batch=-1")

    def _parts(self, spark: SparkSession, name: str, before: int | None) -> DataFrame:
        columns = {"members": "node {0}, label {0}", "merges": "label {0}, onto {0}"}[name].format(self.kind)
        found = spark.read.schema(f"{columns}, batch long").parquet(f"{self.folder}/{name}")
        return (found if before is None else found.where(F.col("batch") < before)).drop("batch")

    def _roots(self, spark: SparkSession, before: int | None) -> DataFrame:
        """(label, root) of labels that have been merged."""
        return connected_components(self._parts(spark, "merges", before), "label", "onto").select(F.col("node").alias("label"), F.col("component").alias("root"))

    def add(self, edges: DataFrame, batch: int, left: str = "a", right: str = "b") -> None:
        """Take in the edges of one batch; batches come in ascending order, the last one may be repeated.

        An edge with a null end is none; one from a node to itself makes the node known.
        """
        spark = edges.sparkSession
        pairs = cut(edges.select(F.col(left).cast(self.kind).alias("a"), F.col(right).cast(self.kind).alias("b")).where("a is not null and b is not null").distinct())
        touched = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = touched.join(self._parts(spark, "members", batch), "node", "left")
        placed = cut(known.join(self._roots(spark, batch), "label", "left").select("node", "label", F.coalesce("root", "label", "node").alias("root")))
        end = lambda c: placed.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        between = pairs.join(end("a"), "a").join(end("b"), "b").where("ra <> rb").select("ra", "rb")
        joined = connected_components(between, "ra", "rb").select(F.col("node").alias("root"), "component")
        old = placed.where("label is not null").select("root").distinct()
        merges = joined.where("root <> component").join(old, "root").select(F.col("root").alias("label"), F.col("component").alias("onto"))
        merges.write.mode("overwrite").parquet(f"{self.folder}/merges/batch={batch}")
        new = placed.where("label is null").join(joined, "root", "left").select("node", F.coalesce("component", "root").alias("label"))
        new.write.mode("overwrite").parquet(f"{self.folder}/members/batch={batch}")

    def current(self, spark: SparkSession) -> DataFrame:
        """(node, component): for every node seen the smallest one reachable from it by the edges of all batches."""
        members = self._parts(spark, "members", None)
        return members.join(self._roots(spark, None), "label", "left").select("node", F.coalesce("root", "label").alias("component"))
