"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of one Arrow batch sent to a Python worker: bounds its memory
#: however long the texts are.
ARROW_BATCH_BYTES = 4 << 20
#: Spark's own bound, as its configuration writes it.
DEFAULT_BATCH_BYTES = f"{64 << 20}b"


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes, unless the session sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a worker gives unused memory back: it waits for the next stage beside those of other operators."""

    def inner(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return inner


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """16 bytes by which equal texts are known."""
    return F.unhex(F.md5(F.encode(text, "utf-8")))


def beside_text(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """Rows (row, text): the kept columns as one struct, so that no name can clash, and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(text_column).alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a machine-local one only where Spark runs on one machine."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or tempfile.mkdtemp(prefix="checkpoints-")


#: Words of 64 bits in an id bitmap; its size never depends on the data.
BITMAP_WORDS = 1 << 17


def _place(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP_WORDS * 64))


def id_bitmap(ids: DataFrame, name: str) -> DataFrame:
    """At most BITMAP_WORDS rows (word, bits): a one-hash Bloom filter of the ids."""
    at = _place(F.col(name))
    return (
        ids.select(F.shiftright(at, 6).alias("bitmap_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({name}), {BITMAP_WORDS * 64}L) & 63 as int))").alias("bit"))
        .groupBy("bitmap_word")
        .agg(F.bit_or("bit").alias("bitmap_bits"))
    )


def with_maybe(df: DataFrame, bitmap: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``maybe``: false only where the id is surely not among those of the bitmap.

    The broadcast side has at most BITMAP_WORDS rows of 16 bytes.
    """
    at = _place(F.col(name))
    return (
        df.withColumn("bitmap_word", F.shiftright(at, 6))
        .withColumn("bitmap_at", (at.bitwiseAND(63)).cast("int"))
        .join(F.broadcast(bitmap), "bitmap_word", "left")
        .withColumn("maybe", F.coalesce(F.expr("(shiftrightunsigned(bitmap_bits, bitmap_at) & 1) = 1"), F.lit(False)))
        .drop("bitmap_word", "bitmap_at", "bitmap_bits")
    )
