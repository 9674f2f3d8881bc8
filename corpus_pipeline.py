"""A corpus pipeline of five operators over ``documents``.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``; the last returns packed pieces.  Texts are whole, and no stage drops
a row but by its own decision: language ID drops texts in which no learned language can
be told, toxicity drops those it predicts toxic, the join all but the first row of
each group of near duplicates.  Mixing drops none: it deals the rows into files, each
of which is a stretch of the mix, and packing puts together only what one file holds.

Null ids, null texts, repeated rows and empty tables are defined in each stage; columns
other than those of ``documents`` are not looked at and not passed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if its best cosine is not so many deviations above that of unrelated vectors.
LEAST_DEVIATIONS = 2.5
#: A document is rejected as toxic from this score on.
TOXIC_FROM = 0.5
#: Rows of one block of a source in the mix.
BLOCK_ROWS = 16


def _fold(k: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(k))


def _back(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row")[c].alias(c) for c in COLUMNS])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which a learned language can be told.

    Unrelated vectors of D dimensions have cosines of deviation 1 / sqrt(D): a text whose
    best cosine is within chance of them is in no language that was learned.  Null
    texts and texts without letters go; null ids and repeated rows are rows as any
    other; without any labelled text nothing can be told and nothing stays.
    """
    from ledgerloom.llm.language_id import DIMENSIONS, UNKNOWN, identify, train

    found = identify(docs, train(docs.where(_fold(4) != 2)), keep=COLUMNS)
    return _back(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > LEAST_DEVIATIONS / DIMENSIONS**0.5)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that aren't predicted toxic; labels of the training folds only are learned from.

    Null texts and ids and repeated rows are scored as any other; without labels the
    built-in weights decide.
    """
    from ledgerloom.llm.toxicity import score, train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(5) != 0)
    return _back(score(docs, train(docs, labels), keep=COLUMNS).where(F.col("score") < TOXIC_FROM))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: that of the smallest id (null last), then of the smallest text key.

    Decided by row: of rows with one id but different texts each goes its own way, and of
    rows with the same id and text the smallest row stays.
    """
    from ledgerloom.llm.common import cut, id_bitmap, text_key, text_of, with_maybe
    from ledgerloom.llm.jaccard_join import linked_rows

    linked = cut(linked_rows(docs, threshold=0.8, ngram=5).where("n_links > 0").select("doc_id", "text_key", "root"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    firsts = linked.groupBy("root").agg(F.min(place).alias("first"))
    keys = linked.groupBy("doc_id", "text_key").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("copies"))
    stays = (F.col("first.text_key") == F.col("text_key")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    # Rows that go, and repeated ones of which one stays.
    marks = cut(keys.join(firsts, "root").select("doc_id", "text_key", stays.alias("stays"), "copies").where("not stays or copies > 1"))
    rows = docs.select(*COLUMNS, text_key(text_of("text")).alias("text_key"))
    # Most texts surely have no mark: only the others are looked up in a shuffle.
    maybe = with_maybe(rows, id_bitmap(marks, "text_key"), "text_key")
    certain = maybe.where(~F.col("maybe")).select(*COLUMNS)
    m = marks.select(F.col("doc_id").alias("mark_id"), F.col("text_key").alias("mark_key"), "stays")
    on = (F.col("text_key") == F.col("mark_key")) & F.col("doc_id").eqNullSafe(F.col("mark_id"))
    looked_up = maybe.where("maybe").join(m, on, "left")
    kept = certain.unionByName(looked_up.where("stays is null").select(*COLUMNS))
    if not marks.where("stays").isEmpty():
        once = looked_up.where("stays").groupBy("doc_id", "text_key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
        kept = kept.unionByName(_back(once))
    return kept


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt into files: each is one stretch of slots of the mix, ordered by slot.

    Target weights: the roots of the sources' sizes, in thousandths.
    """
    from ledgerloom.llm.mixing import mix, source_counts, tempered

    counts = source_counts(docs)
    mixed = mix(docs, tempered(counts), block_rows=BLOCK_ROWS, keep=COLUMNS)
    slots = max(1, sum(-(-n // BLOCK_ROWS) for n in counts.values()))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("block_slot") * files / slots).cast("int")
    return _back(mixed.repartitionById(files, stretch).sortWithinPartitions("block_slot", "place_in_block"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences as best fit finds within each stretch of the mix.

    A stretch is a file that mixing wrote; sequences are numbered in the mix's order.
    """
    import public_tokenizers

    from ledgerloom.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, max_tokens=2048, window=F.col("_metadata.file_name"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written to the shared folder and read again.

    A stage's rows are removed when the next one's are written; the last ones stay, for
    the result reads them.
    """
    from ledgerloom.llm.common import shared_folder

    at = f"{spark.sparkContext.getCheckpointDir() or shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            _remove(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
