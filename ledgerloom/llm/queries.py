"""The operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_documents(spark, sf_dir), shards=8)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(_documents(spark, sf_dir))


def _remainder(k: int) -> Column:
    """crc32 of the id as text, modulo ``k``: the fold a document belongs to."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(k))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(_documents(spark, sf_dir), threshold=0.8, ngram=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(5) != 0)
    return score(docs, train(docs, labels)).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, source_counts, tempered

    docs = _documents(spark, sf_dir)
    # Target weights: the roots of the sources' sizes.
    return mix(docs, tempered(source_counts(docs)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    docs = _documents(spark, sf_dir)
    prototypes = train(docs.where(_remainder(4) != 2))
    return identify(docs, prototypes).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_documents(spark, sf_dir))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), _tokenizer(), end_id=0, max_tokens=2048)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir), _tokenizer(), limit=1024)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance_sample

    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_sample(_documents(spark, sf_dir), target, percent=25, seed=7, max_n=2, buckets=10_000, least_words=20)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the texts, by a hash of the id, the words from one on repeat a stretch of the words there.

    The words are numbered from 0.  A null id and a text without words stay as they are.
    """
    mark = F.crc32(F.col("doc_id").cast("string"))
    words, n = F.col("words"), F.size("words")
    g = F.floor(mark / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    repeated = F.transform(words, lambda _, i: F.element_at(words, (F.when(i < a, i).otherwise(a + F.pmod(i - a, p)) + 1).cast("int")))
    chosen = (F.pmod(mark, F.lit(10)) == 0) & (n > 0)
    split = F.when(F.pmod(mark, F.lit(10)) == 0, F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return docs.select("doc_id", "text", split.alias("words")).select("doc_id", F.when(chosen, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import longest_run, periodic_runs

    found = periodic_runs(with_repeats(_documents(spark, sf_dir)), least=12)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", longest_run(F.col("runs"))).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_documents(spark, sf_dir), radius=2, shingle=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_document_fingerprints": op2_document_fingerprints,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_toxicity": op4_toxicity,
        "op5_mixing": op5_mixing,
        "op6_language_id": op6_language_id,
        "op7_license_scans": op7_license_scans,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_token_counts": op10_token_counts,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_simhash_near_dedup": op13_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {}
