"""The pipeline's stages: each decision takes effect on what the one before kept."""

import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, rows, labels, at, extra=False):
    docs = spark.createDataFrame(rows, COLUMNS)
    if extra:  # columns that clash with those of the stages
        from pyspark.sql import functions as F

        docs = docs.withColumns({c: F.lit("x") for c in ("row", "score", "window", "text_key", "stays", "salt", "maybe")})
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")


def test_stages(spark, texts, tmp_path):
    rng = random.Random(9)
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]
    rows += [(1000 + i, " ".join(rng.choice(["idiot", "moron", "scum", "stone", "light", "green"]) for _ in range(20)), "en", "s1", 0) for i in range(60)]
    base = texts[39][1]
    # Null ids, one id with two texts, and texts in no language that was learned.
    rows += [(None, base + " more", "en", "s0", 0), (None, "quite another thing that is said here only once", "en", None, 0), (38, "one more text of the same id that is like no other text", "en", "s2", 0)]
    rows += [(37, texts[37][1], "en", "s1", len(texts[37][1]))]
    rows += [(2000, "日本語の文章はここにありますがラテン文字は一つもありません", None, "s1", 0), (2001, "Ελληνικά κείμενα χωρίς λατινικά γράμματα καθόλου", None, "s1", 0)]
    labels = [(i, 1, int(1000 <= i < 2000)) for i, *_ in rows if i is not None]
    written(spark, rows, labels, tmp_path, extra=True)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {name: {i for i, _ in rows} for name, rows in kept.items()}
    assert {300, 301, 302, 2000, 2001}.isdisjoint(ids["language_id"]) and set(range(1, 40)) <= ids["language_id"]
    assert max(i or 0 for i in ids["toxicity"]) < 1000 and set(range(1, 40)) <= ids["toxicity"]
    deduplicated = kept["near_duplicates"]
    assert set(range(1, 40)) <= ids["near_duplicates"] and {101, 102, 200, 201}.isdisjoint(ids["near_duplicates"]) and 100 in ids["near_duplicates"]
    assert Counter(i for i, _ in deduplicated)[37] == 1  # a repeated row stays once
    assert Counter(i for i, _ in deduplicated)[38] == 2  # two texts of one id go their own ways
    assert [t for i, t in deduplicated if i is None] == ["quite another thing that is said here only once"]
    assert Counter(kept["mixing"]) == Counter(deduplicated)
    assert Counter(r.doc_id for r in docs.where("piece = 0").collect()) == Counter(i for i, _ in deduplicated)


def brute_near_duplicates(rows):
    from test_operators import brute_links

    some = [(i if i is not None else 10**9 + k, t) for k, (i, t) in enumerate(rows)]
    _, classes = brute_links(some)
    first = {}
    for (i, t), c in sorted(zip(some, classes, strict=True)):
        first.setdefault(c, i)
    return {c for c in first.values()}


def test_near_duplicates_against_all_pairs(spark, texts, tmp_path):
    rows = [(i, t) for i, t in texts if i != 305]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(got) == sorted(brute_near_duplicates(rows))


def test_packing_follows_the_mix(spark, tmp_path):
    """Each sequence holds documents of one stretch of slots, and each stretch has the sources in their weights."""
    from ledgerloom.llm.mixing import tempered

    rows = [(i, f"text number {i} " * 20, "en", "hot" if i % 10 else "rare", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, COLUMNS)
    corpus_pipeline.mixing(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    from pyspark.sql import functions as F

    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    home = {r.doc_id: r.f for r in mixed.select("doc_id", F.col("_metadata.file_name").alias("f")).collect()}
    packed = corpus_pipeline.packing(spark, mixed, str(tmp_path)).collect()
    sequences = defaultdict(set)
    for r in packed:
        sequences[r.sequence_id].add(home[r.doc_id])
    assert len(set(home.values())) > 1 and all(len(s) == 1 for s in sequences.values())
    order = [next(iter(sequences[k])) for k in sorted(sequences)]
    assert order == sorted(order)
    weights = tempered({"hot": 3600, "rare": 400})
    first = Counter("hot" if i % 10 else "rare" for i, f in home.items() if f == min(home.values()))
    assert abs(first["rare"] / sum(first.values()) - weights["rare"] / sum(weights.values())) < 0.05


def test_run_on_empty_tables(spark, tmp_path):
    written(spark, [], [], tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_one_stage_behind(spark, texts, tmp_path):
    import os

    written(spark, [(i, t, "en", "s", 0) for i, t in texts[:50]], [(i, 1, 0) for i, _ in texts[:20]], tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 40
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    left = [sorted(os.listdir(f"{shared}/{d}")) for d in os.listdir(shared) if d.startswith("pipeline-")]
    assert left and all(stages == ["mixing"] for stages in left)
