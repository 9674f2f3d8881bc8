"""Token counts of whole texts, from batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, released, text_of
from .encoding import by_bytes, encoder_of


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``tokenizer_path`` is a byte-level BPE file of tokenizers (.json) or a model of
    sentencepiece (.model).  No begin, end or other special tokens are added and
    nothing is truncated.  A null text counts as empty (0 bytes, 0 tokens), a null
    id stays null, repeated rows are counted each on their own, an empty table
    gives an empty result, and other columns are not looked at.

    No shuffle: batches are cut by bytes on their way to the workers and again
    there; long texts, of whatever white space, are split at the encoder's safe
    boundaries.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)

            def encode(texts: list[str]) -> list[int]:
                return [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            encode = encoder_of(tokenizer_path, keep_ids=False).encode
        for batch in batches:
            texts = batch.column("text")
            n_bytes = pa.compute.binary_length(texts.cast(pa.binary()))
            strings = texts.to_pylist()
            counts: list[int] = []
            for a, b in by_bytes(strings):
                counts += encode(strings[a:b])
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes.cast(pa.int64()), tokens, pa.compute.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401  (binds pa.compute)

    return rows.mapInArrow(released(run), f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
