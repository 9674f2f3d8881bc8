"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds its
letters' vectors, permuted by place (rotated twice, once and not at all) and
multiplied; a text's vector bundles (adds) its trigrams'; a language's prototype
bundles the unit vectors of its training texts.  A text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_text, bound_batches, released

DIMENSIONS = 1024
SEED = 20_240_229
UNKNOWN = "und"
#: Trigram vectors held by a worker (1 KB each); at the bound it starts anew.
MEMORY_TRIGRAMS = 60_000
#: Bits of a code point: a trigram is three of them in one number.
_BITS = 21


def _letter_table() -> np.ndarray:
    """Symbol of each code point of the basic plane: the lower-case letter, or 32 for all else."""
    out = np.full(1 << 16, 32, dtype=np.uint64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


def _high_symbol(c: str) -> int:
    """The same for a letter beyond the basic plane: its own code point, in lower case."""
    return (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 32


class Encoder:
    """Texts as bundles of trigram vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.table = _letter_table()
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((0, dimensions), dtype=np.int8)

    def letter(self, symbol: int) -> np.ndarray:
        found = self.letters.get(symbol)
        if found is None:
            bits = np.random.default_rng([self.seed, symbol]).integers(0, 2, self.dimensions, dtype=np.int8)
            found = self.letters[symbol] = (2 * bits - 1).astype(np.int8)
        return found

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the trigrams of letters, words bounded by one space; empty if no letter."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        high = points >= 1 << 16
        symbols = self.table[np.where(high, 32, points)]
        if high.any():
            different, place = np.unique(points[high], return_inverse=True)
            symbols[high] = np.array([_high_symbol(chr(p)) for p in different.tolist()], dtype=np.uint64)[place]
        symbols = np.concatenate(([32], symbols, [32])).astype(np.uint64)
        space = symbols == 32
        symbols = symbols[~(space & np.append(False, space[:-1]))]
        if len(symbols) < 3:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        codes = (symbols[:-2] << np.uint64(2 * _BITS)) | (symbols[1:-1] << np.uint64(_BITS)) | symbols[2:]
        return np.unique(codes, return_counts=True)

    def _known(self, codes: list[int]) -> list[int]:
        rows = list(map(self.rows.get, codes))
        if None in rows:
            new = [c for c, r in zip(codes, rows, strict=True) if r is None]
            if len(self.rows) + len(new) > max(MEMORY_TRIGRAMS, len(codes)):
                self.rows.clear()
                new = codes
            if len(self.rows) + len(new) > len(self.vectors):
                grown = np.empty((max(2 * len(self.vectors), len(self.rows) + len(new), 4096), self.dimensions), dtype=np.int8)
                grown[: len(self.vectors)] = self.vectors
                self.vectors = grown
            for c in new:
                i = self.rows[c] = len(self.rows)
                a, b, d = c >> 2 * _BITS, (c >> _BITS) & (1 << _BITS) - 1, c & (1 << _BITS) - 1
                self.vectors[i] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(d)
            rows = list(map(self.rows.get, codes))
        return rows

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector; None if it has no letter."""
        codes, counts = self.trigrams(text)
        if not len(codes):
            return None
        out = np.zeros(self.dimensions, dtype=np.float32)
        for at in range(0, len(codes), 4096):
            rows = self._known(codes[at : at + 4096].tolist())
            out += counts[at : at + 4096].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def drawn(labelled: DataFrame, rows_per_language: int = 500, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> DataFrame | None:
    """(lang, text) of about ``rows_per_language`` rows of each language; None if no row has a language and a text."""
    rows = labelled.where(F.col(language_column).isNotNull() & F.col(text_column).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(language_column).cast("string")).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    draw = F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < F.element_at(share, F.col(language_column).cast("string"))).select(F.col(language_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))


def train(labelled: DataFrame, rows_per_language: int = 500, dimensions: int = DIMENSIONS, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> dict[str, list[float]]:
    """Prototypes from about ``rows_per_language`` rows of each language, drawn by a hash of id and text.

    A language with no more rows than that is taken whole.  What reaches the driver
    is one count and one vector for each language.  Rows whose text or language is null
    take no part, and texts without a letter add nothing; null ids are drawn by their
    texts; rows equal in both are drawn or left together.  Of an empty table there are
    no prototypes.
    """
    bound_batches(labelled.sparkSession)
    sample = drawn(labelled, rows_per_language, id_column, text_column, language_column)
    if sample is None:
        return {}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                v = encoder.bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + _unit(v).astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(range(dimensions), pa.int32()), pa.array(np.round(v, 9))], names=["lang", "dimension", "value"])

    # decimals add up to the same whatever the order of tasks
    summed = sample.mapInArrow(released(partial), "lang string, dimension int, value double").groupBy("lang", "dimension").agg(F.sum(F.col("value").cast("decimal(28,9)")).cast("double").alias("value"))
    out: dict[str, list[float]] = {}
    for r in summed.collect():
        out.setdefault(r.lang, [0.0] * dimensions)[r.dimension] = r.value
    return out


def identify(docs: DataFrame, prototypes: dict[str, list[float]], id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score (cosine, at least 0) for every row; no shuffle.

    Columns doc_id, lang_pred, score or, with ``keep``, a struct ``row`` of those
    input columns, lang_pred, score.  A text
    that is null or has no letter is ``und`` with score 0, and so is any text
    if there are no prototypes.  Equal cosines go to the language first by name.
    Null ids stay null, repeated rows get a row each, an empty table an empty
    result; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([_unit(np.array(prototypes[n])) for n in names], dtype=np.float32).reshape(len(names), -1 if names else DIMENSIONS)
    dimensions = matrix.shape[1] if names else DIMENSIONS
    rows = beside_text(docs, keep or [id_column], text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                v = encoder.bundle(text) if names else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cosines = matrix @ _unit(v)
                    best = int(cosines.argmax())
                    langs.append(names[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    found = rows.mapInArrow(released(run), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return found if keep else found.select(F.col("row")[id_column].alias("doc_id"), "lang_pred", "score")
