"""Toxicity from a weighted finite-state pattern grammar of clauses.

Five transducers stand one behind the other, each a table of (state, symbol) ->
(next state, symbol written).  A word's class is the first one's symbol; what one
writes the next one reads:

* negation marks a loaded word that stands at most NEGATION_SPAN words after a
  negating word of its clause,
* reported speech marks a loaded word that a verb of saying precedes in its clause,
* target marks an insult with a word for a person at most TARGET_SPAN words before it,
  and writes ``late`` where one follows so closely,
* threat holds a verb of harm, as marked, until its clause names a target, and writes
  the threat there; a plain verb is never taken back by a negated one,
* insult lets what is marked through to the scorer.

``compose`` makes one automaton of them, with the product states that can be reached.
Its outputs are kinds of matches; a match of a kind has a weight that is learned from
the labelled rows (with a prior where these say little), an insult times the weight
of its stem, which is learned too.  A clause's weight is the sum of its matches', and a
logistic function of the clauses' weights is the score: a word that no clause pattern
takes up weighs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_text, bound_batches, released, text_of

#: Words of the grammar's classes (prior knowledge, by no means complete).
INSULTS = "idiot moron imbecile stupid dumb pathetic worthless scum loser trash garbage clown disgusting filthy coward parasite vermin".split()
THREATS = "kill hurt destroy beat shoot stab burn crush strangle murder töt schlag erschieß tuer frapp matar golpear".split()
#: Endings with which a verb of harm is still one.
ENDINGS = frozenset(["", "s", "ed", "ing", "er", "ers", "t", "e", "en", "é"])
TARGETS = frozenset("you your yours u he she him her they them those these people everyone dich du ihr euch toi vous tu te usted ustedes ellos".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't weren't don't doesn't didn't won't nicht kein keine nie ne pas jamais nunca".split())
REPORTS = frozenset("said says saying wrote writes claimed claims called reported quoted sagte schrieb dit dijo".split())

NEGATION_SPAN, TARGET_SPAN = 3, 4
#: Prior factors of a match: negated, reported, with its target; and of a late target and of a threat.
NEGATED, REPORTED, TARGETED, LATE, THREAT = 0.3, 0.6, 1.2, 0.6, 3.0
#: Weight of a built-in insult that the labels say nothing about.
PRIOR_WEIGHT = 3.0
#: Strength with which matches' weights are held to their priors, in labelled rows.
PRIOR_ROWS = 20.0
#: Lengths of learned stems.
STEM_LENGTHS = (3, 9)
#: A learned stem stands in so many toxic training documents at least, with such a share and deviation.
LEAST_TOXIC, LEAST_LIFT, LEAST_Z = 5, 2.5, 5.0

_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
#: Typographic apostrophes, which are read as the plain one.
_APOSTROPHES = str.maketrans({"\u2019": "'", "\u02bc": "'"})
#: Words as they are counted for a text's length.
_QUICK = re.compile(rb"[a-z\x80-\xff']+")

# Symbols: (class, negated, reported, targeted).
Symbol = tuple[str, bool, bool, bool]
#: Classes of words that the automaton reads.
CLASSES = ("end", "other", "negation", "report", "target", "insult", "threat")


def _plain(name: str) -> Symbol:
    return (name, False, False, False)


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step`` gives the next state and what is written for a state and a symbol."""

    start: object
    step: Callable[[object, Symbol], tuple[object, Symbol]]


def _negation(state: int, symbol: Symbol) -> tuple[int, Symbol]:
    """State: words since a negation, 0 for none near."""
    kind = symbol[0]
    if kind == "end":
        return 0, symbol
    if kind == "negation":
        return 1, symbol
    after = state + 1 if 0 < state < NEGATION_SPAN else 0
    if kind in ("insult", "threat"):
        return after, (kind, state > 0, symbol[2], symbol[3])
    return after, symbol


def _report(state: bool, symbol: Symbol) -> tuple[bool, Symbol]:
    """State: whether a verb of saying has come in the clause."""
    kind = symbol[0]
    if kind in ("insult", "threat"):
        return state, (kind, symbol[1], state, symbol[3])
    return kind != "end" and (state or kind == "report"), symbol


def _target(state: tuple, symbol: Symbol) -> tuple[tuple, Symbol]:
    """State: words since a target (0: none near), and an insult that still lacks one: its marks and the words since."""
    since, waiting, age = state
    kind = symbol[0]
    if kind == "end":
        return (0, None, 0), symbol
    further = since + 1 if 0 < since < TARGET_SPAN else 0
    waiting, age = (waiting, age + 1) if waiting is not None and age < TARGET_SPAN else (None, 0)
    if kind == "target":
        return (1, None, 0), ("late", *waiting, False) if waiting is not None else symbol
    if kind == "insult":
        if since:
            return (further, waiting, age), (kind, symbol[1], symbol[2], True)
        return (0, symbol[1:3], 0), symbol
    return (further, waiting, age), symbol


def _threat(state: tuple | None, symbol: Symbol) -> tuple[tuple | None, Symbol]:
    """State: the marks of a verb of harm whose target hasn't come, plainer ones before negated or reported ones."""
    kind = symbol[0]
    if kind == "end":
        return None, symbol
    if kind == "threat":
        return min(symbol[1:3], state) if state is not None else symbol[1:3], _plain("other")
    if kind in ("target", "late") and state is not None:
        # A late target that also ends a threat writes both.
        return None, (("both" if kind == "late" else "threat"), *(state if kind == "target" else (symbol[1], symbol[2])), False)
    return state, symbol


NEGATION, REPORT, TARGET = Transducer(0, _negation), Transducer(False, _report), Transducer((0, None, 0), _target)
HARM = Transducer(None, _threat)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what ``first`` writes to ``second``."""

    def step(state: tuple, symbol: Symbol) -> tuple[tuple, Symbol]:
        a, between = first.step(state[0], symbol)
        b, out = second.step(state[1], between)
        return (a, b), out

    return Transducer((first.start, second.start), step)


#: Kinds of matches with their prior weights; an insult's is a factor of its stem's.
KINDS: dict[Symbol, float] = {}
for _n in (False, True):
    for _r in (False, True):
        _factor = (NEGATED if _n else 1.0) * (REPORTED if _r else 1.0)
        KINDS["insult", _n, _r, False] = _factor
        KINDS["insult", _n, _r, True] = _factor * TARGETED
        KINDS["late", _n, _r, False] = _factor * LATE
        KINDS["threat", _n, _r, False] = _factor * THREAT
        KINDS["both", _n, _r, False] = _factor * (LATE + THREAT)
KIND_NUMBER = {k: i for i, k in enumerate(KINDS)}


def tabled(machine: Transducer) -> list[list[tuple[int, int]]]:
    """Rows for the states that can be reached: for each class the next state and the kind written, -1 for none."""
    number, order, table = {machine.start: 0}, [machine.start], []
    for state in order:
        row = []
        for name in CLASSES:
            after, out = machine.step(state, _plain(name))
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append((number[after], KIND_NUMBER.get(out, -1)))
        table.append(row)
    return table


AUTOMATON = tabled(compose(compose(compose(NEGATION, REPORT), TARGET), HARM))
_END, _OTHER, _NEGATION, _REPORT, _TARGET, _INSULT, _THREAT = range(len(CLASSES))


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)
    threats: list[str] = field(default_factory=lambda: list(THREATS))
    kinds: list[float] = field(default_factory=lambda: list(KINDS.values()))
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 1.5, 1.0, 0.0, 0.0])


class Grammar:
    """The automaton with a model's words and weights."""

    def __init__(self, model: Model) -> None:
        self.stems = model.stems
        self.lengths = sorted({len(s) for s in model.stems}, reverse=True)
        self.threats = frozenset(v + e for v in model.threats for e in ENDINGS) - frozenset(e for e in ENDINGS)
        self.kinds = np.array(model.kinds)
        self.memory: dict[str, tuple[int, float]] = {}

    def insult(self, word: str) -> float:
        """Weight of the longest stem that the word starts with; 0 if none."""
        for n in self.lengths:
            if n <= len(word) and (w := self.stems.get(word[:n])) is not None:
                return w
        return 0.0

    def _class(self, token: str) -> tuple[int, float]:
        if len(token) == 1 and token in ".!?;:\n":
            return _END, 0.0
        if token in NEGATIONS:
            return _NEGATION, 0.0
        if token in TARGETS:
            return _TARGET, 0.0
        if token in REPORTS:
            return _REPORT, 0.0
        if (w := self.insult(token)) > 0:
            return _INSULT, w
        return (_THREAT if token in self.threats else _OTHER), 0.0

    def classes(self, tokens: list[str]) -> tuple[list[tuple[int, float]], bool]:
        """Class and weight of each token, and whether any can start a match; each different word is judged once a task."""
        known = self.memory
        if len(known) > 500_000:
            known.clear()
        some = False
        for w in set(tokens):
            found = known.get(w)
            if found is None:
                found = known[w] = self._class(w)
            some = some or found[0] >= _INSULT
        if not some:
            return [], False
        return list(map(known.__getitem__, tokens)), True

    def matches(self, tokens: list[str]) -> list[np.ndarray]:
        """For each clause with a match the sums by kind: of stems' weights for insults, of ones for the others."""
        out: list[np.ndarray] = []
        found, some = self.classes(tokens)
        if not some:
            return out
        held: list[tuple[int, float]] = []
        state = 0
        for name, weight in [*found, (_END, 0.0)]:
            state, kind = AUTOMATON[state][name]
            if kind >= 0:
                held.append((kind, weight if name == _INSULT else 1.0))
            elif name == _END and held:
                sums = np.zeros(len(KINDS))
                for kind, weight in held:
                    sums[kind] += weight
                out.append(sums)
                held = []
        return out

    def clauses(self, low: str) -> list[float]:
        """Weights of the matched clauses of a lower-cased text."""
        return [float(m @ self.kinds) for m in self.matches(self.tokens(low))]

    def tokens(self, low: str) -> list[str]:
        return _TOKENS.findall(low if low.isascii() else low.translate(_APOSTROPHES))

    def read(self, text: str) -> tuple[list[np.ndarray], int]:
        """The matches of each clause, and the number of words."""
        low = text.lower()
        n = max(1, len(_QUICK.findall(low.encode("utf-8", "surrogatepass"))))
        # The automaton's own words decide: a sign that is glued to a word is no part of it.
        return self.matches(self.tokens(low)), n

    def features(self, text: str) -> list[float]:
        """Logarithms of the sum and the largest of the clauses' weights, of the weight a hundred words and of the words."""
        found, n = self.read(text)
        return summary([float(m @ self.kinds) for m in found], n)


def summary(weights: list[float], n: int) -> list[float]:
    total = sum(weights)
    return [float(np.log1p(total)), float(np.log1p(max(weights, default=0.0))), float(np.log1p(100 * total / n)), float(np.log(n))]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; weights are drawn to ``prior``, the last one is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, held = np.append(prior, 0.0), np.append(prior, 0.0)
    strength = np.diag(np.append(penalty, 1e-6))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + strength
        step = np.linalg.solve(h, x.T @ (p - y) + strength @ (w - held))
        # A step of bounded length: the likelihood is flat far off.
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _stem_counts(sample: DataFrame) -> DataFrame:
    """stem, documents and toxic documents in which a word starts with it."""
    word = r"[^\p{L}']+"
    words = sample.select("toxic", F.array_distinct(F.split(F.lower(F.col("text")), word)).alias("words"))
    low, high = STEM_LENGTHS
    stems = F.expr(f"array_distinct(flatten(transform(filter(words, w -> length(w) >= {low}), w -> transform(sequence({low}, least(length(w), {high})), n -> substr(w, 1, n)))))")
    return words.select("toxic", F.explode(stems).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("s"))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit stems, the weights of matches and the score to about ``most_rows`` labelled rows drawn by a hash of the id.

    The drawn ids are the only broadcast; their number is bounded by ``most_rows``
    in expectation.  Good stems and the sample's matches reach the driver, no texts.
    No labels: the built-in words with their prior weights.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("label_id"), F.col(label_column).cast("int").alias("toxic"))
    n = rows.count()
    model = Model(stems={s: PRIOR_WEIGHT for s in INSULTS})
    if not n:
        return model
    draw = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < min(1.0, most_rows / n)).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    text = text_of(text_column)
    sample = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("toxic", "text")
    totals = drawn.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("s")).first()
    base = ((totals.s or 0) + 0.5) / (totals.n + 1)
    deviation = (F.col("s") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    good = _stem_counts(sample).withColumn("z", deviation).where((F.col("s") >= LEAST_TOXIC) & (F.col("s") / F.col("n") >= min(0.9, LEAST_LIFT * base)) & (F.col("z") >= LEAST_Z))
    # Nested stems tell of the same words: the one that deviates most stands for them.  All that the bounded sample bears out are taken.
    taken: set[str] = set()
    for r in good.orderBy(F.desc("z"), F.desc(F.length("stem")), "stem").collect():
        parts = {r.stem[:k] for k in range(STEM_LENGTHS[0], len(r.stem))}
        if not (parts & model.stems.keys()) and r.stem not in taken:
            model.stems[r.stem] = float(np.log((r.s + 0.5) / (r.n - r.s + 0.5)) - np.log(base / (1 - base)))
            taken |= parts | {r.stem}

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for batch in batches:
            found = [grammar.read(t) for t in batch.column("text").to_pylist()]
            clauses = pa.array([[m.tolist() for m in c] for c, _ in found], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), clauses, pa.array([n for _, n in found], pa.int64())], names=["toxic", "clauses", "n"])

    fitted = sample.mapInArrow(released(matched), "toxic int, clauses array<array<double>>, n long").collect()
    fitted.sort(key=lambda r: (r.toxic, r.n, r.clauses))
    y = np.array([float(r.toxic) for r in fitted])
    if len(y) and 0 < y.sum() < len(y):
        prior = np.array(list(KINDS.values()))
        sums = np.array([np.sum(r.clauses, axis=0) if r.clauses else np.zeros(len(KINDS)) for r in fitted])
        kinds = _logistic(sums, y, np.full(len(KINDS), PRIOR_ROWS), prior)[:-1]
        model.kinds = np.maximum(kinds, 0.0).tolist()  # a match never speaks for a text
        weights = np.array(model.kinds)
        x = np.array([summary([float(np.array(m) @ weights) for m in r.clauses], r.n) for r in fitted])
        w = _logistic(x, y, np.full(x.shape[1], 1e-4 * len(y)), np.zeros(x.shape[1]))
        model.coefficients = [float(w[-1]), *w[:-1].tolist()]
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A score from 0 to 1 for every row's whole text; no shuffle.

    Columns doc_id, score or, with
    ``keep``, a struct ``row`` of those input columns in place of doc_id.  Null and
    empty texts match no clause and get the score of such texts.  Null ids stay
    null, repeated rows get a row each, an empty table an empty result; other
    columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    rows = beside_text(docs, keep or [id_column], text_column)
    coefficients = np.array(model.coefficients)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(coefficients[0] + x @ coefficients[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p, pa.float64())], names=["row", "score"])

    found = rows.mapInArrow(released(run), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return found if keep else found.select(F.col("row")[id_column].alias("doc_id"), "score")
