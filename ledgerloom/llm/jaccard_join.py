"""Similarity join of texts by the Jaccard index of their word n-grams.

1. Each text's shingles are hashed; texts with the same set of shingles are one
   class, so copies are counted, not compared.  A class has a name of 128 bits.
2. A MinHash LSH forest: TREES prefix tries of DEPTH minima, each a sorted array of
   labels.  Neighbours in the order have the longest common prefixes, so one pass
   over the sorted rows finds those that share a prefix of LEAST minima or more with
   any other; all others match nobody in that tree at any depth that is used.
3. Matched prefixes are shortened adaptively.  A class starts in each tree at the
   deepest prefix.  A pair at the threshold t misses a prefix of k minima with
   probability 1 - t^k, so the class's own recall bound is 1 - prod(1 - t^k) over the
   trees.  While that is under the target, the tree in which the next shorter prefix
   has the fewest companions is shortened by one.  Prefixes that match nobody are
   shortened freely.  A trie's node that any class wants closed is closed for its whole
   subtree, so both sides of a pair agree, and a bound can only grow.
4. Classes below one closed node are a group of candidates.  Groups with the same
   members in several trees are one.  A large group is dealt in pairs of blocks, so
   no task holds an unbounded one.
5. Exact verification within a pair of blocks: the shingle sets of both blocks,
   their intersections by matrix products.  A pair is counted in the first tree
   in which it meets.  Only links counted by class, and links enough to connect what
   is connected, leave the task: never the pairs themselves.
6. Components of the links by label propagation with hooking, until no label changes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, id_bitmap, released, text_key, text_of, with_maybe

#: Tries, minima of the deepest and of the shortest prefix.
TREES, DEPTH, LEAST = 20, 6, 2
RECALL = 0.99999
#: Classes of a group in one block.
BLOCK = 256
#: Bytes of one minimum in a label, and of one tree's label.
SYMBOL = 2
LABEL = DEPTH * SYMBOL
#: Columns of a matrix of shingles at a time.
COLUMNS = 8192

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(2 * n, base, dtype=np.uint64)
            out[0] = 1
            _tables[i] = np.multiply.accumulate(out)
    return _tables


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted different hashes of the text's n-grams of words; of all its words if they are fewer, none if there are none.

    Words: runs of ASCII letters and digits and of all characters beyond ASCII,
    lower-cased.
    """
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    powers, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * powers[: len(raw)], out=total[1:])
    words = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
    return np.unique(_mix(out))


def packed(hashes: np.ndarray) -> bytes:
    """The upper 40 bits of each hash: two unequal shingles of a pair of sets of a thousand meet with probability 1e-6."""
    top = hashes >> np.uint64(24)
    return (top >> np.uint64(8)).astype("<u4").tobytes() + (top & np.uint64(0xFF)).astype(np.uint8).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return (np.frombuffer(raw, dtype="<u4", count=n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(raw, dtype=np.uint8, offset=4 * n)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (sets x TREES * DEPTH) of non-empty sets: 16 mixed bits of each minimum."""
    every = np.concatenate(sets)
    starts = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    out = np.empty((len(sets), len(_SEEDS)), dtype=np.uint32)
    for k, seed in enumerate(_SEEDS):
        out[:, k] = np.minimum.reduceat((every * seed) >> np.uint64(32), starts)
    return ((out ^ (out >> np.uint32(16))) & np.uint32(0xFFFF)).astype(">u2")


def gains(threshold: float) -> list[float]:
    """-ln of the probability that a pair at the threshold misses a prefix of k minima, for k from 0 to DEPTH."""
    return [math.inf] + [-math.log1p(-min(threshold**k, 1 - 1e-12)) for k in range(1, DEPTH + 1)]


def shortened(companions: dict[int, list[int]], threshold: float, recall: float) -> dict[int, int]:
    """The prefix length at which a class is met in each tree where it has companions.

    companions: by tree, the classes that share its prefix of LEAST, .., DEPTH minima.
    In the other trees it matches nobody at LEAST already.
    """
    gain, target = gains(threshold), -math.log(max(1 - recall, 1e-300))
    depth = dict.fromkeys(companions, DEPTH)
    total = (TREES - len(companions)) * gain[LEAST] + len(companions) * gain[DEPTH]
    ready = [(companions[t][DEPTH - 1 - LEAST], t) for t in companions] if DEPTH > LEAST else []
    heapq.heapify(ready)
    # Shortening is free where nobody is met; else it goes on until the target.
    while ready and (total < target or ready[0][0] <= 1):
        _, t = heapq.heappop(ready)
        depth[t] -= 1
        total += gain[depth[t]] - gain[depth[t] + 1]
        if depth[t] > LEAST:
            heapq.heappush(ready, (companions[t][depth[t] - 1 - LEAST], t))
    return depth


def _name(hashes: np.ndarray, text: str) -> bytes:
    """A class's name: of its shingles, or of the text if there are none."""
    import hashlib

    kind = b"s" if len(hashes) else b"t"
    return hashlib.blake2b(hashes.tobytes() or text.encode("utf-8", "surrogatepass"), digest_size=16, person=kind).digest()


def _classes(docs: DataFrame, ngram: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_key (MD5 of the text), class (name of the shingle set, or of the text if there are no words), signature (null then)."""
    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = keyed.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                sets = [shingles(t, ngram) for t in texts[at : at + 256]]
                keys = [_name(s, t) for s, t in zip(sets, texts[at:], strict=False)]
                signatures: list[bytes | None] = [None] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    for i, row in zip(full, minima([sets[i] for i in full]), strict=True):
                        signatures[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, 256), batch.column("text_key").slice(at, 256), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                    names=["doc_id", "text_key", "class", "signature"],
                )

    return rows.mapInArrow(released(run), "doc_id long, text_key binary, class binary, signature binary")


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of sorted (tree, label, class) the rows that share LEAST minima or more with a neighbour, and the first and the last."""
    last: np.ndarray | None = None
    held: pa.RecordBatch | None = None  # the last row, which waits for the next one
    held_shares = True

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        tree = np.asarray(batch.column("tree").to_numpy(zero_copy_only=False)).astype(np.uint8)
        label = np.frombuffer(b"".join(batch.column("label").to_pylist()), dtype=np.uint8).reshape(-1, LABEL)
        return np.column_stack([tree, label[:, : LEAST * SYMBOL]])

    for batch in batches:
        if not batch.num_rows:
            continue
        own = keys(batch)
        above = np.empty(len(own), dtype=bool)  # shares with the row before it
        above[1:] = (own[1:] == own[:-1]).all(axis=1)
        above[0] = True if last is None else bool((own[0] == last).all())
        if held is not None and (held_shares or above[0]):
            yield held
        shares = above.copy()
        shares[:-1] |= above[1:]
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(shares[:-1]))
        held, held_shares, last = batch.slice(batch.num_rows - 1), bool(shares[-1]), own[-1]
    if held is not None:
        yield held


def _plans(threshold: float, recall: float):
    """Rows (class, prefixes: tree, depth, n, label) -> the prefix (tree, node) that each class wants closed in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for name, rows in zip(batch.column("class").to_pylist(), batch.column("prefixes").to_pylist(), strict=True):
                companions: dict[int, list[int]] = {}
                labels: dict[int, bytes] = {}
                for r in rows:
                    companions.setdefault(r["tree"], [1] * (DEPTH + 1 - LEAST))[r["depth"] - LEAST] = r["n"]
                    labels[r["tree"]] = r["label"]
                companions = {t: n for t, n in companions.items() if n[0] > 1}
                for t, k in shortened(companions, threshold, recall).items():
                    out[0].append(name)
                    out[1].append(t)
                    out[2].append(labels[t])
                    out[3].append(k)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32())], names=["class", "tree", "label", "depth"])

    return run


def forest(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(class, tree, node): the closed trie node at which each class (class, signature) is met, for classes that share one with another."""
    spark = nodes.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("signature", t * LABEL + 1, F.lit(LABEL)))
    members = nodes.select("class", F.posexplode(labels).alias("tree", "label"))
    # The order has no ties, so no range of it is hot, however common a prefix is.
    ordered = members.repartitionByRange(count, "tree", "label", "class").sortWithinPartitions("tree", "label", "class")
    sharing = cut(ordered.select("tree", "label", "class").mapInArrow(released(_sharing), "tree int, label binary, class binary"))
    prefix = lambda k: F.substring("label", F.lit(1), k * SYMBOL)
    every = sharing.withColumn("depth", F.explode(F.sequence(F.lit(LEAST), F.lit(DEPTH)))).withColumn("node", prefix(F.col("depth")))
    counts = every.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    prefixes = every.join(counts, ["tree", "node"]).groupBy("class").agg(F.collect_list(F.struct("tree", "depth", "n", "label")).alias("prefixes"))
    wanted = cut(prefixes.mapInArrow(_plans(threshold, recall), "class binary, tree int, label binary, depth int"))
    closed = wanted.select("tree", prefix(F.col("depth")).alias("node")).distinct()
    # The shortest closed prefix on a class's path: its own at the latest.
    paths = wanted.withColumn("node", F.explode(F.transform(F.sequence(F.lit(LEAST), F.col("depth")), prefix)))
    met = paths.join(closed, ["tree", "node"], "left_semi").groupBy("class", "tree").agg(F.min_by("node", F.length("node")).alias("node"))
    return cut(met)


def _linked(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Which of the first ``left`` sets link with which of all: intersections by products of 0/1 matrices."""
    sizes = np.array([len(s) for s in sets])
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # A shingle that only one set has adds to no intersection.
    counts = np.bincount(column, minlength=len(names))
    shared = counts > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = place[column[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = int(shared.sum())
    common = np.zeros((left, len(sets)), dtype=np.float32)
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, width - at)), dtype=np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        common += m[:left] @ m.T
    union = sizes[:left, None] + sizes[None, :] - common
    return common >= threshold * union - 1e-6


def _verify(threshold: float):
    """Batches of members sorted by unit -> (a, b, n): n links in rows (a, null, n), connecting edges in (a, b, 0)."""
    fields = ["unit", "tree", "same", "side", "node", "weight", "labels", "shingles"]

    def unit_rows(held: list[tuple]) -> tuple[list[bytes], list[bytes | None], list[int]]:
        a, b, n = [], [], []
        # A group's block with itself (same), or its first block (side 0) with its second (side 1).
        tree, same = held[0][1], held[0][2]
        held = sorted(held, key=lambda r: (r[3], r[4]))
        left = sum(1 for r in held if r[3] == 0)
        sets = [unpacked(r[7]) for r in held]
        links = _linked(sets, left, threshold)
        labels = np.array([r[6] for r in held], dtype=np.int64)
        # Met in an earlier tree: counted there.  0: at no node.
        for t in range(tree):
            links &= (labels[:left, t][:, None] != labels[:, t][None, :]) | (labels[:left, t] == 0)[:, None]
        if same:
            np.fill_diagonal(links, False)
            pairs = np.triu(links, 1)
        else:
            links[:, :left] = False
            pairs = links
        weight = np.array([r[5] for r in held], dtype=np.int64)
        nodes = [r[4] for r in held]
        totals = np.zeros(len(held), dtype=np.int64)
        totals[:left] += links @ weight
        if not same:
            totals[left:] += (links[:, left:].T @ weight[:left]).astype(np.int64)
        for i in np.flatnonzero(totals).tolist():
            a.append(nodes[i])
            b.append(None)
            n.append(int(totals[i]))
        # What the unit's links connect.
        root = list(range(len(held)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(left):
            for j in np.flatnonzero(pairs[i]).tolist():
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
        # Its members one after the other: no node has many edges.
        latest: dict[int, int] = {}
        for i in sorted(range(len(held)), key=nodes.__getitem__):
            r = find(i)
            if r in latest and nodes[latest[r]] != nodes[i]:
                a.append(nodes[latest[r]])
                b.append(nodes[i])
                n.append(0)
            latest[r] = i
        return a, b, n

    def batch_of(rows: tuple[list[bytes], list[bytes | None], list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64())], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for row in zip(*(batch.column(f).to_pylist() for f in fields), strict=True):
                if held and held[0][0] != row[0]:
                    for have, got in zip(out, unit_rows(held), strict=True):
                        have += got
                    held = []
                    if len(out[0]) > 4096:
                        yield batch_of(out)
                        out = ([], [], [])
                held.append(row)
        if held:
            for have, got in zip(out, unit_rows(held), strict=True):
                have += got
        if out[0]:
            yield batch_of(out)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of an edge (a, b).

    Each round takes the smallest label of a neighbour's label, for the node and also
    for the node that is its label (whole trees hook onto others), and then the
    label's own label: trees merge and halve, so rounds grow with the logarithm of
    the nodes, not with a chain's length.  The rounds end when no label changes: a
    label is then its own label and the same across every edge.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        own = labels.select(F.col("node").alias("via"), F.col("root").alias("jumped"))
        # Every label is a node with a label of its own.
        jump = cut(labels.join(own, F.col("root") == F.col("via")).select("node", "root", "jumped"))
        near = both.join(jump.select("node", "jumped"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("jumped").alias("near"))
        taken = cut(jump.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("jumped", "near").alias("root"), "near"))
        hooks = taken.groupBy(F.col("old").alias("hooked")).agg(F.min("near").alias("onto"))
        new = cut(taken.join(hooks, F.col("node") == F.col("hooked"), "left").select("node", "old", F.least("root", F.coalesce("onto", "root")).alias("root")))
        labels = new.select("node", "root")
        if new.where(F.col("old") != F.col("root")).isEmpty():
            return labels


def linked_rows(docs: DataFrame, threshold: float = 0.8, ngram: int = 5, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_key, class, root, copy_of, class_id, n_links.

    text_key: MD5 of the text, which with the id tells a row apart.  class: the name
    of the row's shingle set.  root: the smallest class name reachable over links, so
    it names the group even where ids are null.  The rest as in ``jaccard_join``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    found = cut(_classes(docs, ngram, id_column, text_column))
    # One row for each class; copies are counted before the shuffle.
    groups = cut(found.groupBy("class").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("weight"), F.first("signature").alias("signature"), F.min("text_key").alias("text_key")))
    nodes = groups.where(F.col("signature").isNotNull())
    members = forest(nodes.select("class", "signature"), threshold, recall)
    # Candidate groups: a node that two classes share at least, known by an order-free hash of its members.
    mark = F.xxhash64("class")
    sizes = members.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size"), F.sum(F.shiftright(mark, 8)).alias("h1"), F.bit_xor(mark).alias("h2")).where("size > 1")
    unit = sizes.groupBy("size", "h1", "h2").agg(F.min(F.struct("tree", "node")).alias("first")).select("size", F.col("first.tree").alias("tree"), F.col("first.node").alias("node"))
    # Each class's nodes in all trees, as 64-bit names: by them a pair knows in which trees it has met.
    own = members.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("tree", F.xxhash64("tree", "node")))).alias("at"))
    own = own.select("class", F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.element_at("at", t), F.lit(0).cast("long"))).alias("labels"))
    dealt = members.join(unit, ["tree", "node"]).join(own, "class").join(nodes.select("class", "text_key", "weight"), "class")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("class", F.lit(5)), F.col("blocks")).cast("int"))
    # Block i meets every block j; the unit's name has the smaller block first.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    unit_name = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.unhex(F.lpad(F.hex("low"), 8, "0")), F.unhex(F.lpad(F.hex("high"), 8, "0")), "node")
    dealt = cut(dealt.select("class", "text_key", "weight", "labels", "tree", unit_name.alias("unit"), (F.col("low") == F.col("high")).alias("same"), F.when(F.col("own") == F.col("low"), 0).otherwise(1).alias("side")))
    needed = dealt.select("text_key").distinct()
    texts = docs.select(text_of(text_column).alias("text")).withColumn("text_key", text_key(F.col("text")))
    # Only texts that stand for a class in some group are shingled again: a bitmap of fixed size turns most others away, the class's name the rest.
    texts = with_maybe(texts, id_bitmap(needed, "text_key"), "text_key").where("maybe").drop("maybe")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, ngram) for t in batch.column("text").to_pylist()]
            full = [s for s in found if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s, "") for s in full], pa.binary()), pa.array([packed(s) for s in full], pa.binary())], names=["class", "shingles"])

    # Repeated rows have one class: any of them will do.
    shingled = texts.mapInArrow(released(sets), "class binary, shingles binary").dropDuplicates(["class"])
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = dealt.join(shingled, "class").withColumnRenamed("class", "node").repartition(count, "unit").sortWithinPartitions("unit")
    results = cut(work.select("unit", "tree", "same", "side", "node", "weight", "labels", "shingles").mapInArrow(released(_verify(threshold)), "a binary, b binary, n long"))
    counts = results.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    roots = cut(components(results.where("b is not null").select("a", "b")).select(F.col("node").alias("class"), "root").join(groups.select("class", "copy_of"), "class"))
    firsts = roots.groupBy("root").agg(F.min("copy_of").alias("first"))
    firsts = roots.join(firsts, "root").select("class", "root", "first")
    classes = groups.join(counts, "class", "left").join(firsts, "class", "left")
    classes = classes.select("class", F.coalesce("root", "class").alias("root"), "copy_of", F.when(F.col("root").isNull(), F.col("copy_of")).otherwise(F.col("first")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return found.select("doc_id", "text_key", "class").join(classes, "class").select("doc_id", "text_key", "class", "root", "copy_of", "class_id", "n_links")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, ngram: int = 5, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, copy_of, n_links.

    n_links: rows other than this one whose n-gram sets have a Jaccard index of
    ``threshold`` or more with its own.  copy_of: the smallest id with the same set.
    class_id: the smallest id reachable over links.  The count is exact for the
    pairs that meet in the forest; a pair at the threshold fails to meet with
    probability 1 - ``recall`` at most, and less above it.

    A text of fewer than ``ngram`` words is one n-gram of all its words; texts
    without words (null, empty, signs only) link only with equal texts, a null one
    counting as empty.  Repeated rows are rows of the same class and link with each
    other.  Rows with a null id link as any other; copy_of and class_id are null
    only where no row of the class, or of the group, has an id.  An empty table gives
    an empty result; other columns are not looked at.
    """
    return linked_rows(docs, threshold, ngram, recall, id_column, text_column).select("doc_id", "class_id", "copy_of", "n_links")
