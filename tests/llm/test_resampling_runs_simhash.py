"""Importance resampling, periodic runs and SimHash components against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import importance, periodic_runs, queries, simhash


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def grams(text, n=2):
    w = words_of(text)
    return [b" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def drawn_by_hand(rows, target, percent=25, seed=7, n=2, buckets=10_000, least=20):
    counts, wanted = [0] * buckets, [0] * buckets
    for _, t in rows:
        for g in grams(t, n):
            counts[zlib.crc32(g) % buckets] += 1
    for t in target:
        for g in grams(t, n):
            wanted[zlib.crc32(g) % buckets] += 1
    s_all, t_all = sum(counts), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(counts, wanted)]
    out = []
    for i, t in rows:
        own = [gain[zlib.crc32(g) % buckets] for g in grams(t, n)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(t))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([("the thing and tion",), (None,), ("erst hand the thing",)], "text string")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_op11_draws(documents, texts, target, n, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 500)  # texts go over the cuts
    got = importance.importance_sample(documents, target, max_n=n)
    expected = drawn_by_hand(texts, [r[0] for r in target.collect()], n=n)
    rows = [tuple(r) for r in got.collect()]
    # Of rows equal in id and score either may come first.
    assert sorted((r[:4] for r in rows), key=str) == sorted((r[:4] for r in expected), key=str)
    assert sorted((r for r in rows if r[4]), key=lambda r: r[4]) == sorted((r for r in expected if r[4]), key=lambda r: r[4])


def test_op11_ties_nulls_and_empty_tables(spark, nothing, target):
    rows = [(None, "one two " * 20), (5, "one two " * 20), (5, "one two " * 20), (3, None), (4, ""), (6, "a"), (None, None)] + [(i, "x y z " * 10) for i in range(100, 120)]
    docs = spark.createDataFrame([(i, t, 0, "r") for i, t in rows], "doc_id long, text string, rank int, weight string")
    for percent in (0, 25, 100):
        got = importance.importance_sample(docs, target, percent=percent)
        assert shown(got) == sorted(drawn_by_hand(rows, [r[0] for r in target.collect()], percent), key=str)
    assert importance.importance_sample(nothing, target).count() == 0
    got = importance.importance_sample(docs, target.limit(0))
    assert shown(got) == sorted(drawn_by_hand(rows, []), key=str)


def test_op11_suffix_arrays():
    rng = random.Random(2)
    for _ in range(50):
        symbols = np.array([rng.randrange(4) for _ in range(rng.randint(1, 60))])
        for depth in (1, 2, 3, 5):
            order, lcp = importance.suffix_array(symbols, depth)
            pad = [*symbols.tolist(), *[0] * depth]
            keys = [pad[i : i + depth] for i in order]
            assert keys == sorted(keys) and sorted(order) == list(range(len(symbols)))
            for a, b, n in zip(keys, keys[1:], lcp[1:]):
                common = 0
                while common < depth and a[common] == b[common] != 0:
                    common += 1
                assert common == n


def runs_by_hand(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                part = words[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("aabc"), min_size=1, max_size=9), st.integers(1, 9)), max_size=8), st.sampled_from([2, 4, 12]))
def test_op12_runs_against_all_stretches(parts, least):
    words = [w.encode() for own, times in parts for w in own * times]
    other = [b"a"] * 15
    assert periodic_runs.batch_runs([words, [], other, words[::-1]], least) == [runs_by_hand(words, least), [], runs_by_hand(other, least), runs_by_hand(words[::-1], least)]


@pytest.mark.parametrize("kind", ["fibonacci", "thue", "one", "far"])
def test_op12_runs_of_known_words(kind):
    if kind == "fibonacci":
        a, b = "a", "ab"
        while len(b) < 700:
            a, b = b, b + a
        words = [*b.encode()]
    elif kind == "thue":
        words = [i.bit_count() % 2 for i in range(600)]
    elif kind == "one":
        words = [1] * 500
    else:
        rng = random.Random(1)
        part = [rng.randrange(1000) for _ in range(200)]
        words = part + part + part[:50]
    words = [str(w).encode() for w in words]
    assert periodic_runs.batch_runs([words], 12) == [runs_by_hand(words)]


def test_op12_moves_n_log_n(monkeypatch):
    """Smaller halves: no place is moved more than log2(n) times."""
    moves = [0]
    append = periodic_runs.Partition._append

    def counted(self, place, to):
        moves[0] += 1
        append(self, place, to)

    monkeypatch.setattr(periodic_runs.Partition, "_append", counted)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 4000:
        a, b = b, b + a
    for words in (b, [b"x"] * 4000, [str(i % 1999).encode() for i in range(4000)]):
        moves[0] = 0
        periodic_runs.batch_runs([words], 12)
        assert moves[0] <= len(words) * (2 + math.log2(len(words)))


def altered(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
    return words


def test_op12_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    rows += [(None, "a " * 30), (None, None), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "line one of it\n" * 40), (1003, "line one of it\n" * 40), (1004, "é é   x\x0b\x0cy\r" * 9), (1005, "w" * 100_000), (1006, "p q " * 3000)]
    spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for i, t in rows:
        words = altered(i, t)
        runs = runs_by_hand(words) if len(words) < 500 else [(0, len(words), 2)]
        dropped = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for j, w in enumerate(words) if j not in dropped)
        expected.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(1 for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0) > 20
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert shown(got) == sorted(expected, key=str)


def test_op12_keeps_columns_of_any_name(spark, nothing):
    docs = spark.createDataFrame([(1, "a b " * 8, "x")], "doc_id long, text string, `row` string")
    got = periodic_runs.periodic_runs(docs, keep=["doc_id", "row"]).collect()
    assert [(r.row.doc_id, r.row.row, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(1, "x", [(0, 16, 2)], "a b")]
    assert periodic_runs.periodic_runs(nothing).count() == 0


def fingerprint_by_hand(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def components_by_hand(rows, radius):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None) for i in range(len(rows))]


def test_op13_components(spark, documents, texts, nothing):
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(300)]
    rows = list(texts) + [(None, "A b C"), (None, "a B c"), (None, "only this one\tis null"), (900, None)]
    for i in range(120):
        own = list(base)
        own[rng.randrange(300)] = "other"
        rows.append((1000 + i, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    marks = [(i, fingerprint_by_hand(t)) for i, t in rows]
    for radius in (0, 1, 2, 3):
        expected = [(i, f"{f:016x}", c) for (i, f), c in zip(marks, components_by_hand(marks, radius))]
        assert shown(simhash.simhash_components(docs, radius)) == sorted(expected, key=str)
    assert simhash.simhash_components(nothing).count() == 0


def test_op13_hash_is_that_of_the_engine(spark):
    from pyspark.sql import functions as F

    text = "é one two"
    got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)
    assert simhash.fingerprint(text.encode().split()) == got


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_op13_every_pair_within_the_radius_meets(radius):
    from itertools import combinations

    masks = simhash.covering(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for k in range(radius + 1):
        for bits in combinations(range(64), k):
            difference = sum(1 << b for b in bits)
            assert any(difference & m == 0 for m in masks)
    if radius == 2:
        assert max(64 - m.bit_count() for _, own in simhash.tables(2) for m in own) <= 12


@pytest.mark.parametrize("share", [1, 2000])
def test_op13_a_hot_bucket_is_dealt_again(spark, monkeypatch, share):
    """Many different fingerprints in one bucket, over the limit: passed on in a stream, or known before as a great share."""
    monkeypatch.setattr(simhash, "SHARE", share)
    rng = random.Random(5)
    low = simhash.tables(2)[0][0]
    free = [b for b in range(64) if not low >> b & 1]
    values = {0}
    while len(values) < 800:
        v = rng.choice(sorted(values)) if rng.random() < 0.7 else 0
        for b in rng.sample(free, rng.choice([1, 2, 3, 8])):
            v ^= 1 << b
        values.add(v)
    some = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.near_edges(spark.createDataFrame([(v,) for v in some], "fingerprint long"), 2, limit=16).collect()
    root = {v: v for v in some}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[find(a)] = find(b)
    expected = components_by_hand([(i, v % (1 << 64)) for i, v in enumerate(some)], 2)
    by = {}
    for v, c in zip(some, expected):
        by.setdefault(find(v), set()).add(c)
    assert all(len(c) == 1 for c in by.values()) and len(by) == len(set(expected))
    assert len(edges) < 64 * len(some)
