"""The operators against brute force on small tables, and their defined edge cases."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from ledgerloom.llm import fingerprints, jaccard_join, language_id, licenses, mixing, nearest, packing, sharding, token_counts, toxicity  # noqa: E402
from ledgerloom.llm.encoding import SegmentEncoder  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_segments_encode_as_the_library(tokenizer):
    import random

    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "é", "日本", "12", "'s", ".", "<|endoftext|>", "²", "🙂", "​", "\x1c", "\x85"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    expected = [np.asarray(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(some, add_special_tokens=False)]
    for ranked in (False, True):
        assert SegmentEncoder(BPE, True, ranked).encode(some) == expected
    assert SegmentEncoder(BPE, False).encode(some) == [len(x) // 4 for x in expected]


def test_op1_shards(documents, texts, nothing):
    rows = sharding.shard(documents).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(documents.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_op1_permutes(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 42)).collect()]
    assert sorted(got) == list(range(n))
    a, b = sharding.radices(n)
    assert a * b >= n


def test_op1_is_a_feistel_permutation(spark):
    """Against the rounds written out with whole numbers, cycle walks included."""
    from pyspark.sql import functions as F

    n, key, P = 1000003, 42, 2147483647
    a, b = sharding.radices(n)

    def once(v):
        left, right = divmod(v, b)
        for r in range(sharding.ROUNDS):
            m, c = (key * 1_000_003 + r * 7_919 + 12_345) % (P - 1) + 1, (key * 69_621 + r * 104_729 + 54_321) % P
            t = ((right if r % 2 == 0 else left) * m + c) % P
            f = (t * t + t * (m % 65_537) + c) % P
            left, right = ((left + f) % a, right) if r % 2 == 0 else (left, (right + f) % b)
        return left * b + right

    def walked(x):
        x = once(x)
        while x >= n:
            x = once(x)
        return x

    some = [0, 1, 2, 999, 500000, n - 1, *range(7, n, 9973)]
    rows = spark.createDataFrame([(x,) for x in some], "x long")
    assert {r.x: r.y for r in rows.select("x", sharding.permuted(F.col("x"), n, key).alias("y")).collect()} == {x: walked(x) for x in some}


def test_op1_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    docs = spark.createDataFrame([(None, None)] * 40 + [(1, "a")] * 8 + [(2, "b")], "doc_id long, text string")
    rows = sharding.shard(docs, shards=3).collect()
    assert sorted(r.row_number for r in rows) == list(range(49))
    assert Counter(r.doc_id for r in rows) == {None: 40, 1: 8, 2: 1}


def test_op2_fingerprints(documents, texts, nothing):
    import xxhash

    ordered = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0], int.from_bytes(xxhash.xxh64(r[1].encode(), seed=42).digest(), "big", signed=True)))
    rows = Counter(tuple(r) for r in fingerprints.edited_fingerprints(documents, groups=5).collect())
    expected = Counter()
    for k, (i, t) in enumerate(ordered):
        u = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = fingerprints.sketches([t, edited, u])
        expected[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.written(a), fingerprints.written(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c))] += 1
    assert rows == expected
    assert fingerprints.edited_fingerprints(nothing, groups=3).count() == 0


def parsed_plainly(text):
    """The phrase names of a text by the rules of the parsing, symbol by symbol."""
    M = 1 << 32
    A, B, P = 0x9E3779B1, 0x85EBCA6B, 0x2C1B3C6D

    def mix(x):
        x = (x ^ (x >> 15)) * B % M
        return x ^ (x >> 13)

    def coin(left, own, bits):
        differ = left ^ own
        if not differ % M:
            return own & 1
        k = (differ & -differ).bit_length() - 1
        return 2 * k + (own >> k & 1)

    names, kept = [mix((ord(c) + 1) * A % M) for c in text], set()
    for level in range(1, fingerprints.LAST_LEVEL + 1):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mix(x ^ (n * A % M)) for x, n in runs]
        labels = names
        for bits, mask in ((32, M - 1), (6, 63), (4, 15)):
            labels = [coin((labels[i - 1] if i else ~labels[0]) & mask, labels[i], bits) for i in range(len(labels))]
        n = len(names)
        opens = [i == 0 or (1 < i < n - 1 and labels[i] < labels[i - 1] and labels[i] <= labels[i + 1]) for i in range(n)]
        at = [i for i in range(n) if opens[i]] + [n]
        names = [mix(sum(mix((names[i] + A) % M) * pow(P, i - a, M) for i in range(a, b)) % M) for a, b in zip(at, at[1:])]
        if level >= fingerprints.FIRST_LEVEL:
            kept |= set(names)
        if len(names) == 1 and level >= fingerprints.FIRST_LEVEL:
            break
    return sorted(kept)[: fingerprints.SKETCH]


def test_op2_parsing_against_its_rules():
    import random

    rng = random.Random(7)
    some = ["a", "ab", "aaaa", "abab" * 9, "x" * 300] + ["".join(rng.choice("abcde é日🙂") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    for text, found in zip(some, fingerprints.sketches(some), strict=True):
        assert found.tolist() == parsed_plainly(text)


def test_op2_hot_and_null_ids(spark):
    """One id, and null, fill several groups each: every row has the row after it as its next."""
    import random

    rng = random.Random(2)
    rows = [(5, f"hot {i} " * rng.randint(1, 9)) for i in range(90)] + [(None, f"none {i}") for i in range(60)] + [(i, f"text {i} " * 3) for i in range(40)] + [(7, "again")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    import xxhash

    signed = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), seed=42).digest(), "big", signed=True)
    ordered = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], signed(r[1])))
    expected = Counter()
    for k, (i, t) in enumerate(ordered):
        u = ordered[(k + 1) % len(ordered)][1]
        expected[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()] += 1
    for groups in (1, 2, 7, 16):
        got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited_fingerprints(docs, groups=groups).collect())
        assert got == expected
    sizes = [r["count"] for r in fingerprints.with_next(docs, 16)[0].where("not guest").groupBy("group").count().collect()]
    assert max(sizes) <= 60  # the equal rows of one id stay together, the others don't


def test_op2_interiors_agree():
    """Phrases inside a shared passage are the same at any offset, and texts parse alike alone and together."""
    import random

    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    one, two = fingerprints.sketches(["x" * 17 + passage, "completely other start " + passage])
    assert fingerprints.likeness(one, two) > 0.9
    assert (fingerprints.sketches([passage])[0] == fingerprints.sketches(["abc", passage, "tail"])[1]).all()
    assert fingerprints.likeness(one, one) == 1.0


def brute_links(texts):
    words = re.compile(rb"[0-9a-z\x80-\xff]+")
    sets = []
    for _, t in texts:
        w = words.findall((t or "").lower().encode())
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else ("text", t or ""))
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            same = a == b if isinstance(a, tuple) or isinstance(b, tuple) else len(a & b) >= 0.8 * len(a | b)
            if i != j and same:
                links[i] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return links, [min(texts[j][0] for j in range(len(texts)) if find(j) == find(i)) for i in range(len(texts))]


def test_op3_join(documents, texts, nothing, monkeypatch):
    links, classes = brute_links(texts)
    expected = Counter((i, c, n) for (i, _), c, n in zip(texts, classes, links, strict=True))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(documents).collect())
    assert got == expected
    assert jaccard_join.jaccard_join(nothing).count() == 0


def test_op3_blocks(spark, texts, monkeypatch):
    """A group larger than a block is compared in pairs of blocks, each pair of texts once."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    near = [(i, t) for i, t in texts if 100 <= i < 300] + [(None, "a b c d e f")]
    links, classes = brute_links(near[:-1])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(near, "doc_id long, text string")).collect()}
    assert got.pop(None) == (None, 0)
    assert got == {i: (c, n) for (i, _), c, n in zip(near[:-1], classes, links, strict=True)}


def test_op3_shortens_until_the_target():
    """The bound of every class reaches the target, crowded prefixes are shortened last and free ones always."""
    import math
    import random

    gain = jaccard_join.gains(0.8)
    rng = random.Random(6)
    for _ in range(200):
        companions = {}
        for t in range(rng.randint(0, jaccard_join.TREES)):
            n = sorted((rng.randint(1, 1000) for _ in range(jaccard_join.DEPTH - jaccard_join.LEAST)), reverse=True)
            companions[t] = [rng.randint(max(2, n[0]), 2000), *n]
        depth = jaccard_join.shortened(companions, 0.8, 0.9999)
        missed = math.exp(-sum(gain[depth.get(t, jaccard_join.LEAST)] for t in range(jaccard_join.TREES)))
        assert missed <= 1e-4 or all(k == jaccard_join.LEAST for k in depth.values())
        assert all(k == jaccard_join.LEAST or companions[t][k - 1 - jaccard_join.LEAST] > 1 for t, k in depth.items())
    crowded = {t: [500] * 5 for t in range(jaccard_join.TREES)} | {0: [9, 8, 7, 6, 5]}
    depth = jaccard_join.shortened(crowded, 0.8, 0.9999)
    assert depth[0] == jaccard_join.LEAST and max(depth.values()) > jaccard_join.LEAST


def test_op3_forest_meets_as_its_definition(spark):
    """Closed nodes against tries built as dictionaries."""
    import math
    from collections import Counter as Count

    rng = np.random.default_rng(3)
    n, J = 300, jaccard_join
    base = rng.integers(0, 3, (n, J.TREES * J.DEPTH)).astype(">u2")
    base[:120] = base[0]
    base[:120, :: 7] = rng.integers(0, 2, base[:120, :: 7].shape)
    names = [i.to_bytes(16, "big") for i in range(n)]
    nodes = spark.createDataFrame([(bytearray(a), bytearray(r.tobytes())) for a, r in zip(names, base)], "class binary, signature binary").repartition(5)
    got = {(bytes(r["class"]), r.tree): bytes(r.node) for r in J.forest(nodes, 0.8, 0.9999).collect()}
    path = lambda i, t, k: base[i, t * J.DEPTH : t * J.DEPTH + k].tobytes()
    counts = Count((t, path(i, t, k)) for i in range(n) for t in range(J.TREES) for k in range(J.LEAST, J.DEPTH + 1))
    wanted, closed = {}, set()
    for i in range(n):
        c = {t: [counts[t, path(i, t, k)] for k in range(J.LEAST, J.DEPTH + 1)] for t in range(J.TREES)}
        wanted[i] = J.shortened({t: x for t, x in c.items() if x[0] > 1}, 0.8, 0.9999)
        closed |= {(t, path(i, t, k)) for t, k in wanted[i].items()}
    expected = {(names[i], t): next(path(i, t, k) for k in range(J.LEAST, J.DEPTH + 1) if (t, path(i, t, k)) in closed) for i in range(n) for t in wanted[i]}
    assert got == expected and len(expected) > n and math.isfinite(len(closed))


def test_op3_a_large_group_of_near_copies(spark):
    """5,000 texts that differ in a word of 60 or two: links, classes and counts as all pairs have them."""
    import random

    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows, sets = [], []
    for i in range(5000):
        words = list(base)
        for _ in range(rng.randint(0, 1)):
            words[rng.choice([0, 20, 40, 59])] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
        sets.append(jaccard_join.shingles(rows[-1][1]))
    names = {h: j for j, h in enumerate(sorted({h for s in sets for h in s.tolist()}))}
    m = np.zeros((len(rows), len(names)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [names[h] for h in s.tolist()]] = 1
    common = m @ m.T
    linked = common >= 0.8 * (m.sum(1)[:, None] + m.sum(1)[None, :] - common) - 1e-6
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    links = np.array([linked[i].sum() - 1 for i in range(len(rows))])
    counted = np.array([got[i][1] for i in range(len(rows))])
    assert all(c == 0 for c, _ in got.values())
    # No link too many; a pair fails to meet with the probability that the target allows.
    assert (counted <= links).all() and links.sum() - counted.sum() <= 1e-4 * links.sum()


def test_op3_components_of_a_long_chain(spark, monkeypatch):
    """A chain of 2,000 nodes of random names, a second one and a star: as by union-find, in few rounds."""
    rng = np.random.default_rng(1)
    names = rng.integers(-(1 << 63), 1 << 63, 2600, dtype=np.int64).tolist()
    edges = list(zip(names[:2000], names[1:2000])) + list(zip(names[2000:2500], names[2001:2500])) + [(names[2500], x) for x in names[2501:]]
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    cuts = []
    whole = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df: cuts.append(1) or whole(df))
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in names}
    assert len(cuts) < 2 + 3 * 20


def test_op4_toxicity(spark, documents, nothing):
    rows, labels = [], []
    import random

    rng = random.Random(4)
    for i in range(300):
        toxic = i % 3 == 0
        filler = [rng.choice(["stone", "river", "light", "green", "paper", "cloud"]) for _ in range(30)]
        if toxic:
            filler.insert(5, rng.choice(["zorgly", "zorglified"]))
            filler.insert(9, "zorgling")
        rows.append((i, " ".join(filler) + "."))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(documents, model).count() == documents.count()
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")).coefficients


def test_op4_grammar():
    g = toxicity.Grammar(toxicity.Model(stems={"idiot": 3.0}))
    weigh = lambda t: sum(g.clauses(t))
    assert weigh("an idiot.") == 3.0
    assert weigh("you idiot.") > weigh("an idiot.") > weigh("he said idiot.") > weigh("not an idiot.") > 0
    assert weigh("kill time. fine you") == 0.0 < weigh("i will kill you")
    assert weigh("killing you") == weigh("i will kill you") > weigh("i will never kill you") > 0
    assert weigh("i will kill or, not, hurt you") == weigh("i will kill you")  # a negated verb takes no plain one back
    assert len(g.clauses("idiot. idiot")) == 2
    assert weigh("you aren\u2019t an idiot.") == weigh("you aren't an idiot.") < weigh("you are an idiot.")


def brute_matches(classes):
    """Kinds of matches of one clause, each found by looking at the words around it."""
    T = toxicity
    near = lambda i, name, span: any(classes[j] == name for j in range(max(0, i - span), i))
    marks = lambda i: (near(i, "negation", T.NEGATION_SPAN) and classes[max(j for j in range(i) if classes[j] == "negation")] == "negation", "report" in classes[:i])
    insults, threats, lates = [], [], {}
    targeted = {i: near(i, "target", T.TARGET_SPAN) for i, c in enumerate(classes) if c == "insult"}
    for i in targeted:
        insults.append(("insult", *marks(i), targeted[i]))
    for j, c in enumerate(classes):
        if c == "target":
            waiting = [i for i in targeted if not targeted[i] and i < j <= i + T.TARGET_SPAN and "target" not in classes[i:j]]
            if waiting:
                lates[j] = marks(max(waiting))
            since = max([k for k in range(j) if classes[k] == "target"], default=-1)
            verbs = [marks(i) for i in range(since + 1, j) if classes[i] == "threat"]
            if verbs and j in lates:
                threats.append(("both", *lates.pop(j), False))
            elif verbs:
                threats.append(("threat", *min(verbs), False))
    return Counter(insults + threats + [("late", *m, False) for m in lates.values()])


def test_op4_composed_automaton_against_brute_force():
    import random

    rng = random.Random(12)
    names = [c for c in toxicity.CLASSES if c != "end"]
    kinds = list(toxicity.KINDS)
    for _ in range(3000):
        clause = rng.choices(names, weights=[5, 2, 1, 2, 2, 2], k=rng.randint(1, 14))
        state, found = 0, Counter()
        for name in clause:
            state, kind = toxicity.AUTOMATON[state][toxicity.CLASSES.index(name)]
            if kind >= 0:
                found[kinds[kind]] += 1
        assert found == brute_matches(clause), clause
        assert toxicity.AUTOMATON[state][0] == (0, -1)


@pytest.mark.parametrize("text", ["\u201cidiots\u201d", "\u2018idiot\u2019", "\u00a1idiota!", "\u00abidiot\u00bb", "you\u2014idiot", "'idiot' again", "''idiot", "they kill\u2026 you", "'kill' you", "\u201ckill\u201d you", "x_idiot", "7idiot"])
def test_op4_signs_beside_a_word_hide_nothing(text):
    """Features are those of the clauses, whatever stands beside a loaded word."""
    g = toxicity.Grammar(toxicity.Model(stems={"idiot": 3.0}))
    total = sum(g.clauses(text))
    assert total > 0
    assert g.features(text)[0] == np.log1p(total)
    assert g.features("\u201cstone\u201d \u00a1river!")[:3] == [0.0] * 3


def test_op5_mix(spark, nothing):
    rows = [(i, "t", "big" if i % 3 else f"s{i % 4}") for i in range(400)] + [(900, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, {"big": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.1}, block_rows=4, period=20).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, s in rows)
    place = {(r.source, r.block): r.block_slot for r in got}
    assert sorted(place.values()) == list(range(len(place)))
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 0.5, **{f"s{i}": 0.05 for i in range(10)}}, {"a": 3, "b": 2, "c": 2, "d": 1}])
def test_op5_deviates_by_less_than_a_block(weights):
    blocks = dict.fromkeys(weights, 500)
    slot = {}
    for s, stretches in mixing.phases(blocks, weights, 60).items():
        for first, n, places, stride in stretches:
            for b in range(n):
                slot[places[b % len(places)] + stride * (b // len(places))] = s
    assert sorted(slot) == list(range(sum(blocks.values())))
    share = {s: w / sum(weights.values()) for s, w in weights.items()}
    seen = Counter()
    for t in range(len(slot)):
        seen[slot[t]] += 1
        assert all(abs(seen[s] - share[s] * (t + 1)) < 1 for s in weights)
        if max(seen.values()) == 500:
            break


@pytest.mark.parametrize("weights", [{f"s{i}": 1 for i in range(20)}, {"a": 3, "b": 2, "c": 2, "d": 1}, {"a": 0.9991, "b": 0.0009}, {"a": 0.123456789, "b": 0.3, "c": 2 / 3, "d": 0.51}])
def test_op5_keeps_the_given_weights(weights):
    """Over many periods, against the weights themselves; after a source runs out, against those of the others from there on."""
    blocks = {s: 2000 + 700 * (i % 4) for i, s in enumerate(weights)}
    slot = {}
    for s, stretches in mixing.phases(blocks, weights, mixing.PERIOD).items():
        for first, n, places, stride in stretches:
            for b in range(n):
                slot[places[b % len(places)] + stride * (b // len(places))] = s
    assert sorted(slot) == list(range(sum(blocks.values())))
    left, live, seen, start = dict(blocks), dict(weights), Counter(), 0
    for t in range(len(slot)):
        s = slot[t]
        seen[s] += 1
        left[s] -= 1
        total = sum(live.values())
        assert all(abs(seen[x] - w / total * (t + 1 - start)) < 1 + 1e-9 for x, w in live.items())
        if not left[s]:
            live.pop(s)
            seen, start = Counter(), t + 1


def test_op5_small_and_odd_weights_over_a_million_slots():
    """0.7 and 0.0001 of the slots, neither more nor less by a block at any slot."""
    from fractions import Fraction

    weights = {"a": 0.7, "b": 0.2999, "c": 0.0001}
    blocks = {"a": 800_000, "b": 400_000, "c": 200}
    exact = {"a": Fraction(7, 10), "b": Fraction(2999, 10000), "c": Fraction(1, 10000)}
    for s, stretches in mixing.phases(blocks, weights, mixing.PERIOD).items():
        number = 0
        for first, n, places, stride in stretches:
            assert first == number
            number += n
            for b in range(n):
                slot = places[b % len(places)] + stride * (b // len(places))
                if slot >= 1_000_000:
                    break
                # Before its slot the source has first + b blocks, after it one more.
                assert abs(first + b - exact[s] * slot) < 1 and abs(first + b + 1 - exact[s] * (slot + 1)) < 1


def test_op5_refuses_what_the_driver_cannot_hold(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_ENTRIES", 1000)
    with pytest.raises(ValueError, match="denominator"):
        mixing.phases({"a": 5000, "b": 5000}, {"a": 0.123456789, "b": 0.3}, 512)
    assert mixing.tempered({"a": 10000, "b": 100}) == {"a": 1000, "b": 100}
    assert mixing.tempered({}) == {} and mixing.tempered({"a": 0, "b": 4}) == {"a": 100, "b": 200}


def test_op5_many_sources_keep_their_ratios():
    """2,000 sources from 10 rows to a million: every target within 1 % of the root of its size, and every source within a block of it."""
    counts = {f"s{i}": int(10 * 10 ** (5 * i / 1999)) for i in range(2000)}
    weights = mixing.tempered(counts)
    least = min(weights.values()) / 10**0.5
    assert all(abs(w / (least * counts[s] ** 0.5) - 1) < 0.01 for s, w in weights.items())
    assert len(set(weights.values())) > 1500
    blocks = {s: -(-n // 16) for s, n in counts.items()}
    began = time.process_time()
    table = mixing.phases(blocks, weights, mixing.PERIOD)
    assert time.process_time() - began < 60  # about 10 s here
    assert {s: sum(n for _, n, _, _ in own) for s, own in table.items()} == blocks
    taken = np.concatenate([np.array(places) for own in table.values() for _, _, places, stride in own if not stride])
    assert len(taken) == sum(blocks.values()) and len(np.unique(taken)) == len(taken) == taken.max() + 1
    # Until the first source runs out.
    end = min(own[-1][2][-1] for own in table.values())
    total = sum(weights.values())
    for s, own in table.items():
        slots = np.array(own[0][2])
        slots = slots[slots <= end]
        share = weights[s] / total * np.append(slots, end)
        done = np.append(np.arange(len(slots)), len(slots))
        assert (np.abs(done - share) < 1 + 1e-6).all()


def test_op5_shuffled_tables_odd_columns_and_repeats(spark, monkeypatch):
    rows = [(None, "s1", "x", 1, {"k": 1})] * 30 + [(i, f"s{i % 3}", "y", 2, None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, block string, salt int, m map<string,int>")
    whole = sorted(map(tuple, mixing.mix(docs, {"s0": 5, "s1": 3, "s2": 2}, block_rows=4).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", 0)
    again = mixing.mix(docs.repartition(5), {"s0": 5, "s1": 3, "s2": 2}, block_rows=4, keep=["doc_id", "block", "m"]).collect()
    assert Counter(r[0] for r in whole) == Counter(x[0] for x in rows) == Counter(r.row.doc_id for r in again)
    assert sorted((r[3], r[4]) for r in whole) == sorted((r.block_slot, r.place_in_block) for r in again)
    assert len({(r[3], r[4]) for r in whole}) == len(rows)


def test_op6_letters_beyond_the_basic_plane_and_null_ids(spark):
    """Scripts there don't collide, capitals are their small letters, signs are no letters; null ids are drawn by text."""
    e = language_id.Encoder(256)
    far = lambda p: e.trigrams("".join(map(chr, (p, p + 1, p + 2))))[0].tolist()
    assert len({tuple(far(p)) for p in (0x20000, 0x20000 + 6400, 0x20000 + 12800)}) == 3
    assert far(0x10400) == far(0x10428) != far(0x10400 + 6400)
    assert e.bundle("\U0001f600\U0001f601") is None and far(0x20000)[1] == (0x20000 << 42) | (0x20001 << 21) | 0x20002
    assert e.trigrams("ab \U0001f600 c")[0].tolist() == e.trigrams("AB c")[0].tolist()
    rows = spark.range(4000).selectExpr("cast(null as long) doc_id", "concat('text ', conv(id, 10, 36), ' some words') text", "'en' lang")
    assert 300 < language_id.drawn(rows, 400).count() < 500
    assert language_id.drawn(rows.limit(0)) is None and list(language_id.train(rows, 400, 64)) == ["en"]


def test_op6_languages(spark, documents, nothing):
    data = [(i, ("the thing and the other hand " if i % 2 else "die schöne und große ungen ") * 5, "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    prototypes = language_id.train(docs.where("doc_id < 30"))
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in language_id.identify(docs, prototypes).collect())
    odd = {r.doc_id: r for r in language_id.identify(documents, prototypes, keep=["doc_id", "row", "score"]).select("row.doc_id", "lang_pred", "score").collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (300, 301, 302))
    assert language_id.identify(nothing, prototypes).count() == 0
    assert language_id.train(nothing) == {}


def test_op6_bundles_against_their_definition():
    """Every trigram's letters bound one by one, and their sum."""
    e = language_id.Encoder(256)
    text = "Ab, ça!  x"
    padded = [32, *[ord(c) for c in "ab"], 32, *[ord(c) for c in "ça"], 32, ord("x"), 32]
    total = np.zeros(256)
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        total += np.array([e.letter(a)[(i - 2) % 256] * e.letter(b)[(i - 1) % 256] * e.letter(c)[i] for i in range(256)])
    assert (e.bundle(text) == total).all() and e.bundle("12 !") is None
    assert language_id.Encoder(256).bundle(text).tolist() == e.bundle(text).tolist()


def test_null_ids_repeats_clashing_columns_and_long_texts(spark):
    """Each operator's rows on such tables: as many as there are, equal for equal texts, whatever else the table holds."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977} and{i % 13} idiot" if i % 5000 == 0 else f"word{i % 977}" for i in range(120_000)) + " released under the MIT license"
    rows = [(None, "a plain text"), (None, "a plain text"), (None, None), (1, long), (2, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("row", "score", "lang_pred", "labels", "n_tokens", "class", "group", "salt", "piece", "window", "lang", "toxic", "key", "tie")})
    grammar = toxicity.Model(stems={"idiot": 3.0})
    protos = {"xx": language_id.Encoder().bundle("some words of a text").tolist()}
    found = {
        "toxicity": [(r.doc_id, r.score) for r in toxicity.score(docs, grammar).collect()],
        "language": [(r.doc_id, r.lang_pred) for r in language_id.identify(docs, protos).collect()],
        "licences": [(r.doc_id, (r.n_words, r.labels)) for r in licenses.scan_licenses(docs).collect()],
        "tokens": [(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, BPE).collect()],
        "fingerprint": [(r.doc_id, r.fingerprint) for r in fingerprints.fingerprint(docs).collect()],
        "join": [(r.doc_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()],
        "shard": [(r.doc_id, r.text_crc32) for r in sharding.shard(docs).collect()],
    }
    for name, got in found.items():
        assert Counter(i for i, _ in got) == Counter(i for i, _ in rows), name
        values = Counter(v for i, v in got if i is None)
        assert sorted(values.values()) in ([1, 2], [3]), name
        assert len({v for i, v in got if i == 2}) == 1, name
    value = {name: next(v for i, v in got if i == 1) for name, got in found.items()}
    assert value["licences"] == (120_000 + 24 * 2 + 5, "mit") and value["toxicity"] > 0.5
    assert Counter(v for i, v in found["join"]) == {1: 2, 2: 3, 0: 1}
    assert packing.pack(docs, BPE).where("piece = 0").count() == 6 and fingerprints.edited_fingerprints(docs).count() == 6


def test_op7_licences(spark, documents, nothing):
    cases = {
        "Released under the MIT License.": (5, 1, 1, 1, "mit", "mit"),
        "Apache-License; version 2! and apache license VERSION 2": (9, 2, 0, 5, "apache-2", "apache-2"),
        "CC BY-NC 4.0": (5, 1, 0, 0, "cc-by-nc", "cc-by-nc"),
        "under the License": (3, 0, None, None, "", ""),
        "licensed under the GNU General Public License, version 3.": (9, 0, None, None, "", "gpl-3"),
        "ünder the mit license": (4, 0, None, None, "", "mit"),
        "// SPDX-License-Identifier: GPL-3.0-only": (7, 0, None, None, "", "gpl-3"),
        "SPDX-License-Identifier: MIT OR Apache-2.0": (8, 0, None, None, "", "apache-2,mit"),
        "SPDX-License-Identifier: (Apache-2.0 OR MIT)\nno": (9, 0, None, None, "", "apache-2,mit"),
        "# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause": (17, 0, None, None, "", "bsd-3,gpl-2"),
        "SPDX-License-Identifier: BSD-3-Clause-Clear": (7, 0, None, None, "", ""),
        "Licensed under GPLv3, see there": (5, 0, None, None, "", "gpl-3"),
        "This is not the MIT license": (6, 0, None, None, "", ""),
        "not released under the MIT license": (6, 1, 2, 2, "mit", "mit"),
        "all rights are reserved": (4, 0, None, None, "", ""),
        "so: all rights reserved": (4, 0, None, None, "", "all-rights-reserved"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of all this software and associated documentation files, to deal in the software really without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. The software is provided as is": (93, 0, None, None, "", "mit"),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]
    assert got == list(cases.values())
    assert licenses.scan_licenses(documents).where("n_base > 0").count() == 0
    assert licenses.scan_licenses(documents).count() == documents.count()
    assert licenses.scan_licenses(nothing).count() == 0


def test_op7_index_against_every_alignment():
    """Labels are those of the templates that verify at any start, though words are changed, put in and left out.

    Every start is less strict than starts on which postings agree: a few short templates are found by it alone.
    """
    import random

    rng = random.Random(5)
    templates = licenses.templates_of(licenses.NOTICES, licenses.IDENTIFIERS)
    idf = {w: rng.random() for _, _, words in templates for w in words}
    index = licenses.Index(templates, licenses.BASE_PHRASES, idf)
    seen, found, missed = set(), 0, 0
    for _ in range(150):
        words = []
        for _, _, template in rng.sample(templates, 3):
            words += [b"filler%d" % rng.randrange(50) for _ in range(rng.randint(0, 12))]
            for w in template:
                x = rng.random()
                words += [] if x < 0.03 else [w, b"put"] if x < 0.06 else [b"changed"] if x < 0.09 else [w]
        text = b" ".join(words).decode()
        scanned = index.scan(text)
        base = {label for phrase, label in licenses.BASE_PHRASES.items() if f" {phrase} " in f" {text} "}
        every = {templates[t][0] for t in range(len(templates)) if any(index.verified(words, t, a) >= licenses.LEAST_SCORE for a in range(-len(templates[t][2]), len(words)))}
        assert base <= set(scanned.labels) <= every | base
        missed += len((every | base) - set(scanned.labels))
        found += len(scanned.labels)
        assert scanned.n_base == sum(len(re.findall(f"(?=(?<= ){phrase} )", f" {text} ")) for phrase in licenses.BASE_PHRASES)
        seen |= every
    assert len(seen) > 15 and missed <= 0.02 * found


def test_op7_idf_counts_files(spark):
    docs = spark.createDataFrame([(1, "mit mit"), (2, "the mit"), (3, None)], "doc_id long, text string")
    got = licenses.file_idf(docs, frozenset([b"mit", b"the", b"none"]))
    assert {w: round(v, 9) for w, v in got.items()} == {b"mit": round(float(np.log(4 / 3)), 9), b"the": round(float(np.log(4 / 2)), 9), b"none": round(float(np.log(4)), 9)}


def test_op8_neighbours(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(600, 24)).astype(np.float32)
    data[50:90] = data[40]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] + [1.0] * 23), (1060, [1.0] * 3), (1080, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest.nearest(vectors).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    x = data.astype(float)
    recall = []
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        recall.append(len(set(order) & {i for i, _ in found}) / 20)
        assert len(found) == 20 and all(abs(v - s[i]) < 1e-12 for i, v in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert np.mean(recall) >= 0.9
    assert got[60][:20] == [(i, got[60][0][1]) for i in [40, *range(50, 90)] if i != 60][:20]
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert nearest.nearest(few).count() == 4
    assert nearest.nearest(few.where("vec_id < 0")).count() == 0


def test_op8_ties_lengths_and_odd_rows(spark):
    """Many vectors at one score go by their ids, other lengths are searched among themselves, null ids take no part."""
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, size=(400, 10)).astype(float)
    data[:, 0] = 1.0
    rows = [(i, v.tolist(), "a", "b") for i, v in enumerate(data)] + [(1000 + i, [1.0, float(i)], "a", "b") for i in range(30)] + [(None, [1.0] * 10, "a", "b"), (7, data[7].tolist(), "x", "y")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, point string, score string")
    got = defaultdict(list)
    for r in nearest.nearest(vectors, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for low, x in ((0, data), (1000, np.array([[1.0, float(i)] for i in range(30)]))):
        for q in range(0, len(x), 20):
            s = (x * x[q]).sum(axis=1)
            assert got[low + q] == [(low + int(i), s[i]) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]


def test_op8_recall_of_clustered_vectors(spark):
    """Vectors with structure: few lists are visited and nearly all neighbours found."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    data = (centres[rng.integers(0, 60, 8000)] + 0.3 * rng.normal(size=(8000, 32))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(4)
    x = data.astype(float)
    turned = x @ nearest.rotation(32)
    centre = nearest.centroids(turned, 45)
    assert nearest.lists_to_visit(turned, centre, 20, 0.95) < 15
    got = defaultdict(set)
    for r in nearest.nearest(vectors).collect():
        got[r.query_id].add(r.vec_id)
    hits = [len(got[q] & {int(i) for i in np.argsort(-(x @ x[q]), kind="stable")[:21] if i != q}) / 20 for q in range(0, 8000, 20)]
    assert len(got) == 400 and np.mean(hits) >= 0.93


def test_op9_packs(documents, texts, nothing, tokenizer):
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts]
    rows = packing.pack(documents, BPE, max_tokens=512).collect()
    expected = Counter()
    for i, x in ids:
        first = len(x) % 512 or 512
        cuts = [0, *range(first, len(x) + 1, 512)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[(i, k, a, b - a, zlib.crc32(np.asarray(x[a:b], dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    first_fit: list[int] = []
    for length in sorted((r.length for r in rows), reverse=True):
        home = next((k for k, used in enumerate(first_fit) if used + length <= 512), None)
        if home is None:
            first_fit.append(length)
        else:
            first_fit[home] += length
    assert len(bins) <= len(first_fit)
    assert packing.pack(nothing, BPE).count() == 0


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_op9_plan_holds_every_capacity(score):
    counts = {700: 3, 300: 10, 90: 40, 5: 100}
    bins, items = defaultdict(list), Counter()
    for length, first, n, sequence, offset in packing.plan(counts, 1000, 6, 500_000, score=score):
        for k in range(n):
            bins[sequence + k].append((offset, length))
            items[length, first + k] += 1
    assert items == Counter({(length, k): 1 for length, n in counts.items() for k in range(n)})
    for pieces in bins.values():
        assert sum(x for _, x in pieces) <= 1000 and len(pieces) <= 6 and sum(x * x for _, x in pieces) <= 500_000
    with pytest.raises(ValueError):
        packing.plan({1001: 1}, 1000, 6, 10**9)


def brute_best_fit(lengths, caps, weights, score):
    """Piece after piece by falling length; the open sequences are tried one by one."""
    bins = []
    for length in sorted(lengths, reverse=True):
        need = (length, 1, length * length)
        best = None
        for i, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need)):
                r = [x / c for x, c in zip(left, caps)]
                u = [y / c for y, c in zip(need, caps)]
                value = sum((1 - x) * y * w for x, y, w in zip(r, u, weights)) if score == "dot" else -sum((x - y) ** 2 * w for x, y, w in zip(r, u, weights))
                if best is None or value > best[0] + 1e-12:
                    best = (value, i)
        if best is None:
            bins.append([x - y for x, y in zip(caps, need)])
        else:
            bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need)]
    return bins


@pytest.mark.parametrize("score", ["dot", "norm"])
@pytest.mark.parametrize("caps", [(1000, 1000, 10**6), (1000, 5, 10**6), (1000, 1000, 300_000), (1000, 6, 400_000)])
def test_op9_plan_against_brute_force(score, caps):
    """Each capacity binds in turn; sequences are as few as piece-by-piece best fit makes them, but for ties."""
    import random

    rng = random.Random(3)
    for _ in range(10):
        lengths = [rng.choice([500, 400, 333, 250, 120, 60, 7]) if rng.random() < 0.5 else rng.randint(1, 540) for _ in range(120)]
        rows = packing.plan(dict(Counter(lengths)), *caps, score=score)
        used = max(first + n for _, _, n, first, _ in rows)
        brute = brute_best_fit(lengths, caps, (1.0, 0.1, 0.1), score)
        assert abs(used - len(brute)) <= max(2, 0.06 * len(brute))
        if caps[1] < 10:
            assert used >= len(lengths) / caps[1]


def test_op9_capacities_bind_and_windows_hold(spark, documents, texts):
    from pyspark.sql import functions as F

    tight = packing.pack(documents, BPE, max_tokens=512, max_documents=2).groupBy("sequence_id").count().agg(F.max("count")).first()[0]
    assert tight == 2
    rows = packing.pack(documents, BPE, max_tokens=512, window=F.col("doc_id") % 3).collect()
    homes = defaultdict(set)
    for r in rows:
        homes[r.sequence_id].add(r.doc_id % 3)
    assert all(len(h) == 1 for h in homes.values())
    assert sorted(homes) == list(range(len(homes)))
    one = [(min(s for s, h in homes.items() if h == {k}), max(s for s, h in homes.items() if h == {k})) for k in range(3)]
    assert one[0][1] < one[1][0] and one[1][1] < one[2][0]
    odd = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (None, None, 2)], "doc_id long, text string, salt int")
    assert sorted((r.length, r.piece) for r in packing.pack(odd, BPE).collect()) == [(1, 0), (3, 0), (3, 0)]


def test_long_odd_texts_are_encoded_in_parts(tokenizer, monkeypatch):
    """Whatever their white space, signs and special strings are: the ids are those of the whole text."""
    import random

    from ledgerloom.llm import encoding

    monkeypatch.setattr(encoding, "LONG_CHARS", 50)
    monkeypatch.setattr(encoding, "CHUNK_CHARS", 20)
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "é", "日本", "12", "'s", ".", "x_y", "<|endoftext|>", "²", "🙂", "don't", " \u3000", "(", "'ll"]
    for special in (True, False):
        pool = parts if special else [p for p in parts if "<" not in p]
        some = ["".join(rng.choice(pool) for _ in range(rng.randint(40, 200))) for _ in range(400)]
        expected = [np.asarray(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(some, add_special_tokens=False)]
        encoder = SegmentEncoder(BPE, True)
        assert encoder._whole(some) == expected
        assert sum(len(list(encoder._parts(t))) > 1 for t in some) > 300
    glued = "".join(rng.choice(["abc", "7", ".", "é"]) for _ in range(500))
    assert len(list(encoder._parts(glued))) > 1 and encoder._whole([glued]) == [np.asarray(tokenizer.encode(glued, add_special_tokens=False).ids, dtype="<u4").tobytes()]
    assert not encoding.usual_pattern(public_tokenizers.path("word_bpe_49k.json")) and encoding.usual_pattern(BPE)


def test_op10_another_kind_of_file(documents, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(documents, path).collect())
    assert got == Counter((i, len(other.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)


def test_op10_counts(documents, texts, nothing, tokenizer):
    got = Counter(tuple(r) for r in token_counts.count_tokens(documents, BPE, limit=100).collect())
    expected = Counter()
    for i, t in texts:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        expected[(i, len((t or "").encode()), n, n > 100)] += 1
    assert got == expected
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(documents, path).collect())
    assert pieces == Counter((i, len(model.encode(t or ""))) for i, t in texts)
    assert token_counts.count_tokens(nothing, BPE).count() == 0
