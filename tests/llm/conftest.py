from __future__ import annotations

import random

import pytest

WORDS = "the and that thing erst wh ou hand ing tion ent anor bleer stre reed on in at was thon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with copies, near copies, odd ones and a long one."""
    rng = random.Random(3)
    out = [(i, prose(rng, rng.randint(1, 200))) for i in range(40)]
    base = prose(rng, 120)
    out += [(100 + i, base) for i in range(3)]
    words = base.split()
    for i in range(8):
        w = list(words)
        for _ in range(i):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(9))
        out.append((200 + i, " ".join(w)))
    out += [(300, None), (301, ""), (302, "!!! ???"), (303, "one two"), (304, prose(rng, 6000)), (305, "a\n\n b  c\t<|endoftext|> d"), (305, "a\n\n b  c\t<|endoftext|> d"), (306, "é日本 ß 𝔘nicode ² ٣")]
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    """With a column whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], "doc_id long, text string, row string, score string, shard string").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
