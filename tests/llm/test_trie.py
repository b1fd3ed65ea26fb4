"""The prefix trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from codeloom.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, key string, owner string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows, block=100, heads=6):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    turns = {c: [x[2] for x in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        first = c - (abs(c) % block) * (1 if c >= 0 else -1)
        built[c] = (*turns.get(first, [])[:h], *own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = {}
    for k, cs in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == k)))
        out[k] = (
            min(cs),
            len(k),
            min(members[k[:-1]]) if k else None,
            len(cs),
            sum(len(x) == len(k) + 1 for x in below),
            sum(not any(y[:-1] == x and y for y in members) for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "k", "o") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.trie(df, **kw).collect()), key=repr)


def some(seed, convs, words, long=0):
    r = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(r.randint(1, 9)):
            rows.append((c, t if r.random() > 0.05 else None, r.choice(["user", "assistant", None]), r.choice(words)))
    rows += [(convs[3], t, "user", r.choice(words)) for t in range(100, 100 + long)]
    rows += [(None, 1, "user", "x")] + r.sample(rows, 5)
    r.shuffle(rows)
    return rows


WORDS = ["a", "b", "", None, "ünï", "long text " * 50]


@pytest.mark.parametrize("bits", [64, 2])
def test_against_plain(spark, bits):
    convs = [*range(0, 12), *range(100, 112), *range(205, 209), -3, -100, -101, 10**12 + 1, 10**12]
    rows = some(7, convs, WORDS[:4])
    assert got(spark, rows, bits=bits) == plain(rows)


def test_a_conversation_over_many_tasks(spark):
    rows = some(3, list(range(30)), WORDS, long=400)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_and_small_blocks(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(40) for t in range(4)] + [(50, 0, "user", "t0")]
    assert got(spark, rows, block=10, heads=3) == plain(rows, 10, 3)


def test_no_turns(spark):
    assert got(spark, []) == []
    # shorter than their heads, whose conversation is absent: only the root is left
    bare = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, 0, "user", "x") for c in bare]
    assert got(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_ends_of_many_conversations(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 10000, 2)]
    assert got(spark, rows, heads=1) == plain(rows, heads=1)
