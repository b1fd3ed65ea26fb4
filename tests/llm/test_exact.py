"""Exact deduplication and its index against plain dictionaries."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from codeloom.llm import exact


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    keep = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr)


def some(n, seed=1):
    r = random.Random(seed)
    words = ["a", "b", "a  b", "a\tb", "a\n b ", " a b", "", None, "é", "a b", "a b", "\x0b\x0c", "x" * 50000]
    rows = [(i, r.choice(words) if r.random() < 0.5 else f"text {i % (n // 2)}") for i in range(n)]
    rows += [(None, "a"), (None, "only null"), (None, "only null"), (5, "text 5"), (5, "a"), (5, "a")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [32, 1])
def test_against_plain(spark, docs_of, size):
    """With one byte of digest, keys collide, filters give false positives, and texts split the groups."""
    rows = some(400)
    assert sorted((tuple(r) for r in exact.dedup(docs_of(rows), size=size).collect()), key=repr) == plain(rows)


def test_no_documents(docs_of):
    assert exact.dedup(docs_of([])).collect() == []
    assert [tuple(r)[:4] for r in exact.dedup(docs_of([(3, None)])).collect()] == [(3, 3, 1, True)]


def test_copies_in_thousands(spark, docs_of):
    rows = [(i, "same  text" if i % 3 else f"own {i}") for i in range(6000)]
    assert sorted((tuple(r) for r in exact.dedup(docs_of(rows)).collect()), key=repr) == plain(rows)


def test_filter():
    r = np.random.default_rng(3)
    keys = r.integers(0, 2**63, 20000).astype(np.uint64)
    f = exact.CuckooFilter.of(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    other = r.integers(0, 2**63, 20000).astype(np.uint64)
    assert f.contains(other).mean() < 0.001
    f.delete(keys[:10000])
    assert f.contains(keys[10000:]).all() and f.contains(keys[:10000]).mean() < 0.001
    assert np.array_equal(exact.CuckooFilter.read(f.table.tobytes()).table, f.table)
    small = exact.CuckooFilter.of(100)
    assert not small.insert(keys)  # overflow


def test_index_over_batches(spark, docs_of, tmp_path, monkeypatch):
    """Batches in, some rows out, others in again: after each step the live digests are those of the rows, and the filters know all of them."""
    monkeypatch.setattr(exact, "PER_SHARD", 50)
    r = random.Random(5)
    index = exact.CuckooIndex(spark, str(tmp_path / "index"))
    live = []

    def keys(rows):
        return exact.digests(docs_of(rows))

    def check():
        again = exact.CuckooIndex(spark, str(tmp_path / "index"))
        want = defaultdict(list)
        for i, t in live:
            want[hashlib.sha256(norm(t).encode()).digest()].append(i)
        got = {bytes(x["key"]): (x["keep_id"], x["group_size"]) for x in again.live().collect()}
        assert got == {k: (min(v), len(v)) for k, v in want.items()}
        if live:
            assert {bytes(x["key"]) for x in again.maybe(keys(live)).collect()} == set(want)

    for step in range(3):
        batch = [(1000 * step + i, f"t {r.randint(0, 500)}") for i in range(150 * (step + 1))]
        found = {bytes(x["key"]): (x["keep_id"], x["group_size"]) for x in index.insert(keys(batch)).collect()}
        live = live + batch
        groups = defaultdict(list)
        for i, t in live:
            groups[norm(t)].append(i)
        touched = {norm(t) for _, t in batch if len(groups[norm(t)]) > 1}
        assert found == {hashlib.sha256(t.encode()).digest(): (min(groups[t]), len(groups[t])) for t in touched}
        check()
        gone = r.sample(live, 60)
        out = index.delete(keys([*gone, (999999, "t 1"), (gone[0][0], "never seen")]))
        assert out.count() == len(set(gone))
        live = [x for x in live if x not in gone]
        check()
    # what is gone is, but for a few false positives, unknown
    unknown = [(i, f"never {i}") for i in range(500)]
    assert index.maybe(keys(unknown)).count() < 5
    index.delete(keys(live))
    live = []
    check()


def test_a_filter_that_overflows_is_rebuilt(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "PER_SHARD", 40)
    index = exact.CuckooIndex(spark, str(tmp_path / "index"))
    first = [(i, f"a {i}") for i in range(40)]
    index.insert(exact.digests(docs_of(first)))
    size = sum(len(x["key"]) for x in index._filters().collect())
    more = [(100 + i, f"b {i}") for i in range(600)] + [(9000 + i, f"a {i}") for i in range(10)]
    found = index.insert(exact.digests(docs_of(more)))
    assert found.count() == 10 and {x["group_size"] for x in found.collect()} == {2}
    assert sum(len(x["key"]) for x in index._filters().collect()) > 4 * size
    assert index.maybe(exact.digests(docs_of(first + more))).count() == 640


def test_a_batch_that_fails_leaves_the_index(spark, docs_of, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index = exact.CuckooIndex(spark, path)
    index.insert(exact.digests(docs_of([(1, "a"), (2, "b")])))

    def fails(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(exact.CuckooIndex, "_finish", fails)
        with pytest.raises(RuntimeError):
            index.insert(exact.digests(docs_of([(3, "a"), (4, "c")])))
    again = exact.CuckooIndex(spark, path)
    assert again.version == 1 and again.live().count() == 2
    assert again.insert(exact.digests(docs_of([(3, "a"), (4, "c")]))).count() == 1
    assert again.live().count() == 3
