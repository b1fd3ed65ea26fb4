"""Near-duplicate operators against brute force."""

import hashlib
import random

import numpy as np
import pytest

from codeloom.llm import embeddings, jaccard, substring
from codeloom.llm.common import components


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(t):
    w = lower(t or "").encode().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed, clusters=30):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    docs, passage = [], text(40)
    for _ in range(clusters):
        base = text(r.choice([1, 3, 6, 12, 30, 80, 300]))
        for _ in range(r.choice([1, 2, 4, 9])):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 25))):
                x[r.randrange(len(x))] = r.choice(vocab)
            docs.append(x[: max(1, int(len(x) * r.choice([1, 1, 0.9, 0.76])))])
    docs += [text(r.choice([2, 10, 20, 60])) + passage + text(10) for _ in range(40)]
    docs += [passage + text(r.randint(0, 12)) for _ in range(25)]
    docs += [["a"], ["a"], ["A"], ["a", "b"], [], ["the"] * 400, ["the"] * 401]
    r.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("hot", [2, 128])
def test_jaccard_matches_brute_force(docs_of, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    if hot == 2:  # groups of three are compared inside tasks, in small blocks
        monkeypatch.setattr(jaccard, "FEW", 2)
        monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = corpus(hot)
    sets = {i: shingles(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) > 40
    want = roots(ids, links)
    got = {r.doc_id: r for r in jaccard.join(docs_of(rows + [(5, rows[5][1]), (9000, None), (None, "a b c d e f")])).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in ids} == {i: (len(sets[i]), want[i]) for i in ids}
    assert (got[9000].n_shingles, got[9000].component_id) == (0, 9000)
    assert got[None].component_id is None


def test_every_linked_pair_of_sets_shares_enough_signatures():
    r = np.random.default_rng(1)
    for _ in range(400):
        s = int(r.choice([1, 2, 3, 4, 7, 8, 9, 20, 31, 33, 60, 128, 140, 400, 600]))
        a = r.integers(0, 2**64, s, dtype=np.uint64)
        b = np.concatenate([a[int(r.integers(0, s // 7 + 1)) :], r.integers(0, 2**64, int(r.integers(0, s // 7 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common):
            continue
        assert jaccard.may_link(jaccard.counts(a), jaccard.counts(b))
        x = {k: (set(v.tolist()), e) for v, k, e in jaccard.signatures(a)}
        y = {k: (set(v.tolist()), e) for v, k, e in jaccard.signatures(b)}
        assert any(len(x[k][0] & y[k][0]) >= max(x[k][1], y[k][1], 0) + 1 for k in x.keys() & y.keys())


def test_jaccard_of_documents_with_several_texts(docs_of):
    """A document is linked as any of its rows, also where one of them is a copy, or two are like one other document's."""
    r = random.Random(8)
    word = lambda: f"w{r.randrange(5000)}"
    a, b, c, d = ([word() for _ in range(40)] for _ in range(4))
    text = " ".join
    rows = [(1, text(a)), (2, text(a)), (2, text(b)), (3, text([*b, "more"])), (11, text(c)), (11, text(d)), (12, text([*c, "more"])), (13, text([*d, "more"])), (20, ""), (20, text(a[:20] + d[:20])), (21, "")]
    got = {x.doc_id: x.component_id for x in jaccard.join(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11, 13: 11, 20: 20, 21: 21}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_of_repeated_ids_matches_brute_force(docs_of, seed):
    r = random.Random(seed)
    texts = [t for _, t in corpus(seed, 12)]
    rows = [(r.randrange(len(texts) // 2), t) for t in texts] + [(r.randrange(len(texts)), r.choice(texts)) for _ in range(20)] + [(None, texts[0])]
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    want = roots({i for i, _ in sets}, links)
    got = jaccard.join(docs_of(rows)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got if x.doc_id is not None) == sorted((i, len(s), want[i]) for i, s in sets)
    assert [tuple(x) for x in got if x.doc_id is None] == [(None, None, None)]


def test_jaccard_without_rows(docs_of):
    assert jaccard.join(docs_of([]).limit(0)).collect() == []


def brute_substring(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in rows]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    return [(len(w), len(g), b" ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(words, gone, strict=True)]


def test_substring_matches_brute_force(docs_of):
    r = random.Random(4)
    vocab = [f"W{i}é" for i in range(500)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [text(n) for n in (34, 35, 36, 50, 120)]
    docs = []
    for _ in range(60):
        d = text(r.randint(0, 60))
        for p in r.sample(passages, r.randint(0, 3)):
            cut = r.randint(0, 10)
            d += p[cut:] + text(r.randint(0, 30))
        docs.append(d)
    docs += [["x"] * 80, ["x"] * 36, ["x"] * 34, ["y", "z"] * 40, [], docs[3], docs[3]]
    rows = [(i, " \t".join(d)) for i, d in enumerate(docs)] + [(None, " ".join(passages[4])), (7000, None), (7001, ""), (7002, "a\x0bb\xa0c\x1cd")]
    want = sorted((i is None, i or 0, *x[:2], hashlib.sha256(x[2]).hexdigest()) for (i, _), x in zip(rows, brute_substring(rows, 35), strict=True))
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_words, x.n_removed, hashlib.sha256(x.text.encode()).hexdigest()) for x in substring.dedup(docs_of(rows)).collect())
    assert got == want
    assert sum(x[3] for x in got) > 1000
    assert substring.dedup(docs_of([]).limit(0)).collect() == []


def test_embeddings_match_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((300, 32))
    rows = [b for b in base] + [b + r.standard_normal(32) * s for b, s in zip(base[:150], np.linspace(0.02, 0.4, 150), strict=True)]
    rows += [base[5] * 3, base[5], base[5] * 1e-30] + [base[7] + 0.001 * r.standard_normal(32) for _ in range(40)]
    table = [(i, [float(x) for x in v], 1, "k") for i, v in enumerate(rows)]
    n = len(table)
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] * 32]
    table += [(n + i, v, 1, "k") for i, v in enumerate(bad)] + [(None, table[0][1], 1, "k"), (n + 50, [1.0, 2.0], 1, "k"), (n + 51, [1.0, 2.0], 1, "k")]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int, codes string")
    got = {x.vec_id: x for x in embeddings.near(df).collect()}
    v = np.array(rows)
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(n))
    assert all(got[i].n_links <= link[i].sum() for i in range(n))
    assert found >= 0.99 * link.sum()
    want = roots(range(n), zip(*np.nonzero(link), strict=True))
    assert sum(got[i].component_id == want[i] for i in range(n)) >= 0.99 * n
    for i in range(len(bad)):
        assert (got[n + i].n_links, got[n + i].component_id, got[n + i].kept) == (0, n + i, True)
    assert got[n + 51].component_id == n + 50 and got[n + 51].n_links == 1
    assert got[None].component_id is None
    assert embeddings.near(df.limit(0)).collect() == []


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(100, 300), r.randint(100, 300)) for _ in range(150)] + [(500, 500), (7, 3)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == want[i] for i in want)


def test_different_vectors_of_one_id_are_all_searched(spark):
    """Two vectors with vec_id 1, the smallest of both groups; each has a near neighbour and an equal vector of its own."""
    a, b = [1.0] + [0.0] * 15, [0.0] * 15 + [1.0]
    near_a, near_b = [1.0, 0.01] + [0.0] * 14, [0.0] * 14 + [0.01, 1.0]
    rows = [(1, a), (1, b), (2, a), (3, b), (4, near_a), (5, near_b), (6, [0.0] * 7 + [1.0] + [0.0] * 8)]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {(1, 4, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 2, 1, False), (6, 0, 6, True)}
