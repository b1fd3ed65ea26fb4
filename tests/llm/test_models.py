"""Classifiers and language identification against plain versions, by the definitions alone."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeloom.llm import features, langid, quality, toxicity
from codeloom.llm.words import LOWER, U, mix, words

held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1


def plain_grams(text):
    """Counts of the letter n-grams (size, three code points) of a text; 0 is a boundary."""
    c = [0]
    for x in text or "":
        low = x.lower()
        c.append((ord(low) if len(low) == 1 else ord(x)) if x.isalpha() else 0)
    c = [x for i, x in enumerate(c) if x or not i or c[i - 1]]
    n = Counter()
    for i, x in enumerate(c):
        y, z = (*c[i + 1 : i + 3], 0, 0)[:2]
        if x:
            n[0, 0, 0, x] += 1
        if x or y:
            n[1, 0, x, y] += 1
        if y:
            n[2, x, y, z] += 1
    return n


def number(g):
    """The n-gram's place among equally frequent ones of a profile."""
    v = ((g[1] << 42 | g[2] << 21 | g[3]) * 3 + g[0]) & (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def test_language_matches_brute_force(docs_of, spark):
    r = random.Random(2)
    alphabet = {"en": "thequickbrown fox, and", "de": "überschäumende ßtraße und", "el": "ΑΒΓ αβγδ σς", "xx": "日本語 テキスト 12"}
    rows = [(i, "".join(r.choices(alphabet[k], k=r.randint(0, 400))), k) for i, k in enumerate(r.choices(list(alphabet), k=120))]
    rows += [(500, None, "en"), (501, "no label here", None), (502, "İĐ ªº Ǆ", "en"), (503, "1 2 3", "de"), (504, "a", "en"), (504, "a", "en")]
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id bigint, text string, lang string, gram string, n int")
    total = defaultdict(Counter)
    for i, t, k in rows:
        if t is not None and k is not None and not held(i):
            total[k] += plain_grams(t)
    rank = {k: {g: j for j, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], number(x[0])))[:300])} for k, n in total.items()}
    langs = sorted(rank)
    want = []
    for i, t, _ in rows:
        own = [g for g, _ in sorted(plain_grams(t).items(), key=lambda x: (-x[1], x[0]))[:300]]
        if not own:
            want.append((i, held(i), "und", 0.0))
            continue
        mean = [sum(abs(rank[k][g] - j) if g in rank[k] else 300 for j, g in enumerate(own)) / len(own) for k in langs]
        best = min(mean)
        want.append((i, held(i), langs[mean.index(best)], round(1 / sum(math.exp(-(m - best) / langid.TEMPERATURE) for m in mean), 9)))
    got = [(x.doc_id, x.held_out, x.lang_pred, round(x.score, 9)) for x in langid.identify(df).collect()]
    assert sorted(got) == sorted(want)


@pytest.fixture()
def rows():
    """A sample of 200 rows over 300 indicators, of which some tell the label."""
    r = np.random.default_rng(4)
    y = (r.random(200) < 0.4).astype(float)
    x = r.random((200, 300)) < np.where(np.arange(300) % 7 == 0, 0.05 + 0.2 * y[:, None], 0.06)
    at = np.concatenate([[0], np.cumsum(x.sum(axis=1))])
    return features.Sample(np.nonzero(x)[1], at, y[:, None]), x.astype(float), y


def test_hinge_reaches_the_optimum(rows):
    """The primal value at the model is within 1 % of the best that a long projected gradient ascent on the dual reaches."""
    sample, x, y = rows
    r = np.random.default_rng(1).random(300) + 0.5
    extra = np.random.default_rng(2).random((200, 2))
    w, b, v = features.hinge(sample, y, r, extra, passes=2000, tolerance=1e-6)
    full, sign = np.column_stack([x * r, np.ones(200), extra]), np.where(y > 0, 1.0, -1.0)
    primal = lambda m: m @ m / 2 + np.maximum(0, 1 - sign * (full @ m)).sum()
    q = (full * sign[:, None]) @ (full * sign[:, None]).T
    a, step = np.zeros(200), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20000):
        a = np.clip(a + step * (1 - q @ a), 0, 1)
    best = a.sum() - a @ q @ a / 2
    assert best - 1e-6 <= primal(np.concatenate([w, [b], v])) <= 1.01 * best


def test_log_count_ratio(rows):
    sample, x, y = rows
    p, n = (x * y[:, None]).sum(axis=0) + 1, (x * (1 - y)[:, None]).sum(axis=0) + 1
    want = np.where(x.any(axis=0), np.log(p / p.sum() / (n / n.sum())), 0)
    assert np.allclose(quality.log_count_ratio(sample, y, 300), want)


def plain_style(text):
    """The feature numbers of a text, one character and one word after the other."""
    data = (text or "").encode()
    sign = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]

    def kind(c):
        if 0x41 <= c <= 0x5A:
            return 3
        if 0x30 <= c <= 0x39:
            return 4
        if c in sign:
            return 7 + sign.index(c) % 25
        return {0x20: 5, 0x09: 5, 0x0A: 6, 0x0D: 6}.get(c, 1 if c < 0x20 else 2)

    k = [kind(c) for c in data]
    out = {k[i] << 10 | k[i + 1] << 5 | k[i + 2] for i in range(len(k) - 2)}
    base, at, before, shapes, prev = 1 << 15, 0, set(), [], None
    for w in data.split():
        at = data.index(w, at)
        ups, odd = sum(x == 3 for x in k[at : at + len(w)]), sum(x >= 7 or x == 4 for x in k[at : at + len(w)])
        low = bytes(LOWER[list(w)])
        again = 2 if low == prev else 1 if low in before and len(w) >= 6 else 0
        size = int(math.log2(min(max(len(w), 1), 31)))
        shapes.append(((size * 3 + min(ups, 2)) * 3 + (0 if odd == 0 else 1 if odd < 3 else 2)) * 3 + again)
        h = int(words(np.frombuffer(low, dtype=np.uint8), np.array([0, len(low)]))[2][0])
        out.add(base + 256 + (1 << 12) + (h & 0xFFFF))
        before.add(low)
        prev, at = low, at + len(w)
    out |= {base + s for s in shapes}
    out |= {base + 256 + int(mix(np.array([a * 135 + b], dtype=U))[0] & U(0xFFF)) for a, b in zip(shapes, shapes[1:], strict=False)}
    return sorted(out)


TEXTS = ["Plain words, and then Plain words again again.", "", None, "ALL CAPS!!! 123 %%% ***", "tab\tline\nline\r\nélan über élan", "x", "word " * 500 + "END", "\x00\x01 odd \x7f"]


def test_style_matches_a_plain_walk():
    data = "".join(t or "" for t in TEXTS).encode()
    off = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in TEXTS])])
    d, f = features.style(np.frombuffer(data, dtype=np.uint8), off)
    assert [sorted(f[d == i].tolist()) for i in range(len(TEXTS))] == [plain_style(t) for t in TEXTS]


def corpus(n):
    r = random.Random(3)
    good, bad = ["alpha", "beta", "gamma", "delta", "The", "of"], ["spam!!", "$$$", "CLICK", "zzz", "The", "of"]
    return [(i, " ".join(r.choices(bad if i % 3 == 0 else good, k=r.randint(3, 30))), int(i % 3 != 0), int(i % 3 == 0 and i % 2 == 0)) for i in range(n)]


def test_quality_scores_match_the_model(spark, docs_of):
    """Ratios, folds, model, shrinking and logistic curve put together from their parts, over plain features."""
    data = corpus(150)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in data], "doc_id bigint, quality int, toxic int")
    rows = [(i, t) for i, t, _, _ in data] + [(1000 + j, t) for j, t in enumerate(TEXTS)]
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality.score(docs_of(rows), labels).collect()}
    used = sorted((i, np.array(plain_style(t), dtype=np.int32).tobytes(), q) for i, t, q, _ in data if not held(i))
    parts, y = [np.frombuffer(f, dtype=np.int32) for _, f, _ in used], np.array([q for *_, q in used], dtype=float)
    pick = lambda at: features.Sample(np.concatenate([parts[i] for i in at]), np.concatenate([[0], np.cumsum([len(parts[i]) for i in at])]), y[at][:, None])
    fold, margin = features.folds(len(y)), np.zeros(len(y))
    for k in range(features.FOLDS):
        w, b = quality.fit(pick(np.flatnonzero(fold != k)), y[fold != k])
        for i in np.flatnonzero(fold == k):
            margin[i] = w[parts[i]].sum() + b
    a, shift = features.chance(margin, y)
    w, b = quality.fit(pick(np.arange(len(y))), y)
    for i, t in rows:
        p = 1 / (1 + math.exp(-(a * (w[plain_style(t)].sum() + b) + shift)))
        assert got[i] == (held(i), pytest.approx(p, abs=1e-9), int(p >= 0.5)), i


def test_chain_passes_out_of_fold_probabilities_on(spark, docs_of):
    """Each link is fitted on the earlier links' out-of-fold probabilities, and scores with their own ones."""
    data = corpus(150)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in data], "doc_id bigint, quality int, toxic int")
    rows = [(i, t) for i, t, _, _ in data] + [(1000 + j, t) for j, t in enumerate(TEXTS)]
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.score(docs_of(rows), labels).collect()}

    def lexicon(t):
        b = (t or "").encode()
        return features.lexicon(np.frombuffer(b, dtype=np.uint8), np.array([0, len(b)]))[1]

    used = sorted((i, lexicon(t).astype(np.int32).tobytes(), 1 - q, x) for i, t, q, x in data if not held(i))
    raw = [np.frombuffer(u[1], dtype=np.int32) for u in used]
    often = {f for f, n in Counter(int(f) for p in raw for f in p).items() if n >= toxicity.MIN_ROWS}
    place = {f: j for j, f in enumerate(sorted(often))}
    known = lambda fs: np.array([place[int(f)] for f in fs if int(f) in place], dtype=np.int64)
    parts = [known(p) for p in raw]
    earlier, links = np.zeros((len(parts), 0)), []
    fold = features.folds(len(parts))
    for column in (2, 3):
        y = np.array([u[column] for u in used], dtype=float)

        def fit(at, y=y, earlier=earlier):
            s = features.Sample(np.concatenate([parts[i] for i in at]), np.concatenate([[0], np.cumsum([len(parts[i]) for i in at])]), y[at][:, None])
            r = quality.log_count_ratio(s, y[at], len(place))
            w, b, v = features.hinge(s, y[at], r, earlier[at])
            return w * r, b, v

        margin = np.zeros(len(y))
        for k in range(features.FOLDS):
            w, b, v = fit(np.flatnonzero(fold != k))
            for i in np.flatnonzero(fold == k):
                margin[i] = w[parts[i]].sum() + b + earlier[i] @ v
        a, shift = features.chance(margin, y)
        links.append((a, shift, *fit(np.arange(len(y)))))
        earlier = np.column_stack([earlier, 1 / (1 + np.exp(-(a * margin + shift)))])
    for i, t in rows:
        p = []
        for a, shift, w, b, v in links:
            p.append(1 / (1 + math.exp(-(a * (w[known(lexicon(t))].sum() + b + np.array(p) @ v) + shift))))
        assert got[i] == (pytest.approx(p[0], abs=1e-9), pytest.approx(p[1], abs=1e-9)), i
