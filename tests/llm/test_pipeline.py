"""The pipeline, stage by stage, against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as cp
from codeloom.llm import pack, quality, secrets
from codeloom.llm.common import read, written

from test_pairs import roots, shingles


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return _WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def contaminated(texts, items):
    """The ids of texts, by id, in which 1 word in 20 or more lies in a window of an item."""
    windows = set()
    for x in items:
        w = item_words(x)
        n = min(13, len(w))
        windows.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    lengths = {len(x) for x in windows}
    out = set()
    for i, t in texts.items():
        w, hit = item_words(t), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(i)
    return out


def pieces(tok, text):
    ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
    return [(p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], dtype="<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]


def check_packed(rows, docs):
    """rows: the packed stage's; docs: (doc_id, text). Every piece once, sequences without gaps, as few as a bound allows."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pack.vocabulary())
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter((i, *x) for i, t in docs for x in pieces(tok, t))
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in rows) // 2048) + 1 + len(rows) // 50


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality_filter", "near_duplicates", "benchmark_free", "secret_free", "packed"]
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = read(spark, sf_dir, "labels")
    judged = {r.doc_id: r.predicted for r in quality.score(docs, labels).collect()}

    kept = written(cp.STAGES[0][1](spark, docs, sf_dir))
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == columns and set(texts) == {i for i in before if judged[i] == 1}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(before)
    assert len(good & set(texts)) >= 0.98 * len(good)

    one = written(cp.STAGES[1][1](spark, kept, sf_dir))
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    link = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(ids, link)
    texts = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == columns and set(texts) == {i for i in ids if root[i] == i}

    free = written(cp.STAGES[2][1](spark, one, sf_dir))
    left = {r.doc_id for r in free.collect()}
    bad = contaminated(texts, [r.text for r in read(spark, sf_dir, "benchmark").collect()])
    assert free.columns == columns and bad and left == set(texts) - bad

    clean = written(cp.STAGES[3][1](spark, free, sf_dir))
    rows = clean.collect()
    assert clean.columns == columns and {r.doc_id for r in rows} == left
    for r in rows:
        assert r.n_chars == len(r.text)
        if not secrets.base_spans(texts[r.doc_id]):
            assert "<secret>" in r.text or r.text == texts[r.doc_id]
        assert not secrets.base_spans(r.text)

    check_packed(cp.STAGES[4][1](spark, clean, sf_dir).collect(), [(r.doc_id, r.text) for r in rows])

    whole = cp.run(spark, sf_dir)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packed(whole.collect(), [(r.doc_id, r.text) for r in rows])


def test_stages_take_empty_and_odd_documents(spark, docs_of, sf_dir):
    """Nulls, an empty and two equal long texts, repeated rows, an id with two texts, clashing columns: the rows each stage keeps, exactly."""
    long = "some words and more of them, " * 12000
    rows = [(1, None), (2, ""), (None, "null id"), (3, "twice and more words"), (3, "twice and more words"), (3, "token=abcdef123 here"), (5, long), (4, long), (6, "İ")]
    odd = docs_of(rows)
    judged = defaultdict(list)
    for r in quality.score(odd, read(spark, sf_dir, "labels")).collect():
        judged[r.doc_id].append(r.predicted)
    want = {
        "quality_filter": [x for x in rows if x[0] is None or 0 not in judged[x[0]]],
        "near_duplicates": [x for x in rows if x[0] != 5],
        "benchmark_free": rows,
        "secret_free": [(i, t.replace("token=abcdef123", "<secret>") if t else t) for i, t in rows],
    }
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns
        got = out.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(want[name]), name
        assert all((r.key, r.words, r.sig, r.spans) == ("x", "y", 3, "w") for r in got)
    check_packed(cp.STAGES[4][1](spark, odd, sf_dir).collect(), rows)
    for _, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).collect() == []
