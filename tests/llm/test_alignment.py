"""Alignment of two tokenizers against whole texts, sets of offsets and one counter."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

from codeloom.llm import alignment


@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = alignment.vocabularies()
    a, b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
    a.encode_special_tokens = True
    table = alignment.byte_table()
    name = {i: t for t, i in a.get_vocab().items()}
    return a, b, lambda i: bytes(table[c] for c in name[i]), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def plain(tools, rows):
    a, b, bytes_a, bytes_b = tools
    found, counts = [], Counter()
    for i, t in rows:
        x, y = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        p, q = [bytes_a(k) for k in x], [bytes_b(k) for k in y]
        if not t or b"".join(p) != f" {t}".encode() or b"".join(q) != f" {t}".encode():
            found.append((i, 0, 0, [], ""))
            continue
        ends_a, ends_b = list(accumulate(map(len, p))), list(accumulate(map(len, q)))
        links = [(u, v) for u, e in zip(x, ends_a, strict=True) for v, f in zip(y, ends_b, strict=True) if e == f] if len(x) < 500 else [(dict(zip(ends_a, x, strict=True))[e], dict(zip(ends_b, y, strict=True))[e]) for e in sorted({*ends_a} & {*ends_b})]
        cuts = sorted({*ends_a} & {*ends_b})
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(u) for u, e in zip(x, ends_a, strict=True) if lo < e <= hi) + "|" + ",".join(str(v) for v, e in zip(y, ends_b, strict=True) if lo < e <= hi))
        found.append((i, len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(links)
    best = Counter()
    for (u, v), n in counts.items():
        best[v] = max(best[v], n)
    return sorted(((i, x, y, len(k), len(k), sum(counts[z] == best[z[1]] for z in k), sum(counts[z] for z in k), h) for i, x, y, k, h in found), key=repr)


ODD = ["", None, " ", "  ", "a", " lead", "trail ", "trail  \n", "two  spaces", "\n\n x\n  y", "a\r\nb);\r\n}", "tab\tx\t\ty", "a b　c  d", "é ﬁ Å İ ß", "漢字かな交じり文 text", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ under ▁▁bar", "\x00 \x1c\x1d a\x1e b", "🙂🙂 ok 👩‍👩‍👧", "don't we'll I'M", "1234 12,345.67", "        eight", "x" * 5000, "ab" * 3000 + " " * 50 + "c"]


def got(docs, **kw):
    return sorted((tuple(r) for r in alignment.align(docs, **kw).collect()), key=repr)


def test_against_plain(tools, docs_of):
    r = random.Random(2)
    bits = ["the", " of", "\n", "\r", " ", "  ", "ing", "Z", "é", "、", "'s", "9", "\t", " ", "<s>", "▁"]
    rows = list(enumerate(ODD)) + [(100 + i, "".join(r.choice(bits) for _ in range(r.randint(1, 60)))) for i in range(300)] + [(1, "again"), (None, "the the"), (None, None), (1, "again")]
    assert got(docs_of(rows)) == plain(tools, rows)
    # one shard for each few ids, and every batch a salt of its own
    assert got(docs_of(rows).repartition(5), shards=7, salt_bytes=1) == plain(tools, rows)


def test_given_documents(tools, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == plain(tools, rows)


def test_units_tell_what_whole_texts_do(tools):
    tool = alignment.aligner(alignment.vocabularies())
    assert tool.mark  # the vocabulary allows units
    r = random.Random(4)
    texts = ["".join(chr(r.choice([r.randint(32, 126), r.randint(9, 13), 32, 10, r.randint(160, 600), 0x3000, 0x2028])) for _ in range(80)) for _ in range(500)]
    numbers, hashes, _, _ = tool.batch(texts)
    for t, n, h in zip(texts, numbers, hashes, strict=True):
        want = tool.whole(t)
        expected = ((want[0], want[1], len(want[3])), hashlib.sha256(want[2].encode()).hexdigest()) if want else ((0, 0, 0), "")
        assert (tuple(int(x) for x in n), h) == expected


def test_no_documents(docs_of):
    assert got(docs_of([])) == []
    assert got(docs_of([(1, None)])) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_forgetting(tools, docs_of, monkeypatch):
    tool = alignment.Aligner(*alignment.vocabularies())
    monkeypatch.setattr(alignment, "REMEMBER", 200)
    first = tool.batch(["some text here", "and more"])
    second = tool.batch(["some text here", "and more"])
    assert (first[0] == second[0]).all() and first[1] == second[1] and len(tool.known) == 5
