r"""Secret scans: three fixed kinds, and a battery of randomness tests for other tokens.

Kinds (leftmost matches that do not overlap, per kind; failing matches are dropped):

- assign: (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+), the
  names in either case of A-Z, group 2 of 6 or more characters; the span is the whole match;
- access: AKIA[A-Z0-9]+ of 20 or more characters;
- hex: [0-9a-f]+ of 24 or more characters;
- random: added by the tests, outside the spans above; digits alone are numbers, not keys.

Tests: a candidate is a run of [A-Za-z0-9+/_=-] of MIN_RANDOM or more characters, but for tokens that are ordinary (`ordinary`: words,
and compounds of words and numbers whose parts are long) and whose letters follow each other as in words, and for digits alone (24 or more are of kind hex; fewer
are a number, and random numbers cannot be told from ordinary ones, as both are uniform). Its encoding
(base26, hex, base32, base36, base52, base62 or base64) is inferred from its characters. Under
uniform random text of that encoding six z values are near 0: chi-squared of the characters' counts,
chi-squared of the counts of the classes (digits, lower, upper, other; of base26 vowels and consonants), the number of changes of class, the
number of runs of values above and below the middle, the lag-one serial correlation, and the transitions between letters, as the log-likelihood
ratio of each to what follows it in the corpus's words (a table of 26 x 26 counts over all documents) and in uniform text. The score is the
largest departure.

Candidates belong to families: letters of one case, no upper case, no lower case, mixed. The ordinary tokens without digits, of MIN_NULL characters or more, of the whole corpus are the
null of each: put into the family's case they are scored as its candidates are and give, per length class, the chance that an ordinary
token looks as random as a candidate. Other length classes speak too, their scores scaled
by the root of the length (as departures grow), the less the more ordinary tokens a class has of its own. Within each family and
length class the Benjamini-Hochberg step-up rule over all candidates of the corpus picks the threshold, so
that about ALPHA of what is reported there is ordinary. Both counts are taken over all documents, as a table
of bounded size (families x length classes x score bins). PRIOR further ordinary tokens, of scores spread over those that are far from random, belong to
every null, so that a small corpus, or one file, is judged too. The chance is never taken below one in the number of ordinary tokens.

Cost: one pass over the texts counts transitions, and another one in Arrow batches gives a row per document with a span or a candidate;
that table is small and is written once. No text is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sized, written
from .words import batches

KINDS = ("assign", "access", "hex", "random")
ALPHA = 0.01
MIN_RANDOM = 16
#: Ordinary tokens count from this length on.
MIN_NULL = 12
#: Ordinary tokens whose scores a task remembers; beyond it, it starts anew.
REMEMBER = 100_000
#: Scores above this many standard deviations share a bin; bins are this wide.
BIN, BINS = 0.25, 64
#: Ordinary tokens that are taken for granted in every family and length class; their scores lie evenly in the bins from FAR on.
PRIOR, FAR = 200, 16
#: Letters follow each other as in words from so many standard deviations on.
WORDLIKE = 3.0
#: So much is taken off the departure of transitions, whose law has a longer tail towards words than the other tests'.
SKEW = 1.0
#: With so many ordinary tokens of its own, a length class gives those of the others half their weight.
ENOUGH = 1000

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars.encode())] = True
    return t


_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IS_TOKEN = _table(_DIGIT + _LOWER + _UPPER + "+/_=-")
#: Encodings, narrowest first; a token has the first that holds all its characters.
ENCODINGS = (("base26", _LOWER), ("BASE26", _UPPER), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _LOWER + _DIGIT), ("BASE36", _UPPER + _DIGIT), ("base52", _UPPER + _LOWER), ("base62", _UPPER + _LOWER + _DIGIT), ("base64", _UPPER + _LOWER + _DIGIT + "+/"), ("base64url", _UPPER + _LOWER + _DIGIT + "-_"), ("mixed", _UPPER + _LOWER + _DIGIT + "+/-_"))
_CLASS = np.full(256, 3, dtype=np.int64)
for _i, _chars in enumerate((_DIGIT, _LOWER, _UPPER)):
    _CLASS[list(_chars.encode())] = _i
#: The classes of letters of one case: vowels and consonants.
_SOUND = np.zeros(256, dtype=np.int64)
_SOUND[list(b"aeiouAEIOU")] = 1
_VOWELS = re.compile("[aeiouyAEIOUY]")
_HARD_CLUSTER = re.compile("[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{5}")
_CLUSTER = re.compile("[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{7}")
FAMILIES = ("letters", "lower", "upper", "mixed")
#: A part of a compound: a word, upper-case letters, or a number.
_DIGITS = re.compile("[0-9]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+")
_RANK = []
for _, _chars in ENCODINGS:
    _r = np.full(256, -1, dtype=np.int64)
    _r[list(_chars.encode())] = np.arange(len(_chars))
    _RANK.append(_r)
#: By encoding, its classes and the share of each among its characters.
_CLASSES = [_SOUND if len(c) == 26 else _CLASS for _, c in ENCODINGS]
_SHARE = [np.bincount(t[list(c.encode())], minlength=4) / len(c) for t, (_, c) in zip(_CLASSES, ENCODINGS, strict=True)]


#: By family, the encoding that letters alone are held against.
_BARE = [[name for name, _ in ENCODINGS].index(x) for x in ("base26", "base36", "base32", "base52")]


def ordinary(token: str) -> bool:
    """Whether a token is a word, or a compound whose parts (words, numbers) have 3 characters on average, 5 if some are digits.

    28 % of the letters of words are vowels, and no 7 consonants follow each other; parts of letters alone have 3.5 characters on average."""
    letters = sum(c.isalpha() for c in token)
    if len(_VOWELS.findall(token)) < 0.28 * letters or _CLUSTER.search(token):
        return False
    parts = _PART.findall(token)
    if letters == len(token):
        return token.islower() or 2 * letters >= 7 * len(parts)
    return sum(map(len, parts)) >= (5 if any(p.isdigit() for p in parts) else 3) * max(len(parts), 1)


def family(token: str) -> int:
    """The place in FAMILIES of a candidate."""
    if token.isalpha() and (token.islower() or token.isupper()):
        return 0
    return 1 if token == token.lower() else 2 if token == token.upper() else 3


def as_null(token: str) -> Iterator[tuple[int, str]]:
    """(family, form) of an ordinary token: the forms that it has among the candidates of each family. None of a token that reads
    little like words (a third of its letters are vowels, and no 5 consonants follow each other): it may be a key."""
    letters = "".join(c for c in token if c.isalpha())
    if 3 * len(_VOWELS.findall(letters)) < len(letters) or _HARD_CLUSTER.search(letters):
        return
    if len(letters) >= MIN_NULL:
        yield from ((0, letters.lower()), (1, letters.lower()), (2, letters.upper()))
    yield 3, token if family(token) == 3 else token.capitalize()


def _encoding(b: np.ndarray, letters: bool) -> int:
    """The place in ENCODINGS of the narrowest encoding that holds all characters; -1 if none does."""
    for i, (rank, (_, chars)) in enumerate(zip(_RANK, ENCODINGS, strict=True)):
        if (letters or len(chars) != 26) and rank[b].min(initial=0) >= 0:
            return i
    return -1


_LETTER = np.full(256, -1, dtype=np.int64)
for _chars in (_LOWER, _UPPER):
    _LETTER[list(_chars.encode())] = np.arange(26)


def transitions(counts: np.ndarray) -> np.ndarray:
    """Of 26 x 26 counts of letters that follow each other: the log-likelihood ratio of each pair, to uniform text, one added to every count."""
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + 26)
    return np.log(p * 26)


def wordlike(b: np.ndarray, pairs: np.ndarray | None, chars: str = _LOWER) -> np.ndarray:
    """For tokens of equal length, how far their letters' transitions are from uniform ones (of the letters among chars) towards those of
    words, in standard deviations; 0 for fewer than 4 transitions."""
    own = np.unique(_LETTER[list(chars.encode())])
    own = own[own >= 0]
    if pairs is None or b.shape[1] < 2 or len(own) < 2:
        return np.zeros(len(b))
    among = pairs[np.ix_(own, own)]
    if among.std() < 1e-6:
        return np.zeros(len(b))
    c = _LETTER[b]
    ok = (c[:, 1:] >= 0) & (c[:, :-1] >= 0)
    n = ok.sum(axis=1)
    total = np.where(ok, pairs[c[:, :-1], c[:, 1:]], 0.0).sum(axis=1)
    return np.where(n >= 4, (total - n * among.mean()) / (among.std() * np.sqrt(np.maximum(n, 1))), 0.0)


def departures(b: np.ndarray, encoding: int, pairs: np.ndarray | None = None) -> np.ndarray:
    """For tokens of equal length (a row of bytes each), the largest departure, in standard deviations, from uniform random text of the
    encoding; pairs: see transitions. Shorter than 2 characters, or of one character only: far from random."""
    k, share, n = len(ENCODINGS[encoding][1]), _SHARE[encoding], b.shape[1]
    if n < 2:
        return np.full(len(b), BIN * BINS)
    v = _RANK[encoding][b]
    rows = np.arange(len(b))[:, None]
    count = np.bincount((rows * k + v).ravel(), minlength=len(b) * k).reshape(len(b), k)
    chi = ((count - n / k) ** 2).sum(axis=1) * k / n
    z_chi = (chi - (k - 1)) / np.sqrt(2 * (k - 1) * (1 - 1 / n))
    up = v * 2 >= k
    p = up.mean(axis=1)
    expected = 1 + 2 * n * p * (1 - p)
    runs = 1 + (up[:, 1:] != up[:, :-1]).sum(axis=1)
    z_runs = (runs - expected) / np.maximum(np.sqrt(np.maximum((expected - 1) * (expected - 2) / (n - 1), 0)), 0.5)
    c = v - v.mean(axis=1, keepdims=True)
    z_serial = (c[:, 1:] * c[:, :-1]).sum(axis=1) / np.maximum((c * c).sum(axis=1), 1e-9) * np.sqrt(n) + 1 / np.sqrt(n)
    worst = np.maximum(np.maximum(np.abs(z_chi), np.abs(z_runs)), np.maximum(np.abs(z_serial), wordlike(b, pairs, ENCODINGS[encoding][1]) - SKEW))
    some = share > 0
    if some.sum() > 1:
        cls = _CLASSES[encoding][b]
        # chi-squared of few degrees of freedom by its cube root; only too large counts
        free, want = int(some.sum()) - 1, n * share[some]
        have = np.bincount((rows * 4 + cls).ravel(), minlength=len(b) * 4).reshape(len(b), 4)[:, some]
        x = ((have - want) ** 2 / want).sum(axis=1)
        z_class = ((x / free) ** (1 / 3) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free))
        same = float((share**2).sum())
        spread = (n - 1) * same * (1 - same) + 2 * (n - 2) * (float((share**3).sum()) - same**2)
        z_change = ((cls[:, 1:] != cls[:, :-1]).sum(axis=1) - (n - 1) * (1 - same)) / np.sqrt(spread)
        worst = np.maximum(worst, np.maximum(z_class, np.abs(z_change)))
    return np.where((v == v[:, :1]).all(axis=1), BIN * BINS, worst)


def randomness(token: bytes, letters: bool = True, pairs: np.ndarray | None = None) -> tuple[str, float]:
    """The encoding of a token and its departure from it; padding (=) at the end is left out. Without `letters`,
    letters of one case are held against the encodings with digits."""
    b = np.frombuffer(token.rstrip(b"="), dtype=np.uint8)
    i = _encoding(b, letters)
    return ("mixed", BIN * BINS) if i < 0 else (ENCODINGS[i][0], float(departures(b[None, :], i, pairs)[0]))


def _long_runs(mask: np.ndarray, least: int, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `least` or more set places; a run ends where a text does (off: the texts' limits)."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    inner = np.unique(off[(off > 0) & (off < len(mask))])
    cut = inner[mask[inner] & mask[inner - 1]]
    s, e = np.sort(np.concatenate([edge[::2], cut])), np.sort(np.concatenate([edge[1::2], cut]))
    long = e - s >= least
    return s[long], e[long]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed kinds in code points, by start and then kind."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


_BASE = "base array<struct<start:int,end:int,kind:int>>"
_FOUND = f"doc_id bigint, key bigint, {_BASE}, tokens array<struct<start:int,end:int,encoding:string,family:int,class:int,bin:int>>, words array<struct<family:int,class:int,bin:int,n:bigint>>"


@cache
def _length_class(n: int) -> int:
    return min(int(np.floor(np.log2(n / MIN_RANDOM) * 2)), 8)


def _null_scores(tokens: list[bytes], pairs: np.ndarray | None = None) -> dict[bytes, list[tuple[int, int, int]]]:
    """By token, (family, length class, bin) of each form of an ordinary token without digits; none of any other."""
    out: dict[bytes, list[tuple[int, int, int]]] = {}
    groups: dict[tuple[int, int], list[tuple[bytes, int, int, bytes]]] = defaultdict(list)
    for t in tokens:
        out[t] = []
        token = t.decode()
        if not _DIGITS.search(token) and ordinary(token):
            for k, form in as_null(token):
                bare = form.encode().rstrip(b"=")
                i = _BARE[k] if form.isalpha() else _encoding(np.frombuffer(bare, dtype=np.uint8), True)
                groups[i, len(bare)].append((t, k, _length_class(len(form)), bare))
    for (i, n), rows in groups.items():
        score = departures(np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8).reshape(len(rows), n), i, pairs) if i >= 0 else np.full(len(rows), BIN * BINS)
        for (t, k, c, _), z in zip(rows, np.minimum(score / BIN, BINS).astype(int).tolist(), strict=True):
            out[t].append((k, c, z))
    return out


def _pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): letters that follow each other, as 26 * first + second; tokens as long as a key tell nothing unless they are ordinary."""
    total = np.zeros(26 * 26, dtype=np.int64)
    known: dict[bytes, bool] = {}
    for _, data, off in batches(it):
        c = _LETTER[data]
        starts, ends = _long_runs(_IS_TOKEN[data], MIN_RANDOM, off)
        raw = data.tobytes()
        if len(known) > REMEMBER:
            known.clear()
        odd = np.zeros(len(data) + 1, dtype=np.int32)
        for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
            t = raw[x:y]
            if t not in known:
                known[t] = ordinary(t.decode())
            if not known[t]:
                odd[x] += 1
                odd[y] -= 1
        c[np.cumsum(odd[:-1]) > 0] = -1
        ok = (c[1:] >= 0) & (c[:-1] >= 0)
        inner = off[(off > 0) & (off < len(data))]
        ok[inner - 1] = False  # texts do not follow each other
        total += np.bincount((26 * c[:-1] + c[1:])[ok], minlength=26 * 26)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])


def pair_weights(docs: DataFrame) -> np.ndarray:
    """The transitions of all texts."""
    rows = docs.select("text").mapInArrow(_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 676
    counts = np.zeros(26 * 26)
    for r in rows:
        counts[r["pair"]] = r["n"]
    return transitions(counts.reshape(26, 26))


def _word(token: str, pairs: np.ndarray) -> bool:
    """Whether a token is ordinary, and its letters follow each other as in words (or there is nothing to tell that by)."""
    return ordinary(token) and (pairs.std() < 1e-6 or float(wordlike(np.frombuffer(token.encode(), dtype=np.uint8)[None, :], pairs)[0]) >= WORDLIKE)


def _scan(it: Iterator[pa.RecordBatch], pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, base, tokens, words): base spans and candidates of a text; words, on a chunk's first row: the numbers of its ordinary tokens."""
    base_t = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
    tok_t = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("family", pa.int32()), ("class", pa.int32()), ("bin", pa.int32())]))
    word_t = pa.list_(pa.struct([("family", pa.int32()), ("class", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))
    known: dict[bytes, list[tuple[int, int, int]]] = {}
    for b, data, off in batches(it):
        # tokens and the documents that may hold something, found on the bytes of the whole chunk (a hex run is a token run too)
        starts, ends = _long_runs(_IS_TOKEN[data], MIN_NULL, off)
        raw = data.tobytes()
        low = raw.lower()
        words: Counter = Counter()
        if len(known) > REMEMBER:
            known.clear()
        tokens = [raw[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        known |= _null_scores([t for t in dict.fromkeys(tokens) if t not in known], pairs)
        for t in tokens:
            words.update(known[t])
        tok_at = starts[ends - starts >= MIN_RANDOM]
        first = np.searchsorted(tok_at, off)
        bases, toks = [], []
        for i in range(len(b)):
            s, e = int(off[i]), int(off[i + 1])
            named = any(low.find(x.encode(), s, e) >= 0 for x in _NAMES)
            if not (named or first[i] < first[i + 1] or raw.find(b"AKIA", s, e) >= 0):
                bases.append([]), toks.append([])
                continue
            text = raw[s:e].decode()
            base = base_spans(text)
            found = []
            at = far = 0  # the base spans that start before the token's end, and how far they go
            for m in _TOKEN.finditer(text):
                x, y = m.span()
                while at < len(base) and base[at][0] < y:
                    far = max(far, base[at][1])
                    at += 1
                token = m.group()
                if far > x or token.isdigit():
                    continue
                if not _word(token, pairs):
                    name, score = randomness(token.encode(), pairs=pairs)
                    found.append({"start": x, "end": y, "encoding": name, "family": family(token), "class": _length_class(y - x), "bin": min(int(score / BIN), BINS)})
            bases.append([{"start": x, "end": y, "kind": k} for x, y, k in base]), toks.append(found)
        counted = [[{"family": k, "class": c, "bin": z, "n": n} for (k, c, z), n in words.items()]] + [[]] * (len(b) - 1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bases, base_t), pa.array(toks, tok_t), pa.array(counted, word_t)], names=["doc_id", "key", "base", "tokens", "words"])


def thresholds(counts: list[tuple[int, int, int, bool, int]], alpha: float = ALPHA) -> dict[tuple[int, int], int]:
    """By family and length class, the number of score bins that are reported (from 0 up), by Benjamini-Hochberg.

    counts: (family, class, bin, null, number)."""
    return {(k, c): n for k in sorted({x[0] for x in counts}) for c, n in _thresholds([x[1:] for x in counts if x[0] == k], alpha).items()}


def _thresholds(counts: list[tuple[int, int, bool, int]], alpha: float) -> dict[int, int]:
    """The same for one family. The chance of an ordinary token of the class to score in the
    first b bins, with one added token that does (so it is never 0), is the candidates' p value."""
    out = {}
    tables = {k: np.zeros((2, BINS + 1)) for k in {x[0] for x in counts}}
    for k, b, is_null, n in counts:
        tables[k][0 if is_null else 1, b] += n
    for c in sorted(tables):
        null, other = tables[c][0].copy(), tables[c][1]
        null[FAR:] += PRIOR / (BINS + 1 - FAR)
        weight = ENOUGH / (ENOUGH + null.sum())
        for j in tables:
            if j != c:  # departures grow as the root of the length; a length class is the root of 2 longer than the one before
                grown = np.minimum(np.arange(BINS + 1) * 2 ** ((c - j) / 4), BINS).astype(int)
                null += weight * np.bincount(grown, weights=tables[j][0], minlength=BINS + 1)
        p = (np.cumsum(null) + 1) / (null.sum() + 1)
        seen = np.cumsum(other)
        ok = np.flatnonzero((seen > 0) & (p * other.sum() <= alpha * seen))
        out[c] = int(ok[-1]) + 1 if len(ok) else 0
    return out


def scan(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per row of docs: doc_id, key (xxhash64 of the text), spans: array of (start, end, kind 0-3, encoding) by start, then kind.

    docs: doc_id (bigint), text; other columns are ignored. A null or empty text has no spans, a null
    doc_id stays null, repeated rows give repeated results, an empty docs gives no row. A text of any length is read whole; equal scores
    share a bin and are reported together or not at all; of spans that start together, the kinds come in the order of KINDS."""
    pairs = pair_weights(docs)
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(lambda it: _scan(it, pairs), _FOUND)
    found = written(found)
    token = found.select(F.explode("tokens").alias("t")).select("t.family", "t.class", "t.bin", F.lit(False).alias("null"), F.lit(1).cast("bigint").alias("n"))
    word = found.select(F.explode("words").alias("t")).select("t.family", "t.class", "t.bin", F.lit(True).alias("null"), "t.n")
    counts = token.union(word).groupBy("family", "class", "bin", "null").agg(F.sum("n")).collect()  # at most 4 x 10 x 65 x 2 rows
    limit = thresholds([tuple(r) for r in counts], alpha)

    def passes(t):  # the limit of its family and length class
        cut = F.lit(0)
        for (k, c), n in limit.items():
            cut = F.when((t["family"] == k) & (t["class"] == c), F.lit(n)).otherwise(cut)
        return t["bin"] < cut

    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("").alias("encoding")))
    more = F.transform(F.filter("tokens", passes), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"), t["encoding"].alias("encoding")))
    return found.select("doc_id", "key", F.array_sort(F.concat(base, more)).alias("spans"))


def _joined(spans) -> F.Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))

    def number(k: int) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    n = [number(k) for k in range(4)]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return out.select("doc_id", *n[:3], F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"), n[3])


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text with each of the spans (by start; they may overlap) replaced by one mark, cut in pieces once."""
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], "<secret>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """docs with every span replaced by <secret>, same columns and rows.

    Spans belong to an id and a text, so rows that repeat a doc_id with other texts have their own; a null doc_id is an id like any other;
    a null text stays null. Rows without spans pass unchanged; only the rows with spans are joined (broadcast if few)."""
    spans = scan(docs.select("doc_id", "text"), alpha)
    hit = spans.where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("secrets__id"), F.col("key").alias("secrets__key"), F.transform("spans", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"))).alias("secrets__spans"))
    out = docs.join(sized(written(hit)), F.col("doc_id").cast("bigint").eqNullSafe(F.col("secrets__id")) & (F.xxhash64("text") == F.col("secrets__key")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or x is None else without(t, [(int(y["s"]), int(y["e"])) for y in x]) for t, x in zip(text, spans, strict=True)], dtype=object)

    some = F.col("secrets__spans").isNotNull()
    kept = cut(F.when(some, F.col("text")), F.col("secrets__spans"))
    return out.withColumn("text", F.when(some, kept).otherwise(F.col("text"))).drop("secrets__id", "secrets__key", "secrets__spans")


SQL: dict[str, str] = {}
