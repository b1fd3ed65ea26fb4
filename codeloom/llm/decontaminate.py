"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is
WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. From each
run of WINDOW words the smallest hash of its K-word runs is kept as a fingerprint. Equal windows
keep equal fingerprints, so the join of document and item fingerprints misses no shared window.
A hit is then extended to the windows that hold it, and these are joined on their words.

Cost: documents are read twice; each time their words stay inside one row. What is shuffled is one
row per document and one per hit. The items' fingerprints and windows are broadcast only if they are
few (their rows are counted); else the same joins shuffle. The explodes are outer ones (their null rows
go in the next step): an inner one adds a filter on its array, into which the optimizer copies the
whole chain of array expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sized, written

WINDOW = 13
K = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z only; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _pairs(a: str, shift: int, f) -> Column:
    """f of each value of array a and the value `shift` places on."""
    n = F.greatest(F.size(a) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, F.lit(1 + shift), n), f)


def _hash2(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _gram(df: DataFrame, n: int, out: str, base: str = "h") -> DataFrame:
    """Adds the hashes of all runs of n values of base (under out), by doubling and overlap."""
    cur, have = base, 1
    while have < n:
        step = min(have, n - have)
        name = out if have + step == n else f"{out}_{have + step}"
        df = df.withColumn(name, _pairs(cur, step, _hash2))
        cur, have = name, have + step
    return df if cur == out else df.withColumn(out, F.col(base))


def _least(df: DataFrame, col: str, n: int, out: str) -> DataFrame:
    """Adds the smallest of each n neighbours of array col (under out)."""
    cur, have = col, 1
    while have < n:
        step = min(have, n - have)
        name = out if have + step == n else f"{out}_{have + step}"
        df = df.withColumn(name, _pairs(cur, step, lambda x, y: F.least(x, y)))
        cur, have = name, have + step
    return df if cur == out else df.withColumn(out, F.col(col))


def _salted(a: str, n: int) -> Column:
    return F.transform(a, lambda x: F.xxhash64(x, F.lit(n)))


def _fingerprints(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """df (words, and keep) with fp: by window length, the fingerprint of the window at each place."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    df = _least(_gram(df, K, "g"), "g", WINDOW - K + 1, f"fp{WINDOW}")
    for n in lengths:
        df = _gram(df, n, f"s{n}").withColumn(f"fp{n}", _salted(f"s{n}", n))
    return df.select(*keep, *(f"fp{n}" for n in [WINDOW, *lengths]))


def find_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, hits): counts has doc_id and n_words, a row for each row of docs; hits has doc_id,
    start, end (words, end exclusive) and item_id for each window of an item in a document.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null or wordless texts have
    no windows. Rows that repeat a doc_id are one document with the hits of all its rows; a null
    doc_id is a document like any other. Items that repeat count by their item_id (null: as "").
    A text of any length is one row, read whole; of equal hashes in a run the value is kept once.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = written(items)
    lengths = sorted(r[0] for r in items.select(F.size("words").alias("n")).where(f"n < {WINDOW}").distinct().collect())  # at most WINDOW - 1
    n = F.when(F.size("words") < WINDOW, F.size("words")).otherwise(F.lit(WINDOW))
    own = _fingerprints(items, lengths, ["words"])
    parts = [own.where(F.size("words") >= WINDOW).select(F.explode_outer(f"fp{WINDOW}").alias("f"))]
    parts += [own.where(F.size("words") == k).select(F.explode_outer(f"fp{k}").alias("f")) for k in lengths]
    prints = written(reduce(DataFrame.union, parts).where("f IS NOT NULL").distinct())
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    windows = written(items.select("item_id", F.explode_outer(F.transform(starts, lambda s: F.concat_ws(" ", F.slice("words", s, n)))).alias("window")).distinct())

    texts = docs.select("doc_id", "text")
    doc = _fingerprints(texts.select("doc_id", item_words(F.col("text")).alias("words")), lengths, ["doc_id", "words"])
    # the first value of each row's list is its word count; the others are its fingerprints
    marked = F.concat(F.array(F.size("words").cast("long")), *(F.array_distinct(f"fp{k}") for k in [WINDOW, *lengths]))
    rows = doc.select("doc_id", F.posexplode_outer(marked).alias("at", "f"))
    hit = sized(prints.select("f", F.lit(True).alias("hit")))
    found = written(rows.join(hit, "f", "left").where("at = 0 or hit").select("doc_id", "at", "f"))
    counts = found.where("at = 0").select("doc_id", F.col("f").alias("n_words"))

    held = written(found.where("at > 0").select(F.col("doc_id").alias("held_id")).distinct())
    held = texts.join(sized(held), F.col("doc_id").eqNullSafe(F.col("held_id")), "left_semi").select("doc_id", item_words(F.col("text")).alias("words"))
    held = _fingerprints(held, lengths, ["doc_id", "words"])
    spans = reduce(DataFrame.union, [
        held.select("doc_id", "words", F.posexplode_outer(f"fp{k}").alias("at", "f"))
        .join(hit, "f")
        .select("doc_id", F.col("at").alias("start"), (F.col("at") + k).alias("end"), F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.lit(k))).alias("window"))
        for k in [WINDOW, *lengths]
    ])
    return counts, spans.join(sized(windows), "window").select("doc_id", "start", "end", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside a window of an item), item_ids (sorted as
    strings), contaminated (n_hit > 0 and share * n_hit >= n_words). An empty docs gives no row."""
    counts, hits = find_hits(docs, items)
    # the union of spans: sorted by start, each adds what lies beyond the end so far
    total = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    per = hits.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    per = per.select(F.col("doc_id").alias("hit_id"), total.alias("n_hit"), "item_ids")
    out = counts.join(per, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""
}
