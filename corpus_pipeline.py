"""A corpus pipeline of five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as Parquet and read again as the next one's docs. All stages but the last return
the columns of documents.

For every stage: only doc_id, text (and n_chars) are looked at, so further columns, whatever their names, pass
unchanged. Rows that repeat a doc_id stay or go together, each with its own text; rows with a null doc_id always stay. A null
text is like an empty one, and stays null. Texts of any length are taken whole. No documents give no rows; empty tables of labels or
benchmark items reject nothing that they would have to tell (see each stage).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, jaccard, pack, quality, secrets
from codeloom.llm.common import read, ship, sized, written


#: Words that a worker of the packing stage remembers: fewer than alone, as executors hold what the stages before left.
REMEMBER = 300_000


def _keep(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids in gone (doc_id, not null); the ids are broadcast if they are few."""
    return docs.join(sized(written(gone)), "doc_id", "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.5; exactly 0.5 stays) go. A null text is judged as an empty
    one; an id goes if any of its rows is rejected. Without labels every score is 0.5, and all stay."""
    ship(spark)
    bad = quality.score(docs, read(spark, sf_dir, "labels")).where("predicted = 0 AND doc_id IS NOT NULL")
    return _keep(docs, bad.select("doc_id").distinct())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, stays of each group linked by n-gram Jaccard similarity (exactly 0.75
    links); all rows of that id stay. Documents without words, and those with a null id, stay."""
    ship(spark)
    groups = jaccard.join(docs)
    return _keep(docs, groups.where("doc_id <> component_id").select("doc_id").distinct())


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark item go: at least 1 word in 20 (exactly 1 in 20 counts) lies in a window of an item;
    the words of all rows of an id are judged row by row, its hits together. Texts without words, and an empty benchmark, leave all."""
    ship(spark)
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return _keep(docs, found.where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct())


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark, and n_chars told anew; all rows stay, those without a secret unchanged. Spans that
    overlap become one mark. Rows that repeat an id lose the secrets of their own text."""
    ship(spark)
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A null or empty text is one
    piece of one id; rows that repeat a doc_id, or have none, are documents of their own; equal lengths take places in the order of their ids."""
    ship(spark)
    return pack.pack(docs, remember=REMEMBER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("secret_free", secret_free),
    ("packed", packed),
]

#: No SQL: the classifier is fitted, and the packing depends on the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each but the last written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
