"""The queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, embeddings, exact, html, jaccard, langid, pack, quality, secrets, substring, toxicity, trie
from .common import ship


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL = [
    toxicity.op1_toxicity,
    embeddings.op2_embeddings,
    substring.op3_substring,
    secrets.op4_secrets,
    html.op5_html_text,
    pack.op6_pack,
    jaccard.op7_jaccard,
    decontaminate.op8_decontaminate,
    langid.op9_language,
    quality.op10_quality,
    trie.op11_trie,
    exact.op12_exact,
    alignment.op13_alignment,
]
QUERIES = {f.__name__: _ready(f) for f in _ALL}
SQL = {**embeddings.SQL, **substring.SQL, **jaccard.SQL, **decontaminate.SQL, **trie.SQL, **exact.SQL}
