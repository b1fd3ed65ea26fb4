"""The queries over the code graph and over texts."""

from . import chain, extracted, relational, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "chain", "extracted", "relational", "texts"]
