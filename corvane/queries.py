"""Registered queries of the search engine, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.suite import corpus, matching, more, rankings, stored, streams  # noqa: F401
from corvane.suite.common import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the documents, best first."""
    return QUERIES["bm25_top_k"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
