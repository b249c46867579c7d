"""A training corpus in five stages, each working on what the one before kept.

quality classifier -> language identification -> n-gram Jaccard join -> benchmark
decontamination -> byte-level BPE. Every stage but the last returns the columns of
``documents``; the last returns each kept document's ids as digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontamination, jaccard, langid, quality
from corvane.llm.shared import table, written

#: A document goes when its quality score is under the threshold of the classifier.
LEAST_QUALITY = quality.THRESHOLD


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold go. Labels are learned from the rows of
    ``documents`` outside the held-out fold; a row without an id is scored, but never learned from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.select("doc_id", "text"), labels.filter(langid.fold(5) != 0))
    return quality.score(whole_rows(docs), model, ("row",)).filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def whole_rows(docs: DataFrame) -> DataFrame:
    """(text, row): rows pass through a classifier whole, so no join brings texts and decisions together again, and no
    column's name can clash with the classifier's."""
    return docs.select("text", F.struct(*docs.columns).alias("row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, as the classifier gives them no language; also if no
    row names a language, so that nothing can be learned. A row without an id is identified, but never learned from."""
    model = langid.train(docs.filter(langid.fold(4) != 2))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return langid.identify(whole_rows(docs), model, ("row",)).filter(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id stays; of rows with that id, the one whose columns hash lowest. A
    document without an id is linked with nothing and stays."""
    parts = jaccard.jaccard_components(docs.select("doc_id", "text"))
    # Ids that go are joined by id: each meets one row or few.
    gone = written(parts.filter("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Ids that repeat are one document. The hash covers every column, so rows that share it are equal, whichever stays.
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    again = written(docs.filter("doc_id is not null").select("doc_id", hashed.alias("h")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("h")).filter("n > 1").select("doc_id", "h"), "repeated-ids")
    if again.isEmpty():
        return kept
    first = kept.join(again.select("doc_id", F.col("h").alias("_lowest")), "doc_id").filter(hashed == F.col("_lowest")).dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. A document without an id cannot be named and stays."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(written(found.select("doc_id").distinct(), "contaminated"), "doc_id", "left_anti").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every kept document, as counts and digests, with their round trip."""
    return bpe.round_trip(docs, bpe.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("jaccard", join_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL expresses neither the trained models nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
