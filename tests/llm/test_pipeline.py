"""The pipeline's stages, each against a plain version of its decisions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.llm import decontamination, jaccard, langid, quality
from corvane.llm.shared import table, written

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DATA), f"test-{name}")
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "quality":
            model = quality.train(docs.select("doc_id", "text"), table(spark, DATA, "labels").filter(langid.fold(5) != 0))
            want = {r["doc_id"] for r in quality.score(docs.select("text", "doc_id"), model).filter("score >= 0.3").collect()}
            assert len(want) < len(ids)
        elif name == "language":
            want = {r["doc_id"] for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}
        elif name == "jaccard":
            want = {r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
            assert len(want) < len(ids)
        elif name == "decontamination":
            want = ids - {r["doc_id"] for r in decontamination.contaminated(docs, table(spark, DATA, "benchmark")).collect()}
            assert len(want) < len(ids)
        else:
            want = ids
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert kept == want, name
        if name != "bpe":
            assert out.columns == docs.columns
        docs, ids = out, kept


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_language_stage_without_labels(spark):
    rows = [(i, t, None) for i, t in enumerate(["Words of some language.", "日本", "12 345 ...", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.language_stage(spark, docs, DATA)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {0, 1}


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0, 1, "a"), (1, "The same id, another text of some words.", "en", "s", 1, 2, "b"), (2, "", "en", "s", 0, 3, "c"), (None, "A text without an id, but with words in it.", "en", None, 1, 4, "d"), (3, "The same id, another text of some words.", "en", "s", 1, 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, row string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = written(out, "test-odd")
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.count() == 0 and empty.columns == docs.columns
