"""Findings of round 2, on small tables of their own."""

from __future__ import annotations

import duckdb

from corvane.engine import Engine
from corvane.functions.text import stems_of, words_of
from corvane.operators import index
from corvane.queries import ORACLES, QUERIES
from corvane.suite.common import documents_index


def documents(spark, folder, texts) -> str:
    rows = [(k, t, "en", "src1", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_cascade_search_has_the_passes_of_its_sql(spark, tmp_path):
    """A document with the word in two halves is a hit of the engine's cascade, which ends in compounds, not of the query's."""
    sf = documents(spark, tmp_path, ["a thingble here", "some thingbles", "haer thing ble andthouen", "nothing of it", None, "hingble and Thingble"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["cascade_search"](spark, sf).select("doc_id", "pass_index", "score").collect()))
    assert got == sorted(con.execute(ORACLES["cascade_search"]).fetchall())
    assert [r[:2] for r in got] == [(0, 0), (1, 1), (5, 0)]
    whole = {r["parent_id"]: r["pass_index"] for r in Engine(documents_index(spark, sf)).cascaded("thingble", 200).collect()}
    assert sorted(whole.values()) == [0, 0, 1, 2]


def test_stemmed_postings_need_no_shuffle(spark, monkeypatch):
    """Postings of words and stems come from where the chunks are, in runs that are sorted; runs, texts without words and spellings that share a stem change nothing."""
    texts = ["Bleeding things bleed; the thing", "", None, "ÆTHER æther cafés café", "thing " * 5, "things of a thing, bleeds"] * 50
    chunks = spark.createDataFrame([(f"f{k:03}", k % 2, t) for k, t in enumerate(texts)], "parent_id string, chunk_seq int, body string").repartition(3)
    monkeypatch.setattr(index, "RUN_WORDS", 100)
    monkeypatch.setattr(index, "OUT_ROWS", 7)
    got = index.postings_of(chunks, {"words": "body"}, True)
    assert str(got._jdf.queryExecution().executedPlan()).count("Exchange") == 1  # the test's own repartition
    want = set()
    for k, t in enumerate(texts):
        for field, found in (("words", words_of(t or "")), ("body", stems_of(t or ""))):
            for term in set(found):
                places = tuple(i for i, x in enumerate(found) if x == term)
                want.add((field, term, f"f{k:03}", k % 2, len(places), places, len(found)))
    rows = [(r["field"], r["term"], r["parent_id"], r["chunk_seq"], r["tf"], tuple(r["positions"]), r["dl"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
