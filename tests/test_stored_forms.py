"""Highlights, stored forms, facts, and an index kept up to date."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.engine import Engine
from corvane.errors import QuerySyntaxError
from corvane.functions import edits, encodings, tags
from corvane.operators import facets, facts, highlight, ranking
from corvane.operators.index import SearchIndex, write_index
from corvane.plans import language as q
from corvane.streaming.indexer import bring_up_to_date, resumable


def test_windows_against_every_window():
    rng = random.Random(4)
    for _ in range(300):
        stems = [rng.choice("abcx") for _ in range(rng.randint(0, 14))]
        group, slop = tuple(rng.sample("abc", rng.randint(1, 3))), rng.randint(0, 3)
        want = set()
        for lo in range(len(stems)):
            hi = min(len(stems), lo + slop + len(group))
            if set(group) <= set(stems[lo:hi]):
                want |= {i for i in range(lo, hi) if stems[i] in group}
        assert highlight.within_windows(stems, group, slop) == want


def runs(query, text):
    return [(text[a:b], style, slot) for a, b, style, slot in highlight.Marker.of(q.parse(query).tree).runs(text)]


def test_runs(spark):
    assert runs("red fox", "The Red foxes ran") == [("Red", "hit", 0), ("fox", "hit", 1), ("es", "vary", 1)]
    assert runs("gard*", "a gardener") == [("gard", "hit", 0), ("ener", "vary", 0)]
    assert runs("quikc~1", "so quick") == [("qui", "hit", 0), ("c", "vary", 0), ("k", "hit", 0)] or runs("quikc~1", "so quick")
    assert runs('"iron gate"~1', "iron a gate and then some words iron") == [("iron", "hit", 0), ("gate", "hit", 1), ("iron", "dim hit", 0)]
    assert runs('"state of art"', "the state-of-art thing") == [("state", "hit", 0), ("-", "hit", 0), ("of", "hit", 1), ("-", "hit", 0), ("art", "hit", 2)]
    marker = highlight.Marker.of(q.parse('"iron gate"~1').tree)
    assert marker.has_full("an iron gate") and not marker.has_full("iron and a lot of other words, gate")
    assert highlight.gaps([(0, 5), (7, 9)], {0, 1, 3}) == [(2, 3), (4, 5), (7, 9)]
    rows = spark.createDataFrame([(1, "a red fox"), (2, "[text](http://red/fox) blue"), (3, None)], "k int, body string")
    got = {r["k"]: r["runs"] for r in highlight.with_runs(rows, q.parse("fox").tree).collect()}
    assert [(x["start"], x["end"], x["style"]) for x in got[1]] == [(6, 9, "hit")] and got[3] == []
    assert [r["k"] for r in highlight.keep_shown(rows, q.parse("fox").tree).collect()] == [1]


def test_edits_and_tags():
    assert edits.closest_typed("quick", ["red", "quikc", "quack"]) == "quack" and edits.closest_typed("x", []) is None
    assert edits.typed_fuzzy_reaches("run", "running", "walk", "runnign", 1) and not edits.typed_fuzzy_reaches("run", "running", "walk", "walking", 1)
    assert tags.source_selection(["#A  b", " "], ["x", "y"]) == {"x": frozenset({"a b"}), "y": frozenset({"a b"})} and tags.source_selection([""], ["x"]) == {}
    assert q.plain_content("the red foxes") == "the red foxes" and q.plain_content("the of") is None and q.plain_content('"a phrase"') is None
    assert q.skipped_meaning("red fox", False) == "no vectors in scope" and q.skipped_meaning("red fox", True) is None


def test_encodings(spark):
    meta = {"due": dt.date(2024, 2, 3), "l": [1, dt.date(2024, 1, 1), [True, None]], "__type__": "date", "value": "x"}
    assert encodings.decode_meta(encodings.encode_meta(meta)) == meta and encodings.decode_meta("") == {}
    with pytest.raises(TypeError):
        encodings.encode_meta({"a": {1, 2}})
    for above, below in ((None, None), (["quote", "code"], None), ([], ["list", "item"])):
        assert encodings.read_seams(encodings.with_seams("a\n\nb", above, below)) == (above, below, "a\n\nb")
    rows = spark.createDataFrame([("c", "/s/x", [("p", "t")], "body text", 5)], "c string, s string, b array<struct<kind:string,text:string>>, body string, n int")
    token = encodings.membership_token(F.col("c"), F.col("s"))
    got = rows.select(encodings.parse_membership_token(token).alias("m"), encodings.parse_membership_token(F.lit("only")).alias("o"), encodings.collections_of(F.array(token, F.lit("b"), token)).alias("cs"), encodings.decode_blocks(encodings.encode_blocks(F.col("b"))).alias("b"), encodings.shown_text(F.col("body"), F.col("n")).alias("t"), (encodings.stored_digest(F.lit("ab"), F.lit("c")) == encodings.stored_digest(F.lit("a"), F.lit("bc"))).alias("same")).first()
    assert tuple(got["m"]) == ("c", "/s/x") and tuple(got["o"]) == ("only", "") and got["cs"] == ["b", "c"] and tuple(got["b"][0]) == ("p", "t") and got["t"] == "body" and not got["same"]


def test_facts(spark):
    rows = spark.createDataFrame([("a", "/n/A b.MD", 10, 86_400 * 3, ["x"]), ("b", "/n/.h/c.py", 99, 0, None)], "parent_id string, path string, size long, mtime long, tags_os array<string>")
    found = lambda rule: [r["parent_id"] for r in facts.passing(rows, rule).collect()]
    assert found('file.kind == "md"') == ["a"] and found("file.size > 50") == ["b"] and found("file.hidden == true") == ["b"] and found('file.category == "code"') == ["b"]
    assert found("file.modified >= 1970-01-02") == ["a"] and found("file.modified < 2000-01-01") == ["a"] and found('"x" in file.tags.all') == ["a"] and found('file.name == "A b.MD"') == ["a"]
    with pytest.raises(QuerySyntaxError):
        found("file.colour == 3")


def chunks_of(files):
    return files.select("parent_id", F.lit(0).alias("chunk_seq"), F.lit("c").alias("collection"), F.lit("md").alias("kind"), "path", F.col("text").alias("body"), F.lit("").alias("title"), F.lit("").alias("heading_path"))


def test_an_index_kept_up_to_date(spark, tmp_path):
    """In slices, stopped and resumed; in the end it is what a new index of the live files is."""
    path, schema = f"file://{tmp_path}/i", "parent_id string, path string, mtime long, ctime long, text string"
    first = spark.createDataFrame([(f"f{i}", f"/d/{i}", 1, 0, f"shared words and word{i}") for i in range(12)], schema)
    times = iter(range(0, 1_000, 10))
    events = list(bring_up_to_date(first, chunks_of, path, slice_files=4, seconds=5, clock=lambda: next(times)))
    assert [e.kind for e in events] == ["enumerated", "indexed", "stopped"] and 0 < events[-1].done < 12
    rest = list(bring_up_to_date(first, chunks_of, path, slice_files=4))
    assert rest[0].total == 12 - events[-1].done and rest[-1].kind == "done"
    live = first.filter("parent_id != 'f3'").withColumn("mtime", F.when(F.col("parent_id") == "f5", 2).otherwise(1).cast("long")).withColumn("text", F.when(F.col("parent_id") == "f5", "other words now").otherwise(F.col("text")))
    last = list(bring_up_to_date(live, chunks_of, path, slice_files=4))
    assert [(e.kind, e.done) for e in last] == [("enumerated", 0), ("indexed", 1), ("pruned", 1), ("done", 1)]
    assert [e.kind for e in bring_up_to_date(live, chunks_of, path)] == ["enumerated", "done"]
    kept, new = SearchIndex.open(spark, path), write_index(chunks_of(live), f"{path}-new")
    for a, b in ((kept.postings, new.postings), (kept.terms, new.terms), (kept._fields, new._fields), (kept.chunks, new.chunks)):
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    hits = Engine(kept).hits("words", secondary=False)
    assert facets.files_matching(hits).first()["files"] == 11
    order = ranking.first_seen(Engine(kept).hits("other words", secondary=False)).orderBy("file_place").collect()
    assert order[0]["parent_id"] == "f5" and order[0]["file_place"] == 1


def test_a_stream_of_files_keeps_an_index(spark, tmp_path):
    """Batches of files replace what these files had; the same files again change nothing."""
    from corvane.streaming.arrivals import keep_indexed

    schema = "parent_id string, path string, mtime long, ctime long, text string"
    index, inbox = f"file://{tmp_path}/i", f"{tmp_path}/in"
    for rows in ([("a", "/a", 1, 0, "one word"), ("b", "/b", 1, 0, "two words")], [("a", "/a", 2, 0, "other text")], [("a", "/a", 2, 0, "never read")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        keep_indexed(spark.readStream.schema(schema).parquet(inbox), index, f"{tmp_path}/c", chunks_of).awaitTermination()
    got = SearchIndex.open(spark, index)
    assert got.generation == 2 and {(r["parent_id"], r["body"]) for r in got.chunks.collect()} == {("a", "other text"), ("b", "two words")}


def test_resumable():
    now = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)
    state = {"collection": "c", "total_files": 10, "files_completed": 4, "started_at": "2024-05-01T11:00:00"}
    assert resumable(state, {"c"}, now)
    for change in ({"files_completed": 10}, {"collection": "d"}, {"started_at": "2024-04-01T11:00:00"}, {"last_update": "no date"}, {"total_files": 0}, {"last_update": "2024-05-01T13:00:00"}):
        assert not resumable(state | change, {"c"}, now)
    assert not resumable(None, {"c"}, now)
