"""Queries over a small corpus, against set algebra of their parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.engine import Engine, Profile, multi, run_multi
from corvane.errors import UnknownValueError
from corvane.functions.tags import TagFilter
from corvane.operators import facets, maintenance
from corvane.operators.widening import Synonyms, closest, compounds, number_groups
from corvane.sources import chunking, markup
from corvane.sources.kinds import split_type_globs

TEXTS = {
    "one": "the quick brown fox jumps over the lazy dog",
    "two": "a quick red fox runs and the dog sleeps",
    "three": "brown bears and red foxes running through the forest",
    "four": "database systems index documents and query words",
    "five": "drop-down menus list documents quickly",
    "six": "the dog lazy over jumps fox brown quick the",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = [(k, 0, "notes" if k < "o" or k == "one" else "books", f"/{k}.md", t, "md" if k != "six" else "txt", k.title(), "", 1_000 * i, ["a/b"] if i % 2 else ["c"], str(hash(t))) for i, (k, t) in enumerate(TEXTS.items())]
    chunks = spark.createDataFrame(rows, "parent_id string, chunk_seq int, collection string, path string, body string, kind string, title string, heading_path string, mtime long, tags array<string>, content_hash string").withColumn("source", F.lit("s"))
    return Engine.build(chunks, f"file://{tmp_path_factory.mktemp('index')}/i", synonyms=Synonyms.of([["quick", "fast", "red"], *number_groups()]))


def found(engine, query, **more):
    return {r["parent_id"] for r in engine.hits(query, secondary=False, **more).collect()}


PARTS = {"quick": {"one", "two", "five", "six"}, "fox": {"one", "two", "three", "six"}, "dog": {"one", "two", "six"}, "documents": {"four", "five"}, '"brown fox"': {"one"}, '"fox brown"~1': {"one", "six"}, "run*": {"two", "three"}, "d?g": {"one", "two", "six"}, "quikc~1": {"one", "two", "five", "six"}, "/qu.*y?/": {"one", "two", "four", "five", "six"}}


@pytest.mark.parametrize("query", sorted(PARTS))
def test_parts(engine, query):
    assert found(engine, query) == PARTS[query]


def test_pairs_follow_set_algebra(engine):
    some = random.Random(5).sample([(a, b) for a in PARTS for b in PARTS if a != b], 12)
    for a, b in some:
        assert found(engine, f"{a} AND {b}") == PARTS[a] & PARTS[b]
        assert found(engine, f"{a} OR {b}") == PARTS[a] | PARTS[b]
        assert found(engine, f"{a} -{b}") == PARTS[a] - PARTS[b]


def test_filters(engine):
    assert found(engine, "kind:txt") == {"six"}
    assert found(engine, "fox kind:md") == {"one", "two", "three"}
    assert found(engine, "fox -kind:md") == {"six"}
    assert found(engine, "mtime:>1970") == set(TEXTS) - {"one"}
    assert found(engine, "fox", arms=[("notes", None)]) == PARTS["fox"] & {"four", "five", "one"}
    assert found(engine, "fox", arms=[]) == set()
    assert found(engine, "fox", tags=TagFilter(("c",))) == {"one", "three"}
    assert found(engine, 'fox [title == "Two"]') == {"two"}
    with pytest.raises(UnknownValueError) as e:
        engine.hits("fox collection:note")
    assert e.value.near == ["notes"]


def test_nothing_asked_is_nothing(engine):
    assert found(engine, "") == set()


def test_search_ranks_the_phrase_first(engine):
    rows = engine.search("brown fox", limit=10).collect()
    assert rows[0]["parent_id"] == "one"
    recent = engine.search("fox", limit=10, profile=Profile(recency_boost=50.0, half_life=500.0), now=5_000).collect()
    assert recent[0]["parent_id"] == "six"


def built(spark, path, rows):
    """An engine over (parent_id, chunk_seq, body, heading_path) rows."""
    base = {"collection": "c", "kind": "md", "source": "s", "title": "", "mtime": 1}
    full = [(p, n, t, h, f"/{p}", str(hash("".join(x[2] for x in rows if x[0] == p)))) for p, n, t, h in rows]
    chunks = spark.createDataFrame(full, "parent_id string, chunk_seq int, body string, heading_path string, path string, content_hash string").withColumns({k: F.lit(v) for k, v in base.items()})
    return Engine.build(chunks, f"file://{path}/i")


def test_a_long_file_takes_one_place(spark, tmp_path):
    """A file with very many matching chunks leaves room for all the others."""
    rows = [("long", i, f"apple apple apple pie{i}", "") for i in range(1_500)] + [(f"f{i}", 0, f"one apple and word{i}", "") for i in range(20)]
    engine = built(spark, tmp_path, rows)
    got, trace = engine.searched("apple", limit=30, per_file=3)
    shown = got.collect()
    assert len({r["parent_id"] for r in shown}) == 21 and sum(r["parent_id"] == "long" for r in shown) == 3
    assert not trace.files_truncated and trace.sections_truncated
    few, trace = engine.searched("apple", limit=5)
    assert few.count() == 5 and trace.files_truncated
    assert [r["file_place"] for r in few.collect()] == [1, 2, 3, 4, 5] and few.first()["parent_id"] == "long"


def test_respelling_and_as_typed(spark, tmp_path):
    rows = [(f"f{i}", 0, "the garden grows", "") for i in range(60)] + [("rare", 0, "the gardem grows", "")]
    engine = built(spark, tmp_path, rows)
    got, trace = engine.searched("gardden", limit=10)
    assert trace.respelt == {"gardden": "garden"} and got.count() == 10
    got, trace = engine.searched("gardden", as_typed=True)
    assert trace.respelt == {} and not trace.strong_signal["fired"]
    # A rare spelling: its own file first, those of the common one under it.
    got, trace = engine.searched("gardem", limit=10)
    rows = got.collect()
    assert trace.widened == {"gardem": "garden"} and "(+respelt)" in trace.regime
    assert rows[0]["parent_id"] == "rare" and len(rows) == 10 and all(r["pass_index"] >= 1 for r in rows[1:])
    assert [r["parent_id"] for r in engine.searched("gardem", as_typed=True)[0].collect() if r["pass_index"] == 0] == ["rare"]


def test_a_strong_signal_ends_the_search(spark, tmp_path):
    rows = [("best", 0, "zebra " * 8 + "zebra", "")] + [(f"f{i}", 0, "words of other things in a long row of them " * 3, "") for i in range(2_000)]
    engine = built(spark, tmp_path, rows)
    _, trace = engine.searched("zebra")
    assert trace.regime.startswith("strong-signal") and trace.strong_signal["fired"]
    _, trace = engine.searched("zebra", intent="animals in a zoo")
    assert not trace.strong_signal["fired"] and trace.intent


def test_copies_fold_into_one_file(spark, tmp_path):
    engine = built(spark, tmp_path, [("a", 0, "pear tree", ""), ("b", 0, "pear tree", ""), ("c", 0, "a pear in the orchard", "")])
    got = {r["parent_id"]: r["copies"] for r in engine.search("pear", collapse_copies=True).collect()}
    assert got == {"a": ["b"], "c": []}
    assert engine.search("pear").count() == 3


def test_a_heading_orders_sections_within_a_file(spark, tmp_path):
    rows = [("f", 0, "much about engines here, engines and engines", "Intro"), ("f", 1, "about other parts, and an engine", "Engine"), ("g", 0, "nothing", "x")]
    got = built(spark, tmp_path, rows).searched("engine parts", per_file=2)[0].filter("parent_id = 'f'").collect()
    assert [r["chunk_seq"] for r in got] == [1, 0] and got[0]["section_score"] > got[1]["section_score"]


def test_repeated_stretches_show_once(spark, tmp_path):
    """Of two neighbours the lower goes if its only match stands in what both hold; not if it has another."""
    both = "and here is the stretch with the walrus that both of them hold"
    rows = [("f", 0, "walrus at the beginning " + both, ""), ("f", 1, both + " then something else", ""), ("g", 0, "a walrus " + both, ""), ("g", 1, both + " and one more walrus at the end", ""), ("h", 0, "none", "")]
    got = built(spark, tmp_path, rows).searched("walrus", per_file=5)[0].collect()
    assert sorted((r["parent_id"], r["chunk_seq"]) for r in got) == [("f", 0), ("g", 0), ("g", 1)]


def test_proximity_and_ranks(spark, tmp_path, engine):
    engine_ = built(spark, tmp_path, [("far", 0, "iron " + "x y z " * 30 + "gate iron iron gate gate", ""), ("near", 0, "an iron gate " + "x y z " * 40, "")])
    plain = engine_.search("iron gate").collect()
    boosted = engine_.search("iron gate", profile=Profile(proximity_boost=5.0)).collect()
    keys = lambda rows: {r["parent_id"]: r["rank_key"] for r in rows}
    assert all(keys(boosted)[k] > v for k, v in keys(plain).items())
    hits = spark.createDataFrame([("a", i, float(s)) for i, s in enumerate([3, 1, 3, 2, 2000, 1500, 0.1, 0.1])], "parent_id string, chunk_seq int, score double")
    from corvane.operators import ranking

    assert {tuple(r) for r in ranking.ranks(hits).select("chunk_seq", "rank").collect()} == {tuple(r) for r in ranking.ranked(hits).select("chunk_seq", "rank").collect()}


def test_patterns_never_backtrack_and_bad_ones_match_nothing(spark, tmp_path):
    engine = built(spark, tmp_path, [("a", 0, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaac word", ""), ("b", 0, "aab", "")])
    assert {r["parent_id"] for r in engine.hits("/(a+)+b/", secondary=False).collect()} == {"b"}
    assert engine.hits("/(a/", secondary=False).count() == 0 and engine.hits(r"/(a)\1/", secondary=False).count() == 0
    shown = engine.with_snippets(engine.hits("word", secondary=False), "/(a+)+b/ word").collect()
    assert [shown[0]["snippet"][m["start"] : m["end"]] for m in shown[0]["marks"]] == ["word"]
    with pytest.raises(UnknownValueError):
        engine.hits("word kind:spreadshet")
    assert engine.hits("word kind:python", secondary=False).count() == 0


def test_widening(engine):
    assert engine.respellings(["foxx", "documnts"]) == {"foxx": "fox", "documnts": "documents"}
    wide = {r["parent_id"] for r in engine.cascaded("fast", 100).collect()}
    assert {"one", "two", "three"} <= wide
    assert compounds("drop-down") == ["dropdown", "drop down"] and "drop down" in compounds("dropdown")
    assert closest("pytohn", ["python", "java"]) == ["python"]


def test_multi(engine):
    got = multi("lex: fox\n# no\nphrase: brown fox\nother: x\nintent: a\nintent: b")
    assert got == {"subqueries": [("lex", "fox"), ("phrase", "brown fox")], "intent": "b"}
    assert run_multi(engine, "lex: fox\nphrase: brown fox").count() == 4


def test_snippets_facets_and_explain(engine, spark):
    shown = engine.with_snippets(engine.hits("lazy", secondary=False), "lazy").collect()
    for r in shown:
        assert all(r["snippet"][m["start"] : m["end"]].lower() == "lazy" for m in r["marks"]) and r["marks"]
    assert {r["tag"]: r["files"] for r in engine.facets().collect()} == {"a/b": 3, "c": 3}
    assert "strong_signal" in engine.explain("fox")
    tree = facets.tag_tree(engine.facets())
    assert {(r["tag"], r["files"]) for r in tree.collect()} == {("a", 0), ("a/b", 3), ("c", 3)}


def test_generations(engine, spark):
    again = Engine.build(engine.index.chunks.filter("parent_id != 'one'"), engine.index.path)
    assert again.index.generation == engine.index.generation + 1
    assert "one" in found(engine, "fox") and "one" not in found(again, "fox")


def test_sections(spark):
    title, meta, got = markup.markdown_sections("---\ntitle: T\ntags: [a, b]\nn: 3\n---\n# A\ntext\n\n## B\n```\n# no heading\n```\nC\n===\nlast")
    assert title == "A" and meta == {"title": "T", "tags": ["a", "b"], "n": 3}
    assert [(line, path) for line, path, _ in got] == [(6, "A"), (9, "A > B"), (13, "C")]
    _, _, got = markup.html_sections("<title>t</title><h1>A</h1><p>x<script>no</script></p><h2>B</h2><table><tr><th>a<th>b<tr><td>1<td>2</table>")
    assert [p for _, p, _ in got] == ["A", "A > B"] and "| a | b |" in got[1][2]
    assert markup.unfenced(markup.fenced("a\n```\nb", "py")) == ("py", "a\n```\nb")


def test_chunks(spark):
    files = spark.createDataFrame([("a", "x" * 2_500), ("b", ""), ("c", None), ("d", "short\ntext")], "parent_id string, text string")
    rows = chunking.plain_windows(files).collect()
    assert sorted((r["parent_id"], r["chunk_seq"], len(r["body"])) for r in rows) == [("a", 0, 1000), ("a", 1, 1000), ("a", 2, 900), ("d", 0, 10)]
    long = spark.createDataFrame([("a", 0, "word " * 4_000)], "parent_id string, chunk_seq int, body string")
    cut = chunking.bounded(long).orderBy("chunk_seq").collect()
    assert all(len(r["body"]) <= 8_000 for r in cut) and sum(r["body"].count("word") for r in cut) == 4_000
    csv = spark.createDataFrame([("a", "h\n" + "\n".join(map(str, range(120)))), ("b", "h")], "parent_id string, text string")
    got = chunking.csv_groups(csv).orderBy("parent_id", "chunk_seq").collect()
    assert [(r["parent_id"], r["chunk_seq"], r["line"], r["body"].count("\n")) for r in got] == [("a", 0, 2, 50), ("a", 1, 52, 50), ("a", 2, 102, 20), ("b", 0, 2, 0)]
    quoted = "h,i\r\n" + "".join(f'{i},"a ""b""\nc, d"\n' for i in range(100_000)) + '9,"open\nto the end'
    got = chunking.csv_groups(spark.createDataFrame([("a", quoted, 7)], "parent_id string, text string, more int")).orderBy("chunk_seq").collect()
    assert len(got) == 2_001 and {r["more"] for r in got} == {7} and got[0]["body"].startswith('h,i\n0,"a ""b""\nc, d"\n1,') and got[-1]["body"] == 'h,i\n9,"open\nto the end'


def test_notebook_texts_are_strings_or_lists(spark):
    import json

    cells = [{"cell_type": "markdown", "source": ["# A \"q\"\n", "text \\n"]}, {"cell_type": "code", "source": "[1, 2]", "outputs": [{"text": ["a\n", "b"]}, {"data": {"text/plain": "c", "image/png": "x"}}, {"other": 1}]}, {"cell_type": "code", "source": []}]
    rows = chunking.notebook_cells(spark.createDataFrame([("a", json.dumps({"cells": cells}))], "parent_id string, text string")).orderBy("chunk_seq").collect()
    assert [(r["heading_path"], r["body"]) for r in rows] == [('A "q"', '# A "q"\ntext \\n'), ('A "q"', "[1, 2]\na\nb\nc"), ('A "q"', "")]
    assert split_type_globs(["*.md", "*.markdown", "*.mdx", "a/*.py"]) == (["md"], ["a/*.py"])


def test_upkeep(spark):
    live = spark.createDataFrame([("a", 1, 0), ("b", 2, 5), ("c", 9, 1)], "parent_id string, mtime long, ctime long")
    seen = spark.createDataFrame([("a", 1, 0), ("b", 2, 4)], "parent_id string, mtime long, ctime long")
    assert {r["parent_id"] for r in maintenance.to_read(live, seen).collect()} == {"b", "c"}
    assert maintenance.freshness(None, {}) == "NOT_INDEXED"
    assert maintenance.freshness({"version": 1, "sources": 1, "seen_at": 5}, {"version": 1, "sources": 1, "changed_at": 4}) == "CURRENT"
    assert maintenance.freshness({"version": 1}, {"version": 2}) == "NEEDS_REBUILD"


def test_walk(spark, tmp_path):
    from corvane.sources.listing import Source, claimed, walk

    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name in ("a/x.md", "a/y.py", "z.txt", ".hidden/q.md", "skip.bin"):
        (tmp_path / name).write_text("hello")
    root = f"file://{tmp_path}"
    files = walk(spark, [Source("c", root, exclude=("*.py",)), Source("c", f"{root}/a")])
    got = claimed(files.drop("content")).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["source_ord"]) for r in got} == {("x.md", 0), ("z.txt", 0), ("y.py", 1)}
