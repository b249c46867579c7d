from __future__ import annotations

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import QueryError, QuerySyntaxError
from corvane.functions import dates, edits, patterns, recovery, scoring, tags, text
from corvane.functions.stem import stem
from corvane.plans import predicates


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("consistency", "consist"), ("knightly", "knight"), ("generously", "generous"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("cries", "cri"), ("ties", "tie"), ("skies", "sky"),
        ("national", "nation"), ("relational", "relat"), ("conditional", "condit"), ("happily", "happili"), ("agreed", "agre"), ("fizzed", "fizz"), ("controlling", "control"), ("news", "news"), ("a", "a"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_distances():
    assert edits.osa_within("recieve", "receive", 2) == 1
    assert edits.levenshtein_within("recieve", "receive", 2) == 2
    assert edits.osa_within("ca", "abc", 3) == 3
    assert edits.osa_within("abc", "xyz", 1) == 2
    assert edits.fuzzy_reaches("word", "ord", 1) and not edits.fuzzy_reaches("word", "wxyz", 2)
    assert edits.aligned("cat", "cart") == [True, True, False, True]
    assert [edits.automatic_reach(w) for w in ("ab", "abc", "abcd", "abc1", "abcdefgh")] == [0, 0, 1, 0, 1]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=6))
def test_one_edit_is_distance_one(word):
    assert all(edits.osa_within(word, w, 2) == 1 for w in edits.one_edit(word, "abc"))


def test_globs():
    assert patterns.glob_to_regex("a*b?") == "^a.*b.$"
    assert patterns.glob_mask("a*d", "abcd") == [True, False, False, True]
    import re

    for glob, yes, no in (("*.md", "a.md", "x/a.md"), ("**/*.md", "x/y/a.md", "a.txt"), ("a/**", "a/b/c", "b/a"), ("[!a].txt", "b.txt", "a.txt")):
        assert re.match(patterns.path_glob_to_regex(glob), yes) and not re.match(patterns.path_glob_to_regex(glob), no)
    assert patterns.literal_prefixes("abc.*|abd") == ["abc", "abd"] and patterns.literal_prefixes(".*a") == []
    with pytest.raises(QuerySyntaxError):
        patterns.word_regex("(?=a)b")


def test_ignore_rules():
    rules = patterns.IgnoreRules().add("", "*.log\n!keep.log\nbuild/\n/top.txt\n")
    assert rules.ignores("a/x.log") and not rules.ignores("keep.log") and rules.ignores("build/a.txt") and rules.ignores("top.txt") and not rules.ignores("a/top.txt")


def test_dates():
    assert dates.iso_seconds("1970-01-02") == 86_400 and dates.iso_seconds("1970") == 0 and dates.iso_seconds("1970-13") is None
    now = 10 * dates.DAY + 5
    assert dates.token_range("today", now) == (10 * dates.DAY, now)
    assert dates.token_range("yesterday", now) == (9 * dates.DAY, 10 * dates.DAY - 1)


def test_text_columns(spark):
    frame = spark.createDataFrame([("Ünï Straße's ﬁne\r\nＡ1​",)], "t string")
    row = frame.select(text.canonical(F.col("t")).alias("c"), text.words(F.col("t")).alias("w"), text.fold_accents(F.col("t")).alias("f")).first()
    assert row["c"] == "Ünï Straße's fine\nA1"
    assert row["w"][:3] == ["ünï", "straße", "s"]
    assert row["f"].startswith("Uni Strasse's")
    assert text.strip_stopwords("the cat and dog") == "cat dog" and text.strip_stopwords("the and") == "the and"
    assert text.decode(b"\xef\xbb\xbfabc") == "abc" and text.decode("é".encode("cp1252")) == "é" and text.decode("hi".encode("utf-16")) == "hi"
    assert text.fit("abcdef", 4) == "abc…"


def test_tags(spark):
    frame = spark.createDataFrame([(["#A/B/c", " x  y ", "[[T|label]]"],)], "t array<string>")
    assert frame.select(tags.expanded(F.col("t")).alias("t")).first()["t"] == ["a", "a/b", "a/b/c", "x y", "label"]
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, None)], "id int, t array<string>")
    assert [r["id"] for r in rows.filter(tags.TagFilter(("a", "b"), (), True).column(F.col("t"))).collect()] == [2]
    assert [r["id"] for r in rows.filter(tags.TagFilter((), ("b",)).column(F.col("t"))).collect()] == [1, 3]


def test_scores(spark):
    row = spark.range(1).select(scoring.saturated(F.lit(3.0)).alias("s"), scoring.closeness(F.lit(2), 2, 100).alias("c"), scoring.recency(F.lit(1.0), 100, F.lit(0), 1.0, 10.0).alias("r"), scoring.kind_boost(F.lit(2.0), F.lit("md"), {"md": 3.0}).alias("k")).first()
    assert (row["s"], row["c"], row["r"], row["k"]) == (0.75, 1.0, 1.0, 6.0)


def test_recovery(spark):
    frame = spark.createDataFrame([("one two three", "one two", "�" * 40)], "a string, b string, c string")
    row = frame.select(recovery.coverage(F.col("a"), F.col("b")).alias("x"), recovery.legible(F.col("c")).alias("y"), recovery.legible(F.col("a")).alias("z")).first()
    assert round(row["x"], 3) == 0.667 and not row["y"] and row["z"]


SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("year", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("due", T.DateType()), T.StructField("done", T.BooleanType())])
ROWS = [(1, 2020, "note", ["a", "b"], date(2024, 1, 1), True), (2, 2021, "memo", [], None, False), (3, None, None, None, None, None)]


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        ("year >= 2021", [2]), ("year != 2020", [2]), ("NOT year == 2020", [2, 3]), ('kind ~~ "n*"', [1]), ('"a" in tags', [1]), ('"a" not in tags', [2]), ("year in [2020, 2022]", [1]), ("year not in [2020]", [2]),
        ("due < 2024-06-01", [1]), ("done == true", [1]), ("done == 1", []), ('year == "2020"', []), ('kind == "note" OR (year == 2021 AND NOT done == true)', [1, 2]), ("missing == 1", []), ("NOT missing == 1", [1, 2, 3]), ('kind < "z"', []),
    ],
)
def test_predicates(spark, rule, expected):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(r["id"] for r in frame.filter(predicates.column(predicates.parse(rule), SCHEMA)).collect()) == expected


def test_predicates_are_written_out_again():
    for rule in ('year >= 2021 AND ("a" in tags OR NOT (kind ~~ "n*"))', "year not in [1, 2]", "due == 2024-01-01"):
        tree = predicates.parse(rule)
        assert predicates.parse(predicates.text(tree)) == tree
    assert predicates.fields(predicates.parse('a == 1 AND "x" in b')) == {"a", "b"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 \"'()[]=!<>~,ANDORTin-", max_size=25))
def test_any_filter_reads_or_is_a_query_error(rule):
    try:
        predicates.parse(rule)
    except QueryError:
        pass
