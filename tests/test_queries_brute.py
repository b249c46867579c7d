"""Registered queries that no SQL is compared with, against plain versions over the same table."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from corvane.cli import main
from corvane.functions.text import stems_of, words_of
from corvane.queries import QUERIES
from corvane.suite.matching import A, B

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def bm25(words, docs):
    """Scores of any of some words, by document."""
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for w in words:
        df = sum(w in d for d in docs.values())
        for k, d in docs.items():
            if tf := d.count(w):
                out[k] = out.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return out


def test_stemmed_search(spark, texts):
    """Half of a word's score comes from its stem, half from its exact form."""
    stems = bm25([stems_of(w)[0] for w in ("things", "bleeding")], {k: stems_of(t) for k, t in texts.items()})
    words = bm25(["things", "bleeding"], {k: words_of(t) for k, t in texts.items()})
    got = {r["doc_id"]: r["score"] for r in QUERIES["stemmed_search"](spark, DATA).collect()}
    assert set(got) == set(stems) and all(abs(got[k] - (stems[k] + words.get(k, 0)) / 2) < 2e-6 for k in got)


def test_bounded_chunks(spark):
    from corvane.sources import chunking

    rows = {k: t for k, t in enumerate(["", "a b", "word " * 5_000, "x" * 20_001, "one two\n" * 1_200 + "y" * 9_000 + " end"])}
    frame = spark.createDataFrame([(str(k), 0, t) for k, t in rows.items()], "parent_id string, chunk_seq int, body string")
    got: dict = {}
    for r in chunking.bounded(frame).orderBy("parent_id", "chunk_seq").collect():
        got.setdefault(int(r["parent_id"]), []).append((r["chunk_seq"], r["body"]))
    for k, t in rows.items():
        pieces = [b for _, b in got[k]]
        assert [n for n, _ in got[k]] == list(range(len(pieces))) and all(len(b) <= 8_000 for b in pieces)
        assert re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", t)
        for a, b in zip(pieces, pieces[1:]):
            assert len(a) + len(b.split(None, 1)[0]) >= 8_000  # none ends before it must
    whole = QUERIES["bounded_chunks"](spark, DATA)
    assert whole.filter("n_chars > 8000").isEmpty()


def test_snippets_and_highlights(spark, texts):
    docs = {k: words_of(t) for k, t in texts.items()}
    best = sorted(bm25([A, B], docs).items(), key=lambda p: -p[1])
    got = {r["doc_id"]: r["snippet"] for r in QUERIES["snippets"](spark, DATA).collect()}
    assert len(got) == min(50, len(best)) and all(dict(best)[k] >= best[len(got) - 1][1] - 1e-9 for k in got)
    stems = {stems_of(A)[0], stems_of(B)[0]}
    for k, s in got.items():
        assert len(s) <= 240 and s.strip() in texts[k]
        held = max(len(stems & set(stems_of(texts[k][m.start() : m.start() + 240]))) for m in re.finditer(r"[^\W_]+", texts[k]) if stems & set(stems_of(m[0])))
        assert 1 <= len(stems & set(stems_of(s))) <= held
    runs: dict = {}
    for r in QUERIES["highlights"](spark, DATA).orderBy("doc_id", "start").collect():
        runs.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["style"], r["slot"]))
    assert runs
    for k, some in runs.items():
        stems = [(m.start(), m.end(), stems_of(m[0])) for m in re.finditer(r"[^\W_]+", texts[k])]
        want = set()
        for (a, b, x), (c, d, y) in zip(stems, stems[1:]):
            if x == ["of"] and y == ["the"]:
                want |= set(range(a, d))
        assert {i for a, b, _, _ in some for i in range(a, b)} == want and all(a[1] <= b[0] for a, b in zip(some, some[1:]))


def test_sections(spark):
    """Turns as sections: each stands under its role; pages keep their headings and their text."""
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append(r["role"])
    got: dict = {}
    for r in QUERIES["markdown_sections"](spark, DATA).orderBy("conv_id", "chunk_seq").collect():
        got.setdefault(r["conv_id"], []).append(r["heading_path"])
    assert set(got) == set(turns) and all(set(turns[k]) <= set(v) for k, v in got.items())
    heads = {r["page_id"]: re.search(r"<h1>(.*?)</h1>", r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = {r["page_id"] for r in QUERIES["html_sections"](spark, DATA).filter("heading_path != ''").collect()}
    assert found == {k for k, m in heads.items() if m}
    norms = QUERIES["embedded_sections"](spark, DATA).collect()
    assert len({r["text_key"] for r in norms}) == len(norms) and {r["norm"] for r in norms} <= {0.0, 1.0}


def test_command_line(spark, tmp_path, capsys):
    """Folders with ignore files: built, searched, changed, brought up to date."""
    files = {"a.md": "# Pears\na pear tree", "b.md": "# Plums\na plum tree", "skip/c.md": "a pear", "d.log": "a pear", "keep.log": "pear here", ".gitignore": "skip/\n*.log\n!keep.log\n"}
    for name, text in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    index, folder = f"file://{tmp_path}/index", f"fruit=file://{tmp_path}/in"
    said = lambda *argv: (main(list(argv), spark), capsys.readouterr().out)
    assert said("index", index, folder)[0] == 0
    code, out = said("search", index, "pear")
    assert code == 0 and sorted(line.split("\t")[1].rsplit("/", 1)[1] for line in out.splitlines()) == ["a.md", "keep.log"]
    (tmp_path / "in" / "b.md").unlink()
    (tmp_path / "in" / "e.md").write_text("a pear again")
    assert [line.split("\t")[0] for line in said("update", index, folder)[1].splitlines()] == ["enumerated", "indexed", "pruned", "done"]
    assert len(said("search", index, "pear", "--limit", "9")[1].splitlines()) == 3 and said("search", index, "plum", "--as-typed")[1] == ""
    assert said("collections", index)[1] == "fruit\t3\n" and "regime" in said("search", index, "pear", "--explain")[1]
    assert said("search", index, "pear kind:nokind")[0] == 2
