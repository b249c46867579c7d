from __future__ import annotations

import io
import json
import zipfile

import pytest

from corvane import cli
from corvane.operators import outline
from corvane.sources import extract


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx() -> bytes:
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Top", "Heading1") + p("some text") + p("Sub", "Heading2") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def zipped(content: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in content.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_formats():
    got = list(extract.read_docx(docx()))
    assert [c[2] for c in got] == ["Top", "Top > Sub"] and "| a | b |" in got[1][3]
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:t>Title</a:t></a:p><a:p><a:t>point</a:t></a:p></p:sld>'
    assert list(extract.read_pptx(zipped({"ppt/slides/slide2.xml": slide, "ppt/slides/slide1.xml": slide})))[1] == (0, 2, "Title", "Title\npoint")
    book = zipped({"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="a"/></spine></p>', "o/a.xhtml": "<h1>One</h1><p>text</p>"})
    assert [c[2] for c in extract.read_epub(book)] == ["One"]
    odt = zipped({"content.xml": '<d xmlns:t="t"><t:text><t:h t:outline-level="1">H</t:h><t:p>words</t:p></t:text></d>'})
    assert [c[2] for c in extract.read_odt(odt)] == ["H"]
    ods = zipped({"content.xml": '<d xmlns:t="t"><t:table t:name="S"><t:table-row><t:table-cell><t:p>1</t:p></t:table-cell></t:table-row></t:table></d>'})
    assert list(extract.read_ods(ods))[0][2] == "S"


def test_guards():
    with pytest.raises(extract.Unreadable):
        extract.opened(zipped({"x": "0" * 5_000_000}))
    with pytest.raises(extract.Unreadable):
        extract.parsed(b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
    with pytest.raises(extract.Unreadable):
        extract.opened(b"no archive")


def test_other_readers():
    assert [c[0] for c in extract.read_csv(b'h,i\n"a\nb",2\n')] == [2]
    cells = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"text": ["2"]}]}]}
    assert [(c[2], c[3]) for c in extract.read_notebook(json.dumps(cells).encode())] == [("T", "# T\nx"), ("T", "1+1\n2")]
    assert extract.script_data('<script>window.x = {"a": "some words here", "n": [1, "more words"]};</script>') == ["some words here\nmore words"]
    assert len(list(extract.read_code(("x\n" * 400).encode()))) == 3
    assert all(len(c[3]) <= 8_000 for c in extract._bounded(iter([(1, 0, "", "word " * 5_000)])))


def test_unknown_and_broken_files_give_nothing(spark):
    rows = spark.createDataFrame([("a", "docx", b"broken"), ("b", "unknown", b"x"), ("c", "txt", None), ("d", "txt", b"fine"), ("e", "pdf", b"%PDF")], "parent_id string, kind string, content binary")
    assert [r["parent_id"] for r in extract.extracted(rows).collect()] == ["d"]


def test_outline(spark):
    rows = spark.createDataFrame([("f", 0, "A"), ("f", 1, "A > B"), ("f", 2, "A > B"), ("f", 3, "A > C"), ("g", 0, "")], "parent_id string, chunk_seq int, heading_path string")
    assert [(r["depth"], r["title"], r["chunk_seq"]) for r in outline.outline(rows).orderBy("chunk_seq").collect()] == [(1, "A", 0), (2, "B", 1), (2, "C", 3)]
    pages = spark.createDataFrame([("f", p) for p in range(1, 6)], "parent_id string, page int")
    contents = spark.createDataFrame([("f", 2, "Two"), ("f", 4, "Four")], "parent_id string, page int, title string")
    assert [r["heading_path"] for r in outline.headings_of_pages(pages, contents).orderBy("page").collect()] == ["", "Two", "Two", "Four", "Four"]
    assert [r["owns_heading"] for r in outline.owns_heading(rows.filter("parent_id = 'f'")).orderBy("chunk_seq").collect()] == [True, True, False, True]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Foxes\nThe quick brown fox jumps.\n")
    (tmp_path / "docs" / "b.txt").write_text("Nothing of note stands here.")
    index = f"file://{tmp_path}/index"
    assert cli.main(["index", index, f"notes=file://{tmp_path}/docs"], spark) == 0
    assert cli.main(["search", index, "brown foxes"], spark) == 0
    assert cli.main(["kinds", index], spark) == 0
    assert cli.main(["search", index, '"unclosed'], spark) == 2
    out = capsys.readouterr().out
    assert "a.md" in out and "md\t1" in out and "error:" in out
