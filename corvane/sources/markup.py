"""Sections of Markdown and HTML, by headings: block scanners on Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTIONS = "parent_id string, chunk_seq int, line int, title string, heading_path string, body string"
_HIDDEN = frozenset("script style head svg template noscript".split())
_BLOCK = frozenset("p div li ul ol table tr section article header footer nav aside main blockquote pre dl dt dd figure figcaption h1 h2 h3 h4 h5 h6".split())


class Sectioner:
    """Collects blocks under a stack of headings; a heading closes the section before it."""

    def __init__(self):
        self.stack: list[str] = []
        self.sections: list[tuple[int, str, str]] = []  # line, path, body
        self.body: list[str] = []
        self.line = 1
        self.title = ""

    def heading(self, level: int, text: str, line: int) -> None:
        self.flush()
        self.line = line
        while len(self.stack) < level - 1:
            self.stack.append("")
        self.stack[level - 1 :] = [text]
        if level == 1 and not self.title:
            self.title = text
        self.body = [text]

    def block(self, text: str, line: int) -> None:
        if not self.body:
            self.line = line
        self.body.append(text)

    def flush(self) -> None:
        if any(b.strip() for b in self.body):
            self.sections.append((self.line, " > ".join(h for h in self.stack if h), "\n\n".join(self.body)))
        self.body = []


def frontmatter(text: str) -> tuple[dict, int]:
    """Values of a leading block between ``---`` lines, and how many lines it takes: scalars, inline lists,
    and lists of dashes; dates stay strings."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return {}, 0
    end = next((i for i in range(1, min(len(lines), 500)) if lines[i].strip() in ("---", "...")), 0)
    if not end:
        return {}, 0
    out: dict = {}
    key = None
    for line in lines[1:end]:
        if (m := re.match(r"\s*-\s+(.*)$", line)) and key is not None:
            if not isinstance(out.get(key), list):
                out[key] = []
            out[key].append(scalar(m[1]))
        elif m := re.match(r"([^\s:#][^:]*):\s*(.*)$", line):
            key = m[1].strip()
            out[key] = scalar(m[2])
    return out, end + 1


def scalar(text: str):
    """A value of frontmatter: list, quoted, boolean, null, number or string."""
    x = text.strip()
    if x.startswith("[") and x.endswith("]"):
        return [scalar(p) for p in re.findall(r'"[^"]*"|\'[^\']*\'|[^,]+', x[1:-1]) if p.strip()]
    if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
        return x[1:-1]
    if x.lower() in ("true", "false"):
        return x.lower() == "true"
    if x.lower() in ("", "null", "~"):
        return None
    if re.fullmatch(r"[-+]?\d{1,18}", x):
        return int(x)
    if re.fullmatch(r"[-+]?\d+\.\d+(?:[eE][-+]?\d+)?", x):
        return float(x)
    return x


def markdown_sections(text: str) -> tuple[str, dict, list[tuple[int, str, str]]]:
    """(title, frontmatter, sections); fences keep their lines, and headings within them are text."""
    meta, skip = frontmatter(text)
    s, fence, block, at = Sectioner(), "", [], 0
    lines = text.split("\n")

    def flush() -> None:
        nonlocal block
        if block:
            s.block("\n".join(block), at)
        block = []

    for i, line in enumerate(lines[skip:], skip + 1):
        if fence:
            block.append(line)
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
                flush()
        elif m := re.match(r"\s{0,3}(`{3,}|~{3,})", line):
            flush()
            fence, at, block = m[1], i, [line]
        elif m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            s.heading(len(m[1]), m[2], i)
        elif re.match(r"\s{0,3}(=+|-+)\s*$", line) and len(block) == 1 and block[0].strip():
            text_of, block = block[0].strip(), []
            s.heading(1 if "=" in line else 2, text_of, i - 1)
        elif not line.strip():
            flush()
        else:
            if not block:
                at = i
            block.append(line)
    flush()
    s.flush()
    return s.title or str(meta.get("title") or ""), meta, s.sections


class _HtmlReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = Sectioner()
        self.hidden = 0
        self.level = 0
        self.text: list[str] = []
        self.in_title = False
        self.title = ""
        self.cells: list[str] | None = None
        self.rows: list[list[str]] = []
        self.pre = 0

    def _flush(self) -> None:
        raw = "".join(self.text)
        body = raw.strip("\n") if self.pre else re.sub(r"\s+", " ", raw).strip()
        if body:
            if self.level:
                self.out.heading(self.level, body, self.getpos()[0])
            elif self.cells is not None:
                self.cells.append(body)
            else:
                self.out.block(body, self.getpos()[0])
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCK or tag in ("td", "th"):
            self._flush()
        if re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])
        elif tag == "table":
            self.rows, self.cells = [], []
        elif tag == "tr" and self.cells is not None:
            self._end_row()
        elif tag == "pre":
            self.pre += 1
        elif tag == "li":
            self.text.append("- ")
        elif tag == "br":
            self.text.append("\n" if self.pre else " ")

    def _end_row(self) -> None:
        if self.cells:
            self.rows.append(self.cells)
        self.cells = []

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in _BLOCK or tag in ("td", "th"):
            self._flush()
        if re.fullmatch("h[1-6]", tag):
            self.level = 0
        elif tag == "tr" and self.cells is not None:
            self._end_row()
        elif tag == "table" and self.cells is not None:
            self._end_row()
            self.cells = None
            if table := gfm_table([r for r in self.rows if r]):
                self.out.block(table, self.getpos()[0])
        elif tag == "pre" and self.pre:
            self.pre -= 1

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.text.append(data)


def gfm_table(rows: list[list[str]]) -> str:
    """A table of pipes; short rows are filled, pipes in cells escaped."""
    if not rows:
        return ""
    width = max(map(len, rows))
    cells = [[c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def html_sections(text: str) -> tuple[str, dict, list[tuple[int, str, str]]]:
    reader = _HtmlReader()
    reader.feed(text)
    reader.close()
    reader._flush()
    reader.out.flush()
    return re.sub(r"\s+", " ", reader.title).strip() or reader.out.title, {}, reader.out.sections


def fenced(code: str, language: str = "") -> str:
    """Code between fences longer than any within it."""
    longest = max((len(m) for m in re.findall(r"^`{3,}", code, re.M)), default=2)
    mark = "`" * max(3, longest + 1)
    return f"{mark}{language}\n{code}\n{mark}"


def unfenced(block: str) -> tuple[str, str] | None:
    m = re.fullmatch(r"(`{3,}|~{3,})([^\n]*)\n(.*?)\n?\1", block.strip(), re.S)
    return (m[2].strip(), m[3]) if m else None


_READERS = {"md": markdown_sections, "html": html_sections}


def sections(files: DataFrame, kind: str) -> DataFrame:
    """(parent_id, chunk_seq, line, title, heading_path, body) of files (parent_id, text) of a kind."""
    read = _READERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out: list[tuple] = []
                some = batch.slice(lo, 500)
                for parent, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    title, _, found = read(text or "")
                    out += [(parent, k, line, title, path, body) for k, (line, path, body) in enumerate(found)]
                columns = list(zip(*out)) if out else [()] * 6
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["parent_id", "chunk_seq", "line", "title", "heading_path", "body"])

    return files.select("parent_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SECTIONS)


def frontmatter_json(files: DataFrame) -> DataFrame:
    """(parent_id, meta): frontmatter of Markdown files as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(frontmatter(t or "")[0], ensure_ascii=False, default=str) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["parent_id", "meta"])

    return files.select("parent_id", "text").mapInArrow(run, "parent_id string, meta string")
