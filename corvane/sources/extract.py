"""Chunks of files of any known kind: one reader per kind, called on Arrow batches of (parent_id, path, content).

A reader takes bytes and yields (line, page, heading path, body). Archives are opened
with bounds on their size and ratio, and XML with entity definitions is refused. A file that
cannot be read gives no chunk; the others are not affected.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.functions.text import canonical_text, decode
from corvane.sources import chunking
from corvane.sources.kinds import CATEGORY_OF_KIND
from corvane.sources.markup import gfm_table, html_sections, markdown_sections

MOST_ARCHIVE, MOST_RATIO = 500 << 20, 200
SHEET_COLUMNS, SHEET_ROWS = 64, 2_000
Chunk = tuple[int, int, str, str]


class Unreadable(ValueError):
    """A file that must not or cannot be read."""


def opened(data: bytes) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unreadable(str(e)) from None
    if sum(i.file_size for i in archive.infolist()) > MOST_ARCHIVE:
        raise Unreadable("the archive's files are too large together")
    for i in archive.infolist():
        if i.compress_size and i.file_size / i.compress_size > MOST_RATIO:
            raise Unreadable(f"{i.filename} grows too much when opened")
    return archive


def parsed(data: bytes) -> ElementTree.Element:
    if re.search(rb"<!ENTITY", data[:100_000], re.I):
        raise Unreadable("entity definitions are not read")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise Unreadable(str(e)) from None


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element, *names: str) -> str:
    return "".join(x.text or "" for x in e.iter() if _name(x) in names)


def _value(e: ElementTree.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def _sections(found: list[tuple[int, str, str]]) -> Iterator[Chunk]:
    for line, path, body in found:
        yield line, 0, path, body


def _windows(text: str, lines: int, overlap: int) -> Iterator[Chunk]:
    rows = text.split("\n")
    at = 0
    while at < len(rows):
        body = "\n".join(rows[at : at + lines])
        if body.strip():
            yield at + 1, 0, "", body
        if at + lines >= len(rows):
            break
        at += lines - overlap


def read_txt(data: bytes) -> Iterator[Chunk]:
    text, at = decode(data), 0
    step = chunking.WINDOW - chunking.OVERLAP
    while at < len(text):
        body = text[at : at + chunking.WINDOW]
        if body.strip():
            yield text.count("\n", 0, at) + 1, 0, "", body
        if at + chunking.WINDOW >= len(text):
            break
        at += step


def read_md(data: bytes) -> Iterator[Chunk]:
    yield from _sections(markdown_sections(decode(data))[2])


def read_html(data: bytes) -> Iterator[Chunk]:
    text = decode(data)
    yield from _sections(html_sections(text)[2])
    for body in script_data(text):
        yield 0, 0, "", body


def script_data(html: str, most: int = 2_000_000) -> list[str]:
    """Texts of literals in a page's scripts: JSON values, and values assigned to names."""
    out = []
    for script in re.findall(r"<script\b[^>]*>(.*?)</script>", html[:most], re.S | re.I):
        for m in re.finditer(r"(?:^|=|\()\s*(?=[\[{])", script):
            try:
                value, _ = json.JSONDecoder().raw_decode(script, m.end())
            except ValueError:
                continue
            strings = list(_strings(value))
            if strings:
                out.append("\n".join(strings))
            break
    return out


def _strings(value: object, depth: int = 0) -> Iterator[str]:
    if depth > 32:
        return
    if isinstance(value, str):
        if re.search(r"\w\s+\w", value):
            yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v, depth + 1)


def read_code(data: bytes) -> Iterator[Chunk]:
    yield from _windows(decode(data), chunking.CODE_LINES, chunking.CODE_OVERLAP)


def read_data(data: bytes) -> Iterator[Chunk]:
    yield from _windows(decode(data), chunking.DATA_LINES, chunking.DATA_OVERLAP)


def read_csv(data: bytes, mark: str = ",") -> Iterator[Chunk]:
    rows = [r for r in csv.reader(io.StringIO(decode(data)), delimiter=mark) if any(c.strip() for c in r)]
    if not rows:
        return
    head, n = rows[0], chunking.CSV_ROWS
    for g in range(max(1, -(-(len(rows) - 1) // n))):
        yield g * n + 2, 0, "", "\n".join(mark.join(r) for r in [head, *rows[1 + g * n : 1 + (g + 1) * n]])


def read_notebook(data: bytes) -> Iterator[Chunk]:
    try:
        cells = json.loads(decode(data)).get("cells", [])
    except (ValueError, AttributeError) as e:
        raise Unreadable(str(e)) from None
    heading = ""
    for cell in cells:
        source = cell.get("source", "")
        source = "".join(source) if isinstance(source, list) else source
        if cell.get("cell_type") == "markdown" and (m := re.search(r"^#{1,6}\s+(.+)$", source, re.M)):
            heading = m[1].strip()
        shown = []
        for o in cell.get("outputs", []):
            text = o.get("text") or o.get("data", {}).get("text/plain", "")
            shown.append("".join(text) if isinstance(text, list) else text)
        body = "\n".join([source, *shown]).strip()
        if body:
            yield 0, 0, heading, body


def read_docx(data: bytes) -> Iterator[Chunk]:
    root = parsed(opened(data).read("word/document.xml"))
    body = next((e for e in root if _name(e) == "body"), root)
    yield from _office_blocks(body, lambda e: _name(e) == "p", _docx_level, lambda e: _text(e, "t"), "tbl", "tr", "tc", "t")


def _docx_level(e: ElementTree.Element) -> int:
    style = next((_value(x, "val") for x in e.iter() if _name(x) == "pStyle"), "")
    m = re.fullmatch(r"[Hh]eading\s*(\d)", style)
    return int(m[1]) if m else 1 if style.lower() == "title" else 0


def _office_blocks(body, is_paragraph: Callable, level: Callable, text: Callable, table: str, row: str, cell: str, leaf: str) -> Iterator[Chunk]:
    from corvane.sources.markup import Sectioner

    s = Sectioner()
    for k, e in enumerate(body):
        if _name(e) == table:
            s.block(gfm_table([[_text(c, leaf) for c in r if _name(c) == cell] for r in e.iter() if _name(r) == row]), k)
        elif is_paragraph(e):
            if body_text := text(e).strip():
                s.heading(n, body_text, k) if (n := level(e)) else s.block(body_text, k)
        else:
            for x in e.iter():
                if is_paragraph(x) and (body_text := text(x).strip()):
                    s.block(f"- {body_text}", k)
    s.flush()
    for _, path, chunk in s.sections:
        yield 0, 0, path, chunk


def read_pptx(data: bytes) -> Iterator[Chunk]:
    archive = opened(data)
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for number, name in slides:
        lines = [t for e in parsed(archive.read(name)).iter() if _name(e) == "p" and (t := _text(e, "t").strip())]
        notes = f"ppt/notesSlides/notesSlide{number}.xml"
        if notes in archive.namelist():
            lines += [t for e in parsed(archive.read(notes)).iter() if _name(e) == "p" and (t := _text(e, "t").strip())]
        if lines:
            yield 0, number, lines[0], "\n".join(lines)


def read_epub(data: bytes) -> Iterator[Chunk]:
    archive = opened(data)
    package = next((_value(e, "full-path") for e in parsed(archive.read("META-INF/container.xml")).iter() if _name(e) == "rootfile"), "")
    root = parsed(archive.read(package))
    place = {_value(e, "id"): _value(e, "href") for e in root.iter() if _name(e) == "item"}
    folder, seen = package.rpartition("/")[0], set()
    for e in root.iter():
        if _name(e) == "itemref" and (href := place.get(_value(e, "idref"))) and href not in seen:
            seen.add(href)
            name = f"{folder}/{href}".lstrip("/")
            if name in archive.namelist():
                yield from read_html(archive.read(name))


def read_odt(data: bytes) -> Iterator[Chunk]:
    root = parsed(opened(data).read("content.xml"))
    body = next((e for e in root.iter() if _name(e) in ("text", "presentation", "spreadsheet") and len(e)), root)
    level = lambda e: int(_value(e, "outline-level") or 1) if _name(e) == "h" else 0
    yield from _office_blocks(body, lambda e: _name(e) in ("p", "h"), level, lambda e: "".join(e.itertext()), "table", "table-row", "table-cell", "p")


def read_odp(data: bytes) -> Iterator[Chunk]:
    slides = [e for e in parsed(opened(data).read("content.xml")).iter() if _name(e) == "page"]
    for number, slide in enumerate(slides, 1):
        lines = [t for e in slide.iter() if _name(e) == "p" and (t := "".join(e.itertext()).strip())]
        if lines:
            yield 0, number, lines[0], "\n".join(lines)


def read_ods(data: bytes) -> Iterator[Chunk]:
    for sheet in (e for e in parsed(opened(data).read("content.xml")).iter() if _name(e) == "table"):
        rows = []
        for r in (e for e in sheet.iter() if _name(e) == "table-row"):
            cells = ["".join(c.itertext()).strip() for c in r if _name(c) == "table-cell"][:SHEET_COLUMNS]
            if any(cells):
                rows.append(cells)
            if len(rows) >= SHEET_ROWS:
                break
        if rows:
            yield 0, 0, _value(sheet, "name"), gfm_table(rows)


def read_pdf(data: bytes) -> Iterator[Chunk]:
    """No library for this format is at hand; a reader can be put in its place in ``READERS``."""
    raise Unreadable("PDF needs a reader")


READERS: dict[str, Callable[[bytes], Iterator[Chunk]]] = {
    "txt": read_txt, "md": read_md, "html": read_html, "pdf": read_pdf, "epub": read_epub, "docx": read_docx, "odt": read_odt, "pptx": read_pptx, "odp": read_odp, "ods": read_ods, "csv": read_csv, "tsv": lambda d: read_csv(d, "\t"), "ipynb": read_notebook,
}
CHUNKS = "parent_id string, chunk_seq int, line int, page int, heading_path string, body string"


def reader_of(kind: str) -> Callable[[bytes], Iterator[Chunk]] | None:
    if kind in READERS:
        return READERS[kind]
    return {"code": read_code, "data": read_data}.get(CATEGORY_OF_KIND.get(kind, ""))


def _bounded(chunks: Iterator[Chunk]) -> Iterator[Chunk]:
    """No body over the bound: tables get more room, longer ones are cut at white space."""
    for line, page, path, body in chunks:
        most = chunking.MOST_TABLE if body.lstrip().startswith("|") else chunking.MOST_BODY
        body = canonical_text(body)
        while len(body) > most:
            cut = body.rfind("\n", most // 2, most)
            cut = cut if cut > 0 else body.rfind(" ", most // 2, most)
            cut = cut if cut > 0 else most
            yield line, page, path, body[:cut]
            body = body[cut:].lstrip()
        if body.strip():
            yield line, page, path, body


def extracted(files: DataFrame) -> DataFrame:
    """Chunks of files (parent_id, kind, content). Unreadable files give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parent, kind, content = (batch.column(k)[i].as_py() for k in range(3))
                read = reader_of(kind or "")
                try:
                    found = [(parent, k, *c) for k, c in enumerate(_bounded(read(content or b"")))] if read else []
                except (Unreadable, KeyError, UnicodeError, csv.Error):
                    continue
                if found:
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["parent_id", "chunk_seq", "line", "page", "heading_path", "body"])

    return files.select("parent_id", "kind", "content").mapInArrow(run, CHUNKS)
