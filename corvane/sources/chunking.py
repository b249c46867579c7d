"""Texts cut into chunks: Column expressions over one row per file, or one walk over each text on Arrow batches where
expressions would copy or read a text once a piece.

Every function takes (parent_id, text, ...) and returns one row per chunk with
``chunk_seq`` from 0, ``line`` (1-based, where lines count) and ``body``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

WINDOW, OVERLAP = 1_000, 200
CODE_LINES, CODE_OVERLAP = 160, 12
DATA_LINES, DATA_OVERLAP = 200, 10
CSV_ROWS = 50
MOST_BODY, MOST_TABLE = 8_000, 32_000
BATCH_ROWS = 1_000
BLANKS = " \t\n\x0b\f\r"


def _starts(size: Column, window: int, step: int) -> Column:
    """0, step, 2 step ... until a window reaches the end; none for nothing."""
    last = F.greatest(F.ceil((size - window) / F.lit(step)), F.lit(0)).cast("int")
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def _cut(files: DataFrame, pieces: Callable[[str], Iterator[tuple[int, int, str]]]) -> DataFrame:
    """A row per piece of each text: the file's other columns, ``chunk_seq``, ``line`` and ``body``. Texts are cut in one walk, and
    rows leave in bounded batches, so a long text is never copied once a piece."""
    kept = [f for f in files.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.select([f.name for f in kept])

            def rows(owner: list[int], found: list[tuple[int, int, str]]) -> pa.RecordBatch:
                seq, line, body = zip(*found)
                return pa.RecordBatch.from_arrays([*others.take(pa.array(owner)).columns, pa.array(seq, pa.int32()), pa.array(line, pa.int32()), pa.array(body, pa.string())], names=[*others.schema.names, "chunk_seq", "line", "body"])

            owner: list[int] = []
            found: list[tuple[int, int, str]] = []
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                for piece in pieces(text.as_py() or ""):
                    owner.append(i)
                    found.append(piece)
                    if len(found) >= BATCH_ROWS:
                        yield rows(owner, found)
                        owner, found = [], []
            if found:
                yield rows(owner, found)

    schema = StructType([*kept, StructField("chunk_seq", IntegerType()), StructField("line", IntegerType()), StructField("body", StringType())])
    return files.select(*(f.name for f in kept), "text").mapInArrow(run, schema)


def plain_windows(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of characters that overlap; blank ones are left out and not numbered."""

    def pieces(text: str) -> Iterator[tuple[int, int, str]]:
        seq, line, counted = 0, 1, 0
        for at in range(0, max(len(text) - overlap, 1), window - overlap) if text else ():
            line += text.count("\n", counted, at)
            counted = at
            if (body := text[at : at + window]).strip(BLANKS):
                yield seq, line, body
                seq += 1

    return _cut(files, pieces)


def line_windows(files: DataFrame, lines: int = CODE_LINES, overlap: int = CODE_OVERLAP, most: int = MOST_BODY) -> DataFrame:
    """Windows of lines that overlap; blank ones are left out."""
    rows = files.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n")).drop("text")
    rows = rows.withColumn("_at", F.explode(_starts(F.size("_lines"), lines, lines - overlap)))
    rows = rows.withColumn("body", F.array_join(F.slice("_lines", F.col("_at") + 1, F.lit(lines)), "\n")).withColumn("line", F.col("_at") + 1)
    rows = _numbered(rows.filter(F.trim(F.regexp_replace("body", r"\s", " ")) != ""), "_at").drop("_lines", "_at")
    return bounded(rows, most) if most else rows


def csv_groups(files: DataFrame, rows_per_chunk: int = CSV_ROWS) -> DataFrame:
    """Header and so many rows a chunk; the header alone is a chunk too. Lines that stand within quotes are not split: a row goes on while
    the number of its quotes is odd."""

    def records(text: str) -> Iterator[str]:
        held: list[str] = []
        quotes = 0
        for line in text.split("\n"):
            held.append(line)
            quotes += line.count('"')
            if quotes % 2 == 0:
                row = "\n".join(held).removesuffix("\r")
                held, quotes = [], 0
                if row.strip(" "):
                    yield row
        if held and (row := "\n".join(held)).strip(" "):
            yield row  # a quote that is never closed

    def pieces(text: str) -> Iterator[tuple[int, int, str]]:
        rows = records(text)
        header = next(rows, None)
        if header is None:
            return
        for seq in count():
            some = list(islice(rows, rows_per_chunk))
            if some or not seq:
                yield seq, seq * rows_per_chunk + 2, "\n".join([header, *some])
            if len(some) < rows_per_chunk:
                return

    return _cut(files, pieces)


NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:variant,outputs:array<struct<text:variant,data:struct<`text/plain`:variant>>>>>>"


def _lines(v: Column) -> Column:
    """A text of a notebook: one string, or a list of lines."""
    return F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.try_variant_get(v, "$", "string"))


def notebook_cells(files: DataFrame) -> DataFrame:
    """A chunk per cell, with the texts of its outputs; ``heading_path`` is the last heading at or before it."""
    cells = files.withColumn("_n", F.from_json("text", NOTEBOOK)).select("*", F.posexplode("_n.cells").alias("chunk_seq", "c")).drop("text", "_n")
    cells = cells.withColumn("_source", F.coalesce(_lines(F.col("c.source")), F.lit("")))
    title = F.regexp_extract("_source", r"(?m)^#{1,6}\s+(.+)$", 1)
    heading = F.when((F.col("c.cell_type") == "markdown") & (title != ""), title)
    order = Window.partitionBy("parent_id").orderBy("chunk_seq").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("heading_path", F.coalesce(F.last(heading, ignorenulls=True).over(order), F.lit("")))
    shown = F.filter(F.transform("c.outputs", lambda o: F.coalesce(_lines(o["text"]), _lines(o["data"]["text/plain"]))), lambda t: t.isNotNull())
    return cells.withColumn("body", F.concat_ws("\n", "_source", F.when(F.size(shown) > 0, F.array_join(shown, "\n")))).withColumn("line", F.lit(0)).drop("c", "_source")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("chunk_seq", (F.row_number().over(Window.partitionBy("parent_id").orderBy(*order)) - 1).cast("int"))


def bounded(chunks: DataFrame, most: int = MOST_BODY) -> DataFrame:
    """No body over ``most`` characters: longer ones are cut at the last white space within it, and numbers follow.

    ``text`` is taken in steps by a pattern: at most ``most`` characters up to white space, or so many in one go.
    """
    pieces = F.regexp_extract_all("body", F.lit(rf"(?s)(.{{1,{most}}}(?=\s|$)|.{{1,{most}}})"), 1)
    cut = F.when(F.length("body") > most, F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+", "")), lambda p: p != "")).otherwise(F.array("body"))
    rows = chunks.select("*", F.posexplode(cut).alias("_k", "_piece")).drop("body").withColumnRenamed("_piece", "body")
    rows = rows.withColumnRenamed("chunk_seq", "_seq")
    return _numbered(rows, "_seq", "_k").drop("_seq", "_k")


def repeats(chunks: DataFrame, most: int | None = 2_000, least: int = 20) -> DataFrame:
    """``repeated``: how many characters at a chunk's beginning stand at its predecessor's end already; ``most`` None looks at all."""
    before = F.lag("body").over(Window.partitionBy("parent_id").orderBy("chunk_seq"))
    rows = chunks.withColumn("_before", before)
    lengths = F.sequence(F.least(F.length("body"), F.length("_before"), *([] if most is None else [F.lit(most)])), F.lit(least), F.lit(-1))
    longest = F.try_element_at(F.filter(F.when(F.least(F.length("body"), F.length("_before")) >= least, lengths), lambda n: F.endswith(F.col("_before"), F.substring("body", F.lit(1), n))), F.lit(1))
    return rows.withColumn("repeated", F.coalesce(longest, F.lit(0))).drop("_before")


def table_chunks(rows: DataFrame, table: str, key: str, body: str, **columns: Column) -> DataFrame:
    """Rows of a table as files of one chunk each: the identity is a hash of table and key."""
    base = {"kind": F.lit("txt"), "title": F.lit(""), "heading_path": F.lit(""), "author": F.lit(""), "mtime": F.lit(0).cast("long"), "source": F.lit(table)} | columns
    return rows.select(
        F.sha1(F.concat(F.lit(f"{table}/"), F.col(key).cast("string"))).alias("parent_id"),
        F.lit(0).alias("chunk_seq"),
        F.lit(table).alias("collection"),
        F.concat(F.lit(f"{table}/"), F.col(key).cast("string")).alias("path"),
        F.coalesce(F.col(body), F.lit("")).alias("body"),
        F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("content_hash"),
        *(c.alias(n) for n, c in base.items()),
    )
