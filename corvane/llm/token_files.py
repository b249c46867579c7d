"""Operator 4: token ids in Parquet files that can be read selectively.

One row per document in ascending id order: the ids as a list column in dictionary
encoding (ids repeat and have few distinct values in a row group), ids and counts
of documents in delta encoding (they ascend), row groups and pages of a set size,
and page indexes, which the writer adds. A reader that wants some documents skips
pages by ``doc_id``; one that wants counts never touches the list column.

The start of a document in the whole stream is the start in its own file, written
beside it, plus the sum of the files before: one number a file, summed at reading.

Cases: a null text has only the end id; rows with equal ids keep an order by text
hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.bpe import byte_characters, default_tokenizer
from corvane.llm.pieces import PieceTable, encoded_rows, rows_beyond, rows_holding
from corvane.llm.shared import bounded_pieces, flat_bytes, table, table_path, tidy

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


class LibraryEncoder:
    """The tokenizers library's ids of whole texts, asked once for each distinct piece.

    Texts with characters on which Unicode versions may differ, or with an added token, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.names = dict(enumerate(byte_characters()))
        self.pieces = PieceTable(self._new)

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ask, names = self.tokenizer.model.tokenize, self.names
        found = [[t.id for t in ask(x.decode("latin-1").translate(names))] for x in pieces]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())), count

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts end to end, and where each text's begin."""
        apart = np.union1d(rows_beyond(data, offsets), rows_holding(data, offsets, self.added))
        return encoded_rows(self.pieces.encoded, data, offsets, apart, self._whole)


_encoders: dict[str, LibraryEncoder] = {}


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Encode and write in ascending id order; the texts are shuffled once, by range of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = LibraryEncoder(tokenizer)
        encode = _encoders[tokenizer]
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in bounded_pieces(batch, "text"):
                found, first = encode(*flat_bytes(some.column(1)))
                ends = first + np.arange(len(first))  # an end id after each text
                values = np.full(ends[-1], end_id, np.int32)
                values[np.arange(len(found)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = found.view(np.int32)
                n = np.diff(ends)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends[:-1], pa.int64()), pa.array(n), ids],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(tidy(run), SCHEMA).write.options(
        **{
            "compression": "none",  # bit-packed dictionary indexes hardly shrink further
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": str(ROW_GROUP_BYTES),
            "parquet.page.size": str(PAGE_BYTES),
            "parquet.page.row.count.limit": str(PAGE_ROWS),
            "parquet.column.statistics.enabled#ids.list.element": "false",
            "parquet.size.statistics.enabled": "false",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#start_in_part": "false",
            "parquet.enable.dictionary#n_tokens": "false",
        }
    ).parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids in all files before; one row a file, read from the small columns alone."""
    sums = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",), low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents with ``low <= doc_id < high``: id, start in the whole stream, count and ``columns``."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "start_in_part", "n_tokens", *columns)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") < high)
    # One row a file, so the broadcast is bounded by the number of files.
    return rows.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("start_in_part") + F.col("before")).alias("start"), "n_tokens", *columns)


def digests(rows: DataFrame) -> DataFrame:
    """The list column as a checksum: unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, ends = np.asarray(ids.values.cast(pa.int32())).astype("<i4", copy=False), np.asarray(ids.offsets)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            n = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), default_tokenizer(), path)
    return digests(read(spark, path))
