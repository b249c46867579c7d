"""Vectors of sections: keys, embedding of what is missing, nearest sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scoring import dot

DEPTH, SECTIONS_PER_FILE, KEY_WORDS = 2_000, 3, 256


def section_text(title: Column, heading: Column, body: Column) -> Column:
    """What is embedded: title, heading unless it is the title, and body."""
    return F.concat_ws(" ", F.when(title != "", title), F.when((heading != "") & (heading != title), heading), body)


def text_key(text: Column) -> Column:
    """Sections with the same first words share a vector."""
    return F.sha1(F.array_join(F.slice(F.split(F.lower(F.trim(text)), r"\s+"), 1, KEY_WORDS), " "))


def missing(sections: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per text that has no vector yet: (text_key, text)."""
    return sections.join(vectors.select("text_key"), "text_key", "left_anti").groupBy("text_key").agg(F.min("text").alias("text"))


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """Vectors of (text_key, text) by any function from texts to unit vectors, called in small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                some = b.slice(lo, batch)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(embed(some.column(1).to_pylist()), pa.list_(pa.float32()))], names=["text_key", "embedding"])

    return rows.select("text_key", "text").mapInArrow(run, "text_key string, embedding array<float>")


def hashing_embedder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in where no model is at hand: words fall into hashed coordinates, the vector has unit length."""
    import zlib

    from corvane.functions.text import words_of

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in words_of(t):
                h = zlib.crc32(w.encode())
                v[h % width] += 1.0 if h & 0x10000 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def nearest(vectors: DataFrame, query: list[float], k: int = DEPTH, key: str = "vec_id") -> DataFrame:
    """The k rows with the largest dot product, exactly; ties to smaller keys."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, dot(F.col("embedding"), asked).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def current(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Vector rows whose section is still what was embedded: keys and digests agree."""
    return rows.join(sections.select("parent_id", "chunk_seq", "digest"), ["parent_id", "chunk_seq", "digest"])


def best_sections(hits: DataFrame, per_file: int = SECTIONS_PER_FILE) -> DataFrame:
    order = Window.partitionBy("parent_id").orderBy(F.desc("similarity"), "chunk_seq")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_file)


def worth_compacting(rows: DataFrame, live: DataFrame) -> bool:
    """Whether over a quarter of the stored vectors belong to no section."""
    total, dead = rows.count(), rows.join(live.select("text_key").distinct(), "text_key", "left_anti").count()
    return dead * 4 > total
