"""Ranking of hits: fusion of passes, grouping by file, copies, and order within files.

Hits are rows (parent_id, chunk_seq, score); ties always fall to (parent_id, chunk_seq).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scoring

KEYS = ["parent_id", "chunk_seq"]


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), *KEYS).limit(k)


def ranked(hits: DataFrame, k: int | None = None) -> DataFrame:
    """With ``rank``: 1, 2, 2, 4. A pass is cut to its ``k`` best before it is ranked, so the ranking's one task is bounded."""
    some = top(hits, k) if k else hits
    return some.withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))))


def ranks(hits: DataFrame) -> DataFrame:
    """The same ranks for any number of hits: distinct scores are counted, numbered within bands of score, and the bands, a few
    thousand at most, are summed in order. So no task sees all hits."""
    scores = hits.groupBy("score").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.least(F.col("score"), F.lit(1_000.0)) * 4))
    bands = scores.groupBy("band").agg(F.sum("n").alias("n"))
    above = bands.select("band", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = scores.withColumn("_w", within).join(F.broadcast(above), "band").select("score", (F.col("above") + F.col("_w") + 1).alias("rank"))
    return hits.join(places, "score")


def fuse(passes: list[tuple[str, DataFrame, float]], depth: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of named, weighted passes: (parent_id, chunk_seq, rank_score, score, source).

    The score shown is the best of any pass. The source is the phrase pass if it found the hit, else the
    pass that ranked it best, the heavier one on a tie. With a ``depth`` each pass gives its so many best only.
    """
    rows = [(ranked(hits.select(*KEYS, "score"), depth) if depth else ranks(hits.select(*KEYS, "score"))).withColumns({"source": F.lit(name), "weight": F.lit(float(weight))}) for name, hits, weight in passes]
    every = reduce(DataFrame.unionByName, rows)
    order = F.struct((F.col("source") != "phrase").cast("int"), F.col("rank"), -F.col("weight"), F.col("source"))
    return every.groupBy(*KEYS).agg(F.sum(scoring.reciprocal(F.col("rank"), F.col("weight"))).alias("rank_score"), F.max("score").alias("score"), F.min_by("source", order).alias("source"))


def cascade(passes: list[DataFrame]) -> DataFrame:
    """Union of passes in order; a hit belongs to the first pass that found it: ``pass_index``."""
    rows = reduce(DataFrame.unionByName, [p.select(*KEYS, "score").withColumn("pass_index", F.lit(k)) for k, p in enumerate(passes)])
    return rows.groupBy(*KEYS).agg(F.min(F.struct("pass_index", "score")).alias("h")).select(*KEYS, "h.score", "h.pass_index")


def strong_signal(hits: DataFrame) -> DataFrame:
    """One row: the two best scores brought to 0..1, and whether the best stands out."""
    best = F.sort_array(F.collect_list(scoring.saturated(F.col("score"))), asc=False)
    two = hits.orderBy(F.desc("score"), *KEYS).limit(2).agg(best.alias("b"))
    first, second = F.coalesce(F.try_element_at("b", F.lit(1)), F.lit(0.0)), F.coalesce(F.try_element_at("b", F.lit(2)), F.lit(0.0))
    return two.select(first.alias("top"), second.alias("second"), ((first >= scoring.STRONG_SCORE) & (first - second >= scoring.STRONG_GAP)).alias("fired"))


def by_file(hits: DataFrame, per_file: int, score: str = "score") -> DataFrame:
    """The best ``per_file`` hits of each file, with the file's best score."""
    order = Window.partitionBy("parent_id").orderBy(F.desc(score), "chunk_seq")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_file).withColumn("file_score", F.max(score).over(Window.partitionBy("parent_id")))


def folded_copies(files: DataFrame, score: str = "score") -> DataFrame:
    """One row per content: the best file, and ``copies``, the other files with the same bytes. Files without a hash stand alone.
    ``files`` has (parent_id, content_hash, score)."""
    key = F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), F.col("parent_id"))
    best = F.min(F.struct((-F.col(score)).alias("s"), "parent_id")).alias("b")
    got = files.groupBy(key.alias("file_key")).agg(best, F.sort_array(F.collect_set("parent_id")).alias("all"))
    return got.select("file_key", F.col("b.parent_id").alias("parent_id"), (-F.col("b.s")).alias(score), F.array_except("all", F.array("b.parent_id")).alias("copies"))


def section_score(score: Column, slots: list[dict[str, Column]], total: Column) -> Column:
    """A section's score within its file. Each slot is (body, heading, share, rarity, held): what a heading lifts above the body counts
    twice its share, the lesser of both a quarter; the share of rarity that the section holds counts by its root."""
    gain, held = F.lit(0.0), F.lit(0.0)
    for s in slots:
        lifted = scoring.HEADING_BOOST * s["share"] * s["heading"]
        gain = gain + F.greatest(lifted - s["body"], F.lit(0.0)) + scoring.HEADING_TIE * F.least(lifted, s["body"])
        held = held + F.when(s["held"], s["rarity"]).otherwise(0.0)
    factor = F.pow(held / total, scoring.COVERAGE_POWER) if len(slots) > 1 else F.lit(1.0)
    return (score + gain) * factor


def shared_heading(chunks: DataFrame) -> DataFrame:
    """(parent_id, shared): the first heading, where all sections of a file stand under the same one."""
    lead = F.element_at(F.split("heading_path", " > "), 1)
    return chunks.groupBy("parent_id").agg(F.min(lead).alias("low"), F.max(lead).alias("high")).select("parent_id", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("").alias("shared"))


def covering_window(positions: list[Column]) -> Column:
    """Width of the smallest span with one position of every list; null if a list is empty. From each position, the first of every
    other list at or after it."""
    starts = F.flatten(F.array(*positions))

    def width(a: Column) -> Column:
        reach = [F.array_min(F.filter(p, lambda x: x >= a)) for p in positions]
        whole = F.greatest(*reach) if len(reach) > 1 else reach[0]
        return F.when(reduce(lambda x, y: x & y, [r.isNotNull() for r in reach]), whole - a + 1)

    return F.array_min(F.transform(starts, width))


def blend(lexical: DataFrame, semantic: DataFrame, with_vectors: DataFrame, key: str = "file_key") -> DataFrame:
    """Files of both rankings (key, place from 0): a sum of reciprocal places. A file without vectors takes its lexical place twice; one that
    only the model found has that place alone."""
    i, m = F.col("i"), F.col("m")
    both = lexical.select(key, F.col("place").alias("i")).join(semantic.select(key, F.col("place").alias("m")), key, "full_outer")
    rows = both.join(with_vectors.select(key, F.lit(True).alias("has")), key, "left")
    part = lambda x: F.when(x.isNotNull(), 1.0 / (scoring.RRF_K + 1 + x)).otherwise(0.0)
    second = F.when(F.col("has").isNull() & i.isNotNull(), i).otherwise(m)
    return rows.select(key, (part(i) + part(second)).alias("score"), "i", "m").orderBy(F.desc("score"), F.asc_nulls_last("i"), F.asc_nulls_last("m"), key)


def first_seen(hits: DataFrame, score: str = "score") -> DataFrame:
    """(parent_id, file_place): files in the order in which their best hits stand among all."""
    best = hits.groupBy("parent_id").agg(F.max(F.struct(score, (-F.col("chunk_seq")).alias("s"))).alias("b"))
    return ranks(best.select("parent_id", F.col("b")[score].alias("score"))).select("parent_id", F.col("rank").alias("file_place"))
