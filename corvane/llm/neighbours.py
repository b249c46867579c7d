"""Operator 2: nearest neighbours with vantage-point trees.

Equal vectors are one point with their k + 1 smallest ids: no other of their rows can be
among the k nearest of anything, as ties go to smaller ids (one more, as a query's own row is
left out). They are brought together before anything else, each task sending k + 1 ids of a vector at most, so a vector that a third
of all rows share costs no more than any other.

A top tree over a bounded sample deals the points into regions, and a hash deals large
regions into shards of a bounded size. Each shard is a vantage-point tree, stored as one row with the
range of its points' distances from each vantage point of the top tree above it. A tree halves its points by their distance from a
vantage point, and knows the range of distances on either side. A query skips a side
if the triangle inequality puts all of it farther than ``1 / relax`` of its present
k-th best; so it does with whole regions. With ``relax`` 1 the search is exact.

A query first meets the shards of its own region; then, with the k-th best found there, those of
the regions that the top tree's ranges leave. So the pairs of query and shard grow with the
queries wherever distances tell regions apart. Queries come to a shard in blocks of a bounded size;
within a tree the queries of a block move together, as matrices.

Cases: vectors that are null, zero, or hold null, NaN or infinite components take no
part, neither as queries nor as candidates, nor do rows with a null id; vectors of different lengths are never
compared; fewer candidates than k are all returned. Of rows with a query's own id only the query's own
row is left out, and each of several rows with one id is a query of its own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import table, written

SHARD_ROWS, BLOCK_QUERIES, LEAF, RELAX = 16_000, 10_000, 384, 1.2
MATRIX_ROWS = 1_024
#: The sample of the top tree: rows, and bytes; and the most regions it has.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_REGIONS = 20_000, 32 << 20, 1_024


class VantageTree:
    """A tree over distinct points; the rows of ``ids`` are the smallest ids of each, in order, ``held`` of them."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, held: np.ndarray, k: int):
        self.points, self.ids, self.held, self.k = points, ids, held, k
        # Node: (vantage point, inside, outside, low in, high in, low out, high out) or an array of points.
        self.nodes: list = []
        self._build(np.arange(len(points)))

    def _build(self, some: np.ndarray) -> int:
        """Halves by count, so equal distances cannot unbalance it; its depth is the logarithm of its size."""
        number = len(self.nodes)
        self.nodes.append(None)
        if len(some) <= LEAF:
            self.nodes[number] = some
            return number
        x = self.points[some].astype(np.float64)
        far = np.argmax(((x - x[0]) ** 2).sum(1))  # a point at the rim separates best
        d = np.sqrt(((x - x[far]) ** 2).sum(1))
        half = len(some) // 2
        by = np.argpartition(d, half)
        near, rest = by[:half], by[half:]
        bounds = (d[near].min(), d[near].max(), d[rest].min(), d[rest].max())
        inside, outside = self._build(some[near]), self._build(some[rest])
        self.nodes[number] = (some[far], inside, outside, *bounds)
        return number

    def search(self, queries: np.ndarray, most: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of each query's k + 1 nearest rows, padded with infinity and -1. ``most``: a distance beyond which
        nothing is wanted."""
        state = _Search(self, queries, most, relax)
        if len(self.points):
            state.visit(0, np.arange(len(queries)), np.zeros(len(queries)))
        return state.distance, state.found


class _Search:
    def __init__(self, tree: VantageTree, queries: np.ndarray, most: np.ndarray, relax: float):
        self.tree, self.relax, self.width = tree, relax, tree.k + 1
        self.q = queries.astype(np.float64)
        self.norm = (self.q**2).sum(1)
        self.most = most
        self.distance = np.full((len(queries), self.width), np.inf)
        self.found = np.full((len(queries), self.width), -1, np.int64)

    def visit(self, number: int, some: np.ndarray, least: np.ndarray) -> None:
        """Search a node for queries whose points there are at ``least`` that far."""
        some = some[least * self.relax <= np.minimum(self.distance[some, -1], self.most[some]) * (1 + 1e-12)]
        if not len(some):
            return
        node = self.tree.nodes[number]
        if isinstance(node, np.ndarray):
            self._leaf(some, node)
            return
        vantage, inside, outside, low_in, high_in, low_out, high_out = node
        d = np.sqrt(((self.q[some] - self.tree.points[vantage].astype(np.float64)) ** 2).sum(1))
        to_in, to_out = beyond(d, low_in, high_in), beyond(d, low_out, high_out)
        first = to_in <= to_out
        self.visit(inside, some[first], to_in[first])
        self.visit(outside, some[~first], to_out[~first])
        self.visit(outside, some[first], to_out[first])
        self.visit(inside, some[~first], to_in[~first])

    def _leaf(self, some: np.ndarray, points: np.ndarray) -> None:
        p = self.tree.points[points].astype(np.float64)
        norm = (p**2).sum(1)
        rough = self.norm[some][:, None] + norm - 2 * (self.q[some] @ p.T)
        most = np.minimum(self.distance[some, -1], self.most[some]) ** 2
        a, b = np.nonzero(rough <= (most + 1e-9 * (1 + self.norm[some] + np.where(np.isfinite(most), most, 0)))[:, None] + 1e-9 * norm)
        if not len(a):
            return
        exact = np.sqrt(((self.q[some[a]] - p[b]) ** 2).sum(1))
        times = self.tree.held[points[b]]
        query = np.repeat(some[a], times)
        slot = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
        ids = self.tree.ids[np.repeat(points[b], times), slot]
        d = np.repeat(exact, times)
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, self.width)])
        ids = np.concatenate([ids, self.found[touched].ravel()])
        d = np.concatenate([d, self.distance[touched].ravel()])
        order = np.lexsort((ids, d, query))
        query, ids, d = query[order], ids[order], d[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.width
        self.distance[query[top], rank[top]] = d[top]
        self.found[query[top], rank[top]] = ids[top]


def beyond(d: np.ndarray, low, high) -> np.ndarray:
    """How far, at least, a query at distance ``d`` of a vantage point is from points at ``low`` to ``high`` of it."""
    return np.maximum(np.maximum(d - high, low - d) - 1e-9 * (1 + d), 0)


@dataclass
class TopTree:
    """Regions of vectors of one length: ``nodes`` are (vantage point, split, inside, outside) or a region's number; ``paths`` are
    the vantage points above each region."""

    vantages: np.ndarray
    nodes: list
    paths: list[list[int]]

    @classmethod
    def of(cls, sample: np.ndarray, regions: int) -> "TopTree":
        x = np.unique(sample.astype(np.float64), axis=0)
        tree = cls(np.zeros((0, x.shape[1])), [], [])
        chosen: list[np.ndarray] = []

        def grow(some: np.ndarray, wanted: int, path: list[int]) -> int:
            number = len(tree.nodes)
            tree.nodes.append(None)
            if wanted < 2 or len(some) < 4:
                tree.nodes[number] = len(tree.paths)
                tree.paths.append(path)
                return number
            far = some[np.argmax(((x[some] - x[some[0]]) ** 2).sum(1))]
            d = np.sqrt(((x[some] - x[far]) ** 2).sum(1))
            split = float(np.median(d))
            chosen.append(x[far])
            vantage, near = len(chosen) - 1, d < split
            inside = grow(some[near], wanted // 2, [*path, vantage])
            outside = grow(some[~near], wanted - wanted // 2, [*path, vantage])
            tree.nodes[number] = (vantage, split, inside, outside)
            return number

        grow(np.arange(len(x)), regions, [])
        if chosen:
            tree.vantages = np.stack(chosen)
        return tree

    def regions(self, vectors: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        out = np.zeros(len(vectors), np.int32)
        x = vectors.astype(np.float64)

        def descend(number: int, some: np.ndarray) -> None:
            node = self.nodes[number]
            if not isinstance(node, tuple):
                out[some] = node
            elif len(some):
                vantage, split, inside, outside = node
                near = np.sqrt(((x[some] - self.vantages[vantage]) ** 2).sum(1)) < split
                descend(inside, some[near])
                descend(outside, some[~near])

        descend(0, np.arange(len(x)))
        return out

    def ranges(self, region: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest distance of vectors from each vantage point above their region."""
        d = np.stack([np.sqrt(((vectors.astype(np.float64) - self.vantages[v]) ** 2).sum(1)) for v in self.paths[region]]) if self.paths[region] else np.zeros((0, len(vectors)))
        return d.min(1), d.max(1)


@dataclass
class VectorIndex:
    """``trees``: a written table (width, region, shard, low, high, tree); ``tops``: the top tree of each width in the sample."""

    trees: DataFrame
    tops: dict[int, TopTree]
    k: int


def usable(column: str):
    x = F.col(column)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, width) of the rows that take part; a negative zero is a zero."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable("embedding"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: F.when(v == 0, F.abs(v)).otherwise(v)).alias("embedding"), F.size("embedding").alias("width"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = np.asarray(batch.column(batch.schema.get_field_index("width")))
    for w in np.unique(widths).tolist():
        yield w, batch.filter(pa.array(widths == w))


def with_regions(rows: DataFrame, tops: dict[int, TopTree]) -> DataFrame:
    """``rows`` with the region of each vector; a width that no sampled row has is one region."""
    if not tops:
        return rows.withColumn("region", F.lit(0))
    held = rows.sparkSession.sparkContext.broadcast(tops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, some in _by_width(batch):
                x = _matrix(some.column(some.schema.get_field_index("embedding")))
                region = held.value[w].regions(x) if w in held.value else np.zeros(len(x), np.int32)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(region, pa.int32())], names=[*some.schema.names, "region"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, region int")


def build(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, most_regions: int = MOST_REGIONS) -> VectorIndex:
    """The index of all rows that take part."""
    spark = vectors.sparkSession
    # The k + 1 smallest ids of each vector: ranks are limited before the shuffle already.
    place = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))
    few = taking_part(vectors).withColumn("h", F.xxhash64("embedding")).withColumn("place", place).filter(F.col("place") <= k + 1)
    points = written(few.groupBy("h", "embedding", "width").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).drop("h"), "vector-points")
    n, widest = points.agg(F.count("*"), F.max("width")).first()
    sample = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (widest or 1)))
    regions = min(most_regions, max(1, math.ceil(n / shard_rows)))
    by_width: dict[int, list] = {}
    if regions > 1:
        for r in points.select("embedding", "width").orderBy(F.xxhash64("embedding"), "embedding").limit(max(16, sample)).collect():
            by_width.setdefault(r["width"], []).append(r["embedding"])
    tops = {w: TopTree.of(np.array(x), regions) for w, x in by_width.items()}
    dealt = written(with_regions(points, tops), "vector-regions") if tops else with_regions(points, tops)
    # A number for each region, of which there are ``MOST_REGIONS`` a width at most.
    shards = dealt.groupBy("width", "region").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(shard_rows))).cast("int").alias("shards"))
    dealt = dealt.join(shards, ["width", "region"]).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int")).drop("shards")
    held = spark.sparkContext.broadcast(tops)
    schema = pa.schema([("width", pa.int32()), ("region", pa.int32()), ("shard", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("tree", pa.binary())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        w, region, shard = (x.as_py() for x in key)
        x = _matrix(rows.column("embedding"))
        lists = rows.column("ids").combine_chunks()
        times = np.diff(np.asarray(lists.offsets))
        ids = np.full((len(x), k + 1), -1, np.int64)
        ids[np.repeat(np.arange(len(x)), times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)] = np.asarray(lists.flatten())
        low, high = held.value[w].ranges(region, x) if w in held.value else ([], [])
        return pa.table({"width": [w], "region": [region], "shard": [shard], "low": [list(low)], "high": [list(high)], "tree": pa.array([pickle.dumps(VantageTree(x, ids, times, k), 5)], pa.binary())}, schema=schema)

    trees = dealt.groupBy("width", "region", "shard").applyInArrow(run, "width int, region int, shard int, low array<double>, high array<double>, tree binary")
    return VectorIndex(written(trees, "vantage-trees"), tops, k)


FOUND = "query long, vec_id long, score double"


def _meet(index: VectorIndex, pairs: DataFrame, relax: float, block_queries: int) -> DataFrame:
    """(query, vec_id, score): what the queries of ``pairs`` (query, embedding, width, region, shard, most) find in those shards."""
    keys = ["width", "region", "shard"]
    counts = pairs.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(block_queries)).cast("int").alias("blocks"))
    asked = pairs.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks")
    # A tree goes once to each block of the queries that want it.
    trees = index.trees.select(*keys, "tree").join(counts, keys).select(*(F.col(c).alias(f"t_{c}") for c in keys), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t_block"), "tree")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            own, most = (np.asarray(left.column(c).combine_chunks()) for c in ("query", "most"))
            asked = _matrix(left.column("embedding"))
            for raw in right.column("tree"):
                tree = pickle.loads(raw.as_py())
                for lo in range(0, len(own), MATRIX_ROWS):
                    some = slice(lo, lo + MATRIX_ROWS)
                    d, ids = tree.search(asked[some], most[some], relax)
                    there = np.isfinite(d)
                    out["query"].append(np.repeat(own[some], there.sum(1)))
                    out["vec_id"].append(ids[there])
                    out["score"].append(d[there])
        kinds = {"query": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({n: np.concatenate(x) if x else np.zeros(0, kinds[n]) for n, x in out.items()})

    return asked.groupBy(*keys, "block").cogroup(trees.groupBy("t_width", "t_region", "t_shard", "t_block")).applyInArrow(run, FOUND)


def elsewhere(index: VectorIndex, asked: DataFrame, relax: float) -> DataFrame:
    """(query, embedding, width, region, most): the other regions in which a query's nearest may be."""
    # Ranges of regions, not of shards: at most ``MOST_REGIONS`` of a width.
    bounds: dict[int, list] = {}
    for r in index.trees.select("width", "region", "low", "high").groupBy("width", "region").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")).collect():
        bounds.setdefault(r["width"], []).append((r["region"], np.array(r["low"]).min(0), np.array(r["high"]).max(0)))
    held = asked.sparkSession.sparkContext.broadcast((index.tops, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, ranges = held.value
        for batch in batches:
            for w, some in _by_width(batch):
                if w not in tops:
                    continue
                x = _matrix(some.column(some.schema.get_field_index("embedding"))).astype(np.float64)
                home, most = (np.asarray(some.column(some.schema.get_field_index(c))) for c in ("region", "most"))
                d = np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in tops[w].vantages], 1) if len(tops[w].vantages) else np.zeros((len(x), 0))
                rows, regions = [], []
                for region, low, high in ranges.get(w, ()):
                    least = beyond(d[:, tops[w].paths[region]], low, high).max(1, initial=0)
                    want = np.flatnonzero((home != region) & (least * relax <= most * (1 + 1e-12)))
                    rows.append(want)
                    regions.append(np.full(len(want), region, np.int32))
                if rows and sum(map(len, rows)):
                    at = pa.array(np.concatenate(rows))
                    out = some.select(["query", "embedding", "width", "most"]).take(at)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(regions))], names=["query", "embedding", "width", "most", "region"])

    kind = asked.schema["embedding"].dataType.simpleString()
    return asked.select("query", "embedding", "width", "region", "most").mapInArrow(run, f"query long, embedding {kind}, width int, most double, region int")


def search(index: VectorIndex, queries: DataFrame, relax: float = RELAX, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, smallest distance first."""
    k = index.k
    rows = taking_part(queries)
    # Equal queries are searched once; each row then leaves out its own.
    points = written(with_regions(rows.select("embedding", "width").distinct(), index.tops).withColumn("query", F.monotonically_increasing_id()), "vector-queries")
    shards = index.trees.select("width", "region", "shard")
    at_home = points.withColumn("most", F.lit(float("inf"))).join(shards, ["width", "region"])
    near = written(_nearest(_meet(index, at_home, relax, block_queries), k), "vector-found")
    if index.tops:
        bound = near.filter(F.col("place") == k + 1).select("query", F.col("score").alias("most"))
        known = points.join(bound, "query", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        more = written(elsewhere(index, known, relax), "vector-pairs").join(shards, ["width", "region"])
        near = _nearest(near.drop("place").unionByName(_meet(index, more, relax, block_queries)), k)
    # Rows of one vector at distance 0: each query's own goes, the others close up.
    found = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    each = rows.select("embedding", F.col("vec_id").alias("query_id")).join(points.select("embedding", "query"), "embedding").select("query", "query_id").join(found, "query")
    own = F.array_position("found", F.struct(F.lit(0.0).alias("score"), F.col("query_id").alias("vec_id"))).cast("int")
    kept = F.slice(F.filter("found", lambda x, i: i + 1 != own), 1, k)
    return each.select("query_id", F.posexplode(kept).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k + 1)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding")
    return search(build(vectors, 10), vectors.filter(F.col("vec_id") % 100 == 0))
