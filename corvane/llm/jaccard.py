"""Operator 8: documents linked by the Jaccard similarity of their word shingles.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least 0.75.
The answer has one row per document: its set's size and its component, named by
the smallest id that links reach.

1. Sets and frequencies. Texts become sets of 64-bit shingle hashes, in groups of
   documents; equal sets of a group are one. Per group and hash range one packed
   row goes to the range's reducer, which counts in how many sets each shingle is; for
   shingles of a single set nothing comes back. So texts are read once and never moved.
2. Prefixes. A linked pair shares at least ``ceil(0.75 n)`` shingles with either side's n. With shingles
   ordered from rare to frequent, both must then share one of their first
   ``n - ceil(0.75 n) + 1``. Shingles of a single set come first and match nothing, so most documents
   drop out here, and passages that many documents share stand last.
3. Count vectors. Shingles are hashed into groups and a document is the point of its group counts; the overlap of two documents is
   at most the sum of their coordinates' minima, and for a node of an R-tree over such points that of the point's and
   the upper corner's. Documents that share a bucket (a prefix shingle) with the same smallest id are one group; a group's
   R-tree names for each document the smallest id that its bound leaves. These pairs are verified exactly; they join nearly
   all copies without a look at each pair.
4. The rest. Buckets that still hold documents of different components are searched with an R-tree for all pairs across
   components, which are verified exactly. Large groups and buckets are cut into blocks, and of a bucket each pair of blocks is a
   task. No pair of different components is left out, so none of the links that make components is lost; links
   within a component are neither enumerated nor counted, as a group of copies has the square of its size of them.

Equal sets are one node with the smallest id of their documents from step 2 on.

Shingles are compared by 64-bit hashes within a document and by at least 46 of those bits
between documents (a wrong link would need a chance of about one in a billion at the very edge of
the threshold).

Cases: a text with fewer than five words is one shingle, its whole sequence; a null text, or
one without words, has size 0 and links with nothing; a null id is never linked;
rows with equal ids are one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.shared import SpanHasher, bounded_pieces, flat_bytes, lowered, mixed, table, tidy, word_spans, written

SIZE, GROUP_BYTES, KEY_BITS, MOST_BITS = 5, 4 << 20, 40, 22
COORDINATES, LEAF, BLOCK, PART_ROWS = 64, 32, 1_024, 4_000
META = 1 << 24
HEAVY_SHARE = 1_000
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
PACKED = "grp string, r int, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary, b5 binary"
_NAMES = ["grp", "r", "b0", "b1", "b2", "b3", "b4", "b5"]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all distinct shingles of consecutive texts, sorted by row and hash."""
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = SpanHasher(data)(starts, ends)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    rows, hashes = [], []
    if len(w) >= SIZE:
        full = row[: len(w) - SIZE + 1] == row[SIZE - 1 :]
        h = np.zeros(len(w) - SIZE + 1, np.uint64)
        for j in range(SIZE):
            h += w[j : len(w) - SIZE + 1 + j] * _STEP[j]
        rows.append(row[: len(h)][full])
        hashes.append(mixed(h[full]))
    few = (n > 0) & (n < SIZE)
    if few.any():
        short = np.flatnonzero(few)
        h = n[short].astype(np.uint64) * _STEP[SIZE]
        for j in range(SIZE - 1):
            there = n[short] > j
            h[there] += w[first[short[there]] + j] * _STEP[j]
        rows.append(short)
        hashes.append(mixed(h))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _five(keys: np.ndarray) -> tuple[bytes, bytes]:
    """The low 40 bits as 32 and 8."""
    return keys.astype("<u4").tobytes(), (keys >> np.uint64(32)).astype(np.uint8).tobytes()


def _forty(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)


def _packed_group(name: str, ids: np.ndarray, null: np.ndarray, row: np.ndarray, h: np.ndarray, bits: int) -> pa.RecordBatch:
    """A group's rows: one with its documents, and one per hash range with its shingles."""
    n = np.bincount(row, minlength=len(ids)).astype(np.int64)
    first, second = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
    if len(row):
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        first[row[begin]] = np.add.reduceat(mixed(h ^ _STEP[1]), begin)
        second[row[begin]] = np.add.reduceat(mixed(h + _STEP[2]), begin)
    order = np.lexsort((ids, null, second, first, n))
    same = np.zeros(len(ids), bool)
    if len(ids) > 1:
        a, b = order[1:], order[:-1]
        same[1:] = (n[a] == n[b]) & (first[a] == first[b]) & (second[a] == second[b])
    sends = np.zeros(len(ids), bool)
    sends[order[~same]] = True
    sends &= (n > 0) & ~null
    keep = sends[row]
    key = h[keep] >> np.uint64(64 - KEY_BITS - bits)
    doc = row[keep]
    by = np.argsort(key, kind="stable")
    key, doc = key[by], doc[by]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(key)))
    distinct = key[begin]
    lone = times == 1
    shared_rows = np.repeat(~lone, times)
    out: list[list] = [[] for _ in _NAMES]
    meta = (ids, null, n, first, second, sends, distinct[~lone], times[~lone], doc[shared_rows].astype("<u2"))
    for column, value in zip(out, [name, META + int(mixed(np.array([hash_name(name)], np.uint64))[0] % np.uint64(1 << bits)), pickle.dumps(meta, 5), *[None] * 5]):
        column.append(value)
    ranges, cuts = np.unique(distinct >> np.uint64(KEY_BITS), return_index=True)
    low40 = distinct & np.uint64((1 << KEY_BITS) - 1)
    owner = doc[begin].astype("<u2") if len(begin) else np.zeros(0, "<u2")
    for r, a, b in zip(ranges.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(distinct)]):
        k, one = low40[a:b], lone[a:b]
        for column, value in zip(out, [name, r, *_five(k[one]), owner[a:b][one].tobytes(), *_five(k[~one]), times[a:b][~one].astype("<u4").tobytes()]):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.binary()) for x in out[2:])], names=_NAMES)


def hash_name(name: str) -> int:
    part, _, seq = name.partition("-")
    return int(part) * 1_000_003 + int(seq)


def _count_range(rows: pa.Table) -> pa.Table:
    """In how many sets each shingle of a hash range is; back go those of two sets or more, with the
    logarithm of that number."""
    if rows.column("r")[0].as_py() >= META:
        return rows
    got = rows.to_pydict()
    lone = [_forty(a, b) for a, b in zip(got["b0"], got["b1"])]
    many = [_forty(a, b) for a, b in zip(got["b3"], got["b4"])]
    times = [np.frombuffer(x, "<u4") for x in got["b5"]]
    every = np.concatenate([*lone, *many])
    weight = np.concatenate([np.ones(sum(map(len, lone))), *times])
    distinct, inverse = np.unique(every, return_inverse=True)
    frequency = np.bincount(inverse, weights=weight, minlength=len(distinct))
    level = np.minimum(255, np.floor(4 * np.log2(np.maximum(frequency, 1)))).astype(np.uint8)[inverse]
    often = frequency[inverse] >= 2
    out: dict[str, list] = {x: [] for x in _NAMES}
    at, after = 0, sum(map(len, lone))
    for i in range(rows.num_rows):
        a, b = slice(at, at + len(lone[i])), slice(after, after + len(many[i]))
        at, after = a.stop, b.stop
        keep = often[a]
        if not keep.any() and not len(many[i]):
            continue
        low, high = _five(lone[i][keep])
        doc = np.frombuffer(got["b2"][i], "<u2")[keep]
        low2, high2 = _five(many[i])
        for name, value in zip(_NAMES, [got["grp"][i], got["r"][i], low, high, doc.tobytes(), level[a][keep].tobytes(), low2 + high2, level[b].tobytes()]):
            out[name].append(value)
    return pa.table([pa.array(out["grp"], pa.string()), pa.array(out["r"], pa.int32()), *(pa.array(out[x], pa.binary()) for x in _NAMES[2:])], names=_NAMES)


SETS = "doc_id long, n long, d1 long, d2 long, prefix int, shared array<long>, counts array<int>"


def _prefixes(rows: pa.Table) -> pa.Table:
    """One row per document of a group: its shared shingles from rare to frequent, and how many of them are prefix."""
    got = rows.to_pydict()
    meta = next(b for r, b in zip(got["r"], got["b0"]) if r >= META)
    ids, null, n, first, second, sends, many, times, many_docs = pickle.loads(meta)
    keys, docs, levels, many_keys, many_levels = [], [], [], [], []
    for i, r in enumerate(got["r"]):
        if r >= META:
            continue
        top = np.uint64(r) << np.uint64(KEY_BITS)
        keys.append(_forty(got["b0"][i], got["b1"][i]) | top)
        docs.append(np.frombuffer(got["b2"][i], "<u2"))
        levels.append(np.frombuffer(got["b3"][i], np.uint8))
        k = len(got["b5"][i])
        many_keys.append(_forty(got["b4"][i][: 4 * k], got["b4"][i][4 * k :]) | top)
        many_levels.append(np.frombuffer(got["b5"][i], np.uint8))
    if many_keys:
        mk, ml = np.concatenate(many_keys), np.concatenate(many_levels)
        at = np.argsort(mk)
        keys.append(np.repeat(many, times))
        docs.append(many_docs)
        levels.append(np.repeat(ml[at][np.searchsorted(mk[at], many)] if len(many) else ml[:0], times))
    key = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
    doc = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
    level = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
    held = np.bincount(doc, minlength=len(ids))
    least = -(-3 * n // 4)
    prefix = np.where(sends & (held >= least) & (n > 0), held - least + 1, 0)
    keep = prefix[doc] > 0
    key, doc, level = key[keep], doc[keep], level[keep]
    order = np.lexsort((key, level, doc))
    key, doc = key[order], doc[order]
    ends = np.searchsorted(doc, np.arange(len(ids) + 1))
    shared = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key), mask=pa.array(prefix == 0))
    counts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(prefix > 0, COORDINATES, 0))), pa.int32()), pa.array(count_vectors(key, doc, len(ids))[prefix > 0].ravel()), mask=pa.array(prefix == 0))
    return pa.table(
        [pa.array(ids, pa.int64(), mask=null), pa.array(n), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(prefix.astype(np.int32)), shared, counts],
        names=["doc_id", "n", "d1", "d2", "prefix", "shared", "counts"],
    )


def prefix_table(docs: DataFrame) -> DataFrame:
    """Written table of all documents: id, set size, set digest, prefix length and shared shingles."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    splits = max(1, rows.rdd.getNumPartitions())
    bits = int(min(MOST_BITS, max(6, math.ceil(math.log2(2 * splits)))))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = count = 0

        def group() -> pa.RecordBatch:
            rows = np.concatenate([x[2] for x in held])
            return _packed_group(f"{part}-{seq}", np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), rows, np.concatenate([x[3] for x in held]), bits)

        for batch in batches:
            for some in bounded_pieces(batch, "text"):
                for lo in range(0, some.num_rows, 20_000):
                    piece = some.slice(lo, 20_000)
                    ids = piece.column(0)
                    data, offsets = flat_bytes(piece.column(1))
                    row, h = shingle_sets(data, offsets)
                    held.append((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), row + count, h))
                    size, count = size + len(data), count + piece.num_rows
                    if size >= GROUP_BYTES or count >= 40_000:
                        yield group()
                        held, size, count, seq = [], 0, 0, seq + 1
        if held:
            yield group()

    counted = rows.mapInArrow(tidy(groups), PACKED).groupBy("r").applyInArrow(_count_range, PACKED)
    return written(counted.groupBy("grp").applyInArrow(_prefixes, SETS), "shingle-sets")


def linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets are similar enough, by exact intersection. Sets travel only for pairs that count
    vectors have left."""

    def side(x: str) -> DataFrame:
        return nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"shared_{x}"))

    both = F.size(F.array_intersect("shared_a", "shared_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * both >= 75 * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def count_vectors(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Group counts of each row's shingles."""
    cell = rows.astype(np.int64) * COORDINATES + (mixed(keys.astype(np.uint64)) % np.uint64(COORDINATES)).astype(np.int64)
    return np.bincount(cell, minlength=n * COORDINATES).reshape(n, COORDINATES).astype(np.int32)


class CountTree:
    """An R-tree over count vectors: leaves of points alike in size and counts, and above them nodes of
    leaves. Of a node's box the upper corner and the smallest size are all that a bound needs."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*points.T[:8].astype(np.int64), points.argmax(1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: (corner, smallest size, largest size)
        corner, small, large = self.points, self.sizes, self.sizes
        while len(corner) > 1:
            at = np.arange(0, len(corner), LEAF)
            corner, small, large = np.maximum.reduceat(corner, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)
            self.levels.append((corner, small, large))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points (numbers as given) whose overlap with ``point`` may be enough."""
        some = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for corner, small, large in reversed(self.levels):
            some = some[self._may(point, size, corner[some], small[some], large[some])]
            some = (some[:, None] * LEAF + np.arange(LEAF)).ravel()
            below = len(self.points) if corner is self.levels[0][0] else len(self.levels[[x[0] is corner for x in self.levels].index(True) - 1][0])
            some = some[some < below]
        some = some[self._may(point, size, self.points[some], self.sizes[some], self.sizes[some])]
        return self.order[some]

    @staticmethod
    def _may(point: np.ndarray, size: int, corner: np.ndarray, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        overlap = np.minimum(corner, point).sum(1)
        return (4 * large >= 3 * size) & (3 * small <= 4 * size) & (7 * overlap >= 3 * (size + np.maximum(small, -(-3 * size // 4))))


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order by the columns, and its runs of rows that are equal in all but the last of them."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns[:-1]], axis=0)
    cut = np.flatnonzero(new)
    return order, list(zip(cut.tolist(), [*cut[1:].tolist(), len(order)]))


def _points(rows: pa.Table) -> np.ndarray:
    return np.asarray(rows.column("counts").combine_chunks().flatten()).reshape(-1, COORDINATES)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    none = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate(a) if a else none, "b": np.concatenate(b) if b else none})


def _group_pairs(rows: pa.Table) -> pa.Table:
    """For each document of a block of a group the smallest id that the count vectors leave."""
    hub, block, node, n = (np.asarray(rows.column(x).combine_chunks()) for x in ("hub", "block", "node", "n"))
    points = _points(rows)
    order, runs = _runs(hub, block, node)
    a, b = [], []
    for lo, hi in runs:
        some = order[lo:hi]
        tree = CountTree(points[some], n[some])
        for k, x in enumerate(some[1:].tolist(), 1):  # the nodes of a run ascend
            low = tree.near(points[x], int(n[x])).min(initial=k)
            if low < k:
                a.append(node[some[low]])
                b.append(node[x])
    return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _bucket_pairs(rows: pa.Table) -> pa.Table:
    """Pairs of different components in a bucket that the count vectors do not rule out."""
    key, i, j, block, node, n, comp = (np.asarray(rows.column(x).combine_chunks()) for x in ("key", "i", "j", "block", "node", "n", "component"))
    points = _points(rows)
    order, runs = _runs(key, i, j, node)
    a, b = [], []
    for lo, hi in runs:
        some = order[lo:hi]
        across = i[some[0]] != j[some[0]]
        left = some[block[some] == i[some[0]]]
        right = some[block[some] == j[some[0]]] if across else some
        if not len(left) or not len(right):
            continue
        tree = CountTree(points[right], n[right])
        for x in left:
            found = right[tree.near(points[x], int(n[x]))]
            found = found[(comp[found] != comp[x]) & ((node[found] > node[x]) | across)]
            if len(found):
                a.append(np.minimum(node[x], node[found]))
                b.append(np.maximum(node[x], node[found]))
    return _pairs(a, b)


def group_pairs(buckets: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """(a, b): candidates that the R-trees of groups find, one a document and group at most."""
    stars = written(buckets.filter("node != hub").select("hub", "node").distinct(), "shingle-groups")
    # A large group is cut into blocks; its smallest id stands in each.
    sizes = stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = stars.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"))
    parts = max(1, math.ceil(stars.count() / PART_ROWS))
    dealt = members.unionByName(hubs).join(open_nodes.select("node", "n", "counts"), "node")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("hub", "block"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(_group_pairs, "a long, b long").distinct()


def join_sets(sets: DataFrame) -> DataFrame:
    """(node, n, d1, d2, copies, component) of every class of equal, non-empty sets."""
    rows = sets.filter("n > 0 and doc_id is not null")
    nodes = written(rows.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max(F.struct("prefix", "shared", "counts")).alias("p")).select("node", "n", "d1", "d2", "copies", "p.prefix", "p.shared", "p.counts"), "shingle-nodes")
    open_nodes = nodes.filter("prefix > 0").select("node", "n", "prefix", "shared", "counts")
    bucket = open_nodes.select(F.explode(F.array_distinct(F.slice("shared", F.lit(1), F.col("prefix")))).alias("key"), "node")
    hubs = bucket.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    buckets = written(bucket.join(hubs, "key").select("key", "node", "members", "hub"), "shingle-buckets")
    links = written(linked(group_pairs(buckets, open_nodes), open_nodes), "shingle-links")
    found = written(components(links), "shingle-components")
    # Buckets that hold several components still, each membership once.
    known = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("members").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sig")).filter("low != high")
    left = left.groupBy("sig", "members", "low", "high").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rest = known.select("key", "node", "component").join(left, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = written(rest.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component"), "shingle-rest")
    # Small buckets share a task; each pair of blocks of a large one is its own key.
    parts = max(1, math.ceil(rest.count() / PART_ROWS))
    dealt = rest.join(open_nodes.select("node", "n", "counts"), "node").withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)).cast("int"))
    pairs = dealt.groupBy("part").applyInArrow(_bucket_pairs, "a long, b long").distinct()
    more = written(linked(pairs, open_nodes), "shingle-links")
    if not more.isEmpty():
        found = written(components(links.unionByName(more)), "shingle-components")
    return nodes.join(found, "node", "left").select("node", "n", "d1", "d2", "copies", F.coalesce("component", "node").alias("component"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    sets = prefix_table(docs).select("doc_id", "n", "d1", "d2", "prefix", "shared", "counts")
    classes = written(join_sets(sets).filter("copies > 1 or component != node").select("n", "d1", "d2", "copies", "component"), "shingle-classes")
    rows = sets.select("doc_id", "n", "d1", "d2")
    bound = max(100, rows.count() // HEAVY_SHARE)
    # Fewer than a thousand classes have more than a thousandth of all rows: these are broadcast.
    heavy = F.broadcast(classes.filter(F.col("copies") > bound).drop("copies"))
    light = classes.filter(F.col("copies") <= bound).drop("copies")
    keys = ["n", "d1", "d2"]
    many = rows.join(heavy, keys)
    few = rows.join(heavy, keys, "left_anti").join(light, keys, "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return many.unionByName(few).select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
