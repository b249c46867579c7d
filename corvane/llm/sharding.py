"""Operator 5: sharding by minimax contiguous partition, with DataFrame operations only.

Rows with equal texts form one atomic group. Groups stand in the order of their
text's SHA-256; the shards are consecutive runs of groups, and the largest shard is
as small as any such cut can make it. The smallest feasible capacity is found by
binary search; a capacity is checked greedily: each shard takes groups while they
fit. With the capacity found, cuts are placed as evenly as it allows.

The order makes a cut a digest: a row's shard is the number of cut digests not above
its own, so neither a join nor a shuffle on a (possibly hot) text is needed.

The driver never holds all groups. They are summed by the first digits of their digests, at most 4,096 sums at once; a step
of the greedy check goes down these sums, asks for those of the part in which the byte that it looks for lies, and
only for a part of ``PART_GROUPS`` groups or fewer for the groups themselves. What it has seen is kept up to ``KEPT`` numbers, so
neither memory nor what one job brings depends on the number of groups.

Law ``bytes``: sizes near equal as far as groups allow. A group larger than a
sixteenth of all bytes makes a shard of its own size.

Cases: null and empty texts have size 1 and form one group; repeated rows stay
together, each with its own slot, and a null ``doc_id`` is one like others; fewer groups than shards leave shards empty; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import table, written

#: Digits that a step goes down; groups of a part that are read one by one, and of all parts that are read ahead; numbers that are kept.
DIGITS, PART_GROUPS, AHEAD_GROUPS, KEPT, SLOT_ROWS = 3, 2_048, 40_000, 200_000, 20_000


@dataclass
class Part:
    """What lies under a digest's first digits: prefixes one step longer, or whole digests, in order; where each ends in bytes, from
    the part's own beginning; and how many groups each holds."""

    names: list[str]
    ends: list[int]
    groups: list[int]


class GroupSizes:
    """Prefix sums of group sizes in digest order, read part by part."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.parts: dict[str, Part] = {}
        self.kept = 0
        self.most = groups.agg(F.max("bytes")).first()[0] or 0
        self._read([""], False)
        self.total = self.parts[""].ends[-1]

    def _read(self, prefixes: list[str], whole: bool) -> None:
        """Reads parts with one job: of ``whole`` ones the groups, of the others sums by the next digits."""
        width = len(prefixes[0])
        rows = self.groups if not width else self.groups.filter(reduce(or_, [F.col("digest").startswith(p) for p in prefixes]) if len(prefixes) < 64 else F.substring("digest", 1, width).isin(prefixes))
        name = F.col("digest") if whole else F.substring("digest", 1, width + DIGITS)
        found: dict[str, list] = {p: [] for p in prefixes}
        for r in rows.groupBy(name.alias("name")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect():
            found[r["name"][:width]].append((r["name"], r["bytes"], r["n"]))
        for p, got in found.items():
            got.sort()
            self.parts[p] = Part([x for x, _, _ in got], [0, *accumulate(b for _, b, _ in got)], [n for _, _, n in got])
            self.kept += len(got)

    def _part(self, prefix: str, groups: int) -> Part:
        if prefix not in self.parts:
            if self.kept > KEPT:
                self.parts = {"": self.parts[""]}
                self.kept = len(self.parts[""].names)
            self._read([prefix], groups <= PART_GROUPS)
        return self.parts[prefix]

    def _leaf(self, x: int) -> tuple[Part, int]:
        """The part of whole digests in which byte ``x`` lies, and where it begins."""
        part, base = self.parts[""], 0
        while True:
            k = min(max(bisect.bisect_right(part.ends, x - base) - 1, 0), len(part.names) - 1)
            if len(part.names[k]) == 64:
                return part, base
            base += part.ends[k]
            part = self._part(part.names[k], part.groups[k])

    def below(self, x: int) -> int:
        """The last boundary between groups at or before byte ``x``."""
        if x >= self.total:
            return self.total
        part, base = self._leaf(x)
        return base + part.ends[bisect.bisect_right(part.ends, x - base) - 1]

    def above(self, x: int) -> int:
        """The first boundary at or after byte ``x``."""
        if x <= 0:
            return 0
        if x >= self.total:
            return self.total
        part, base = self._leaf(x)
        return base + part.ends[bisect.bisect_left(part.ends, x - base)]

    def digest_at(self, boundary: int) -> str | None:
        """Digest of the group that begins at a boundary."""
        if boundary >= self.total:
            return None
        part, base = self._leaf(boundary)
        return part.names[bisect.bisect_left(part.ends, boundary - base)]

    def near(self, shards: int) -> None:
        """Reads the parts in which cuts can fall ahead, if they are few, in one job."""
        low = max(self.most, -(-self.total // shards))
        high = -(-self.total // shards) + self.most
        top, wanted = self.parts[""], set()
        for j in range(1, shards):
            first, last = (bisect.bisect_right(top.ends, x) - 1 for x in (max(0, j * (low - self.most)), min(self.total, j * high)))
            wanted.update(range(first, min(last, len(top.names) - 1) + 1))
            if sum(top.groups[k] for k in wanted) > AHEAD_GROUPS:
                return
        if wanted and max(top.groups[k] for k in wanted) <= PART_GROUPS:
            self._read([top.names[k] for k in sorted(wanted)], True)


def cuts(sizes: GroupSizes, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and boundaries of ``shards`` runs within it."""
    if not sizes.total:
        return 0, [0] * (shards - 1)
    sizes.near(shards)

    def ends(capacity: int) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = sizes.below(at + capacity)
            out.append(at)
        return out

    low, high = max(sizes.most, -(-sizes.total // shards)), -(-sizes.total // shards) + sizes.most
    while low < high:
        middle = (low + high) // 2
        found = ends(middle)
        if found[-1] >= sizes.total:
            high = max(b - a for a, b in zip([0, *found], found))  # no smaller than needed for these very cuts
            high = max(low, min(high, middle))
        else:
            low = middle + 1
    least = [sizes.total]  # from the right: what the first j shards must cover at least
    for _ in range(shards - 1):
        least.append(sizes.above(least[-1] - high))
    least.reverse()
    at, out = 0, []
    for j in range(shards - 1):
        even = at + -(-(sizes.total - at) // (shards - j))
        cut = sizes.below(even)
        if cut <= at or even - cut > (up := sizes.above(even)) - even:
            up = sizes.above(even)
            cut = up if up <= at + high else cut
        cut = max(cut, least[j], at)
        out.append(cut)
        at = cut
    return high, out


def size_column(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_column(F.col("text")).alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("digest"))
    rows = written(rows, "shard-rows")  # 60 bytes a row: texts are read once
    n = rows.count()
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")).sort("digest"), "shard-groups")
    sizes = GroupSizes(groups)
    _, at = cuts(sizes, shards)
    starts = [d for b in at if (d := sizes.digest_at(b)) is not None]
    # Equal cut digests: shards that stay empty.
    number = sum((F.when(F.col("digest") >= F.lit(d), 1).otherwise(0) for d in starts), F.lit(0)).cast("int")
    parts = max(1, math.ceil(n / (shards * SLOT_ROWS)))
    placed = rows.withColumn("shard", number).withColumn("_part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).cast("int"))
    # Rows of each (shard, part): shards x parts numbers, summed in the order of parts.
    counts = placed.groupBy("shard", "_part").count()
    before = counts.select("shard", "_part", (F.sum("count").over(Window.partitionBy("shard").orderBy("_part")) - F.col("count")).alias("_before"))
    numbered = placed.withColumn("_k", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "digest")))
    return numbered.join(before, ["shard", "_part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.col("_k") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
