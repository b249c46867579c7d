"""Operator 9: benchmark decontamination with BM25 and block-max WAND.

Test items are indexed by their words; each posting holds the word's BM25 weight in
the item over the sum of the item's weights, so that an item's own text scores 1.
Items of like length stand in blocks, and every list knows its largest weight in each block.

Items stand in classes by length: all up to ``SHORT_ITEM_WORDS`` words, then by doubling
lengths without an end. For each class every training document is read as passages that
overlap by half and are twice as long as the longest item of the class, so some passage
holds any item's text whole, and long items do not widen the passages of short ones. Word
statistics are those of all classes together.

A passage is a query. First, for a whole batch of passages at once, blocks are bounded: words that carry the most weight of an item
are its essential postings, and the rest of an item weighs less than ``REST``; a block can only reach the threshold if the
essential block maxima that the passage hits, plus the block's largest rest, reach it. What is left is traversed passage
by passage with block-max WAND: lists stand in the order of their current items, the pivot is the first item at which their
maxima can reach the threshold, the maxima of its block are tried before it is scored, and lists skip to
the pivot or past the block. All items at or over the threshold are retrieved: pruning loses none.

A retrieved pair is then verified on words in order: the item's text is divided into
question and answer (at its last line or question mark; else the last third of its words
is the answer), and of the 3-word shingles of either part a share of ``OVERLAP`` must occur in the document.

The index is built per part of ``INDEX_BYTES`` of items at most, so what is broadcast is bounded;
more items make more parts, each of which meets all documents in its turn: only one part's index is held at a time. Word
statistics are counted over the items of all parts, so a score does not depend on how items fall into parts.

Cases: null and empty texts match nothing; items without words are never matched;
repeated items and documents are each matched; a null ``doc_id`` or ``item_id`` is an id like others; empty tables give an empty result;
other columns, also those with the same names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import SpanHasher, bounded_pieces, table, texts, tidy, written

K1, B, THRESHOLD, REST, OVERLAP = 1.2, 0.75, 0.6, 0.2, 0.5
BLOCK_ITEMS, SHORT_ITEM_WORDS, INDEX_BYTES, SHINGLE = 8, 400, 16 << 20, 3
WORD = regex.compile(r"[\p{L}\p{N}]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of ASCII letters, digits and longer characters) and the first word of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IN_WORD[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return SpanHasher(data)(starts, ends), np.searchsorted(starts, offsets)


def packed(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts in lower case, end to end."""
    raw = [x.lower().encode() for x in rows]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@dataclass
class ItemIndex:
    ids: list
    terms: np.ndarray  # hashes, ascending
    # All postings by term: items, which are numbered by length, and weights. A block is BLOCK_ITEMS numbers.
    first: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    # Essential postings by term and block: blocks and maxima.
    block_first: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    block_rest: np.ndarray
    parts: list[tuple[frozenset, frozenset]]
    longest: int
    threshold: float


def shingles(hashes: list[int], size: int = SHINGLE) -> frozenset:
    """Runs of ``size`` words; a shorter text is one run."""
    if not hashes:
        return frozenset()
    return frozenset(tuple(hashes[i : i + size]) for i in range(max(1, len(hashes) - size + 1)))


def question_and_answer(text: str) -> tuple[str, str]:
    body = text.strip()
    cut = max(body.rfind("?"), body.rfind("\n")) + 1
    if 0 < cut < len(body) and WORD.search(body[cut:]) and WORD.search(body[:cut]):
        return body[:cut], body[cut:]
    found = list(WORD.finditer(body))
    if len(found) < 3:
        return body, body
    at = found[len(found) * 2 // 3].start()
    return body[:at], body[at:]


@dataclass
class WordStatistics:
    """What weights need to know of all items, whichever index an item stands in."""

    terms: np.ndarray  # hashes, ascending
    df: np.ndarray
    n_items: int
    mean: float


def statistics(hashes: np.ndarray, first: np.ndarray) -> WordStatistics:
    """Of consecutive items' words."""
    n = len(first) - 1
    terms, term_of = np.unique(hashes, return_inverse=True)
    pair = np.unique(term_of.astype(np.int64) * max(1, n) + np.repeat(np.arange(n), np.diff(first)))
    return WordStatistics(terms, np.bincount(pair // max(1, n), minlength=len(terms)), n, max(1.0, len(hashes) / max(1, n)))


def classes(lengths: np.ndarray) -> np.ndarray:
    """The class of each length in words."""
    return np.ceil(np.log2(np.maximum(lengths, SHORT_ITEM_WORDS) / SHORT_ITEM_WORDS)).astype(np.int64)


def build_classes(ids: list[int], item_texts: list[str], threshold: float = THRESHOLD, known: WordStatistics | None = None) -> list[ItemIndex]:
    """One index for each class of lengths that has items."""
    hashes, first = words(*packed(item_texts))
    known = known or statistics(hashes, first)
    kind = classes(np.diff(first))
    chosen = [np.flatnonzero(kind == k).tolist() for k in np.unique(kind)]
    return [build([ids[i] for i in some], [item_texts[i] for i in some], threshold, known) for some in chosen]


def build(ids: list[int], item_texts: list[str], threshold: float = THRESHOLD, known: WordStatistics | None = None) -> ItemIndex:
    """An index whose passages suit its longest item; ``known`` are statistics that cover these items and others."""
    # Blocks hold items of like length: their maxima then are close to their items' weights.
    by_length = np.argsort(np.diff(words(*packed(item_texts))[1]), kind="stable").tolist()
    ids, item_texts = [ids[i] for i in by_length], [item_texts[i] for i in by_length]
    hashes, first = words(*packed(item_texts))
    known = known or statistics(hashes, first)
    item_of = np.repeat(np.arange(len(ids)), np.diff(first))
    terms, term_of = np.unique(hashes, return_inverse=True)
    pair, tf = np.unique(term_of.astype(np.int64) * max(1, len(ids)) + item_of, return_counts=True)
    term, item = pair // max(1, len(ids)), pair % max(1, len(ids))
    df = known.df[np.searchsorted(known.terms, terms)]
    length = np.diff(first)
    idf = np.log1p((known.n_items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / known.mean))
    total = np.bincount(item, weights=weight, minlength=len(ids))
    weight = weight / np.where(total > 0, total, 1)[item]
    block_of = np.arange(len(ids)) // BLOCK_ITEMS
    order = np.lexsort((term, -weight, item))
    running = np.cumsum(weight[order])
    starts = np.searchsorted(item[order], np.arange(len(ids)))
    base = np.concatenate([[0.0], running])[starts]
    left = 1 - (running - base[item[order]])  # weight of an item after this posting
    essential = np.zeros(len(pair), bool)
    essential[order] = left + weight[order] > REST
    rest = 1 - np.bincount(item, weights=weight * essential, minlength=len(ids))
    n_blocks = int(block_of.max()) + 1 if len(ids) else 0
    block_rest = np.zeros(n_blocks)
    np.maximum.at(block_rest, block_of[total > 0], rest[total > 0])
    key = term[essential] * max(1, n_blocks) + block_of[item[essential]]
    pairs, inverse = np.unique(key, return_inverse=True)
    maxima = np.zeros(len(pairs))
    np.maximum.at(maxima, inverse, weight[essential])
    block_term = pairs // max(1, n_blocks)
    parts = []
    for text in item_texts:
        sides = []
        for side in question_and_answer(text):
            h, _ = words(*packed([side]))
            sides.append(shingles(h.tolist()))
        parts.append((sides[0], sides[1]))
    span = np.arange(len(terms) + 1)
    return ItemIndex(
        ids,
        terms,
        np.searchsorted(term, span),
        item,
        weight,
        np.searchsorted(block_term, span),
        pairs % max(1, n_blocks),
        maxima,
        block_rest,
        parts,
        int(length.max(initial=1)),
        threshold,
    )


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term all places of its list: (index into ``terms``, place)."""
    n = first[terms + 1] - first[terms]
    who = np.repeat(np.arange(len(terms)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + first[terms][who]


def retrieve(index: ItemIndex, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score) of all items at or over the threshold in some passage of a row, the best passage's score."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(hashes) or not len(index.terms):
        return none
    at = np.searchsorted(index.terms, hashes)
    at[at == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[at] == hashes)
    if not len(known):
        return none
    term = at[known]
    row = np.searchsorted(first, known, side="right") - 1
    # Passage numbers: each row has its own run of them; a word stands in two passages.
    step = index.longest
    n_passages = np.diff(first) // step + 1
    base = np.cumsum(n_passages) - n_passages
    here = base[row] + (known - first[row]) // step
    earlier = (known - first[row]) // step > 0
    passage = np.concatenate([here, here[earlier] - 1])
    term = np.concatenate([term, term[earlier]])
    key = np.unique(passage * len(index.terms) + term)
    passage, term = key // len(index.terms), key % len(index.terms)
    # First the blocks' bounds, then the items of those blocks that can reach the threshold.
    who, place = _expand(index.block_first, term)
    n_blocks = max(1, len(index.block_rest))
    cell = passage[who] * n_blocks + index.blocks[place]
    order = np.argsort(cell, kind="stable")
    cells, begin = np.unique(cell[order], return_index=True)
    if not len(cells):
        return none
    bound = np.add.reduceat(index.maxima[place][order], begin) + index.block_rest[cells % n_blocks]
    alive = cells[bound >= index.threshold - 1e-9]
    if not len(alive):
        return none
    # Then, passage by passage, the items of these blocks.
    best: dict[tuple[int, int], float] = {}
    order = np.argsort(passage, kind="stable")
    passage, term = passage[order], term[order]
    live = np.unique(alive // n_blocks)
    begin, end = np.searchsorted(passage, live), np.searchsorted(passage, live, side="right")
    blocks = np.split(alive % n_blocks, np.searchsorted(alive // n_blocks, live[1:]))
    of_row = np.searchsorted(base, live, side="right") - 1
    for row, a, b, some in zip(of_row.tolist(), begin.tolist(), end.tolist(), blocks):
        for item, score in block_max_wand(index, term[a:b], some):
            best[row, item] = max(score, best.get((row, item), 0.0))
    if not best:
        return none
    pairs = sorted(best)
    return np.array([r for r, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64), np.array([best[p] for p in pairs])


def block_max_wand(index: ItemIndex, terms: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
    """(item, score) of all items of some blocks at or over the threshold, for a passage of these terms."""
    who, place = _expand(index.first, terms)
    item = index.items[place]
    keep = np.isin(item // BLOCK_ITEMS, blocks)
    who, item, weight = who[keep], item[keep], index.weights[place][keep]
    cut = np.flatnonzero(np.diff(who)) + 1
    lists, end = [], len(index.ids)
    for items, weights in zip(np.split(item, cut), np.split(weight, cut)):
        if len(items):
            maxima: dict[int, float] = {}
            for i, w in zip((items // BLOCK_ITEMS).tolist(), weights.tolist()):
                maxima[i] = max(w, maxima.get(i, 0.0))
            lists.append([int(items[0]), 0, items.tolist(), weights.tolist(), maxima, float(weights.max())])
    least, found = index.threshold - 1e-9, []

    def skip(x: list, to: int) -> None:
        """Moves a list to its first item at or after ``to``."""
        x[1] = bisect_left(x[2], to, x[1])
        x[0] = x[2][x[1]] if x[1] < len(x[2]) else end

    while True:
        lists.sort(key=itemgetter(0))
        total, k = 0.0, 0
        while k < len(lists) and lists[k][0] < end and total < least:
            total += lists[k][5]
            k += 1
        if total < least:
            return found
        pivot = lists[k - 1][0]
        while k < len(lists) and lists[k][0] == pivot:
            k += 1
        block = pivot // BLOCK_ITEMS
        if sum([x[4].get(block, 0.0) for x in lists[:k]]) < least:
            # No item of this block up to the next list's can reach the threshold.
            after = min((block + 1) * BLOCK_ITEMS, lists[k][0] if k < len(lists) else end)
            for x in lists[:k]:
                skip(x, after)
        elif lists[0][0] == pivot:
            score = sum([x[3][x[1]] for x in lists[:k]])
            if score >= least:
                found.append((pivot, score))
            for x in lists[:k]:
                skip(x, pivot + 1)
        else:
            for x in lists[:k]:
                if x[0] < pivot:
                    skip(x, pivot)


def overlaps(index: ItemIndex, item: int, document: frozenset | set, document_words: set) -> tuple[float, float]:
    """Shares of the question's and the answer's shingles that the document holds."""
    out = []
    for side in index.parts[item]:
        short = next(iter(side), ())
        held = sum(1 for x in side if (x in document if len(x) == SHINGLE else all(w in document_words for w in x)))
        out.append(held / len(side) if side and short else 1.0)
    return out[0], out[1]


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def item_words(dealt: DataFrame) -> DataFrame:
    """A written table (part, word, df, length): the words of each part, with the number of items of all
    parts that hold the word, and how often the part's items do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (x for batch in batches for x in bounded_pieces(batch, "text")):
            hashes, first = words(*packed(texts(some.column(1))))
            for row, part in enumerate(some.column(0).to_pylist()):
                word, n = np.unique(hashes[first[row] : first[row + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), part, np.int64)), pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["part", "word", "n"])

    found = dealt.select("part", "text").mapInArrow(tidy(run), "part long, word long, n long")
    counted = found.groupBy("part", "word").agg(F.count("*").alias("df"), F.sum("n").alias("length"))
    return written(counted.withColumn("df", F.sum("df").over(Window.partitionBy("word"))), "item-words")


def item_parts(items: DataFrame, most_bytes: int = INDEX_BYTES) -> Iterator[list[ItemIndex]]:
    """Indexes by class over parts of the items with about ``most_bytes`` of text each (one item at least), one part after the other."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most_bytes)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) if n > 1 else F.lit(0).cast("long"))
    if n > 1:
        all_words, n_items = item_words(dealt), rows.count()
        mean = max(1.0, (all_words.agg(F.sum("length")).first()[0] or 0) / max(1, n_items))
    known = None
    for k in range(n):
        got = sorted(((r["item_id"], r["text"]) for r in dealt.filter(F.col("part") == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if n > 1:
            held = all_words.filter(F.col("part") == k).select("word", "df").toArrow()
            word, df = (held.column(c).to_numpy().astype(np.int64) for c in ("word", "df"))
            order = np.argsort(word.view(np.uint64))
            known = WordStatistics(word.view(np.uint64)[order], df[order], n_items, mean)
        yield build_classes([i for i, _ in got], [t for _, t in got], known=known)


def contaminated(docs: DataFrame, items: DataFrame, most_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified pair."""
    spark = docs.sparkSession
    found: list[DataFrame] = []
    waiting = None
    for indexes in item_parts(items, most_bytes):
        if waiting is not None:
            # Several parts: each one's pairs are written before the next one's index is sent.
            found.append(written(waiting[0], "contaminated-part"))
            waiting[1].destroy()
        held = spark.sparkContext.broadcast(indexes)
        waiting = matched(docs, held), held
    if waiting is not None:
        found.append(waiting[0])
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def matched(docs: DataFrame, held) -> DataFrame:
    """Verified pairs of all documents with the items of a broadcast list of indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = held.value
        for some in (x for batch in batches for x in bounded_pieces(batch, "text")):
            ids = some.column(0).to_pylist()
            hashes, first = words(*packed(texts(some.column(1))))
            out = []
            for index in indexes:
                row, item, score = retrieve(index, hashes, first)
                seen = -1
                for r, i, s in zip(row.tolist(), item.tolist(), score.tolist()):
                    if r != seen:
                        mine = hashes[first[r] : first[r + 1]].tolist()
                        held_words, held_shingles, seen = set(mine), shingles(mine), r
                    q, a = overlaps(index, i, held_shingles, held_words)
                    if q >= OVERLAP and a >= OVERLAP:
                        out.append((ids[r], index.ids[i], s, q, a))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), SCHEMA)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, one row per pair."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
