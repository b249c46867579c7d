"""Operator 10: quality scores by nearest-neighbour voting in a latent space.

A text's terms are its character trigrams, its words, and what its writing looks like: trigrams of
character classes, and how it repeats itself (words like the one before, distinct
words, repeated lines), each measure as one of a few bins. The vocabulary is the trigrams and the words that most labelled texts
hold, counted where the texts are. Terms get a damped count
times inverse document frequency; a truncated singular value decomposition of the
labelled texts gives the latent axes. The labelled vectors, a bounded number, are
broadcast; every text is compared with all of them in blocks by one matrix product,
and its nearest neighbours vote with their labels, weighted by their cosine.

How many axes count, and how much trigrams and words weigh beside the rest, is chosen among ``DIMENSIONS`` and ``LEXICAL_WEIGHTS`` on the
labelled rows alone: a fifth of them is scored by the votes of the others; of equals the most axes are taken.

Fitting takes the ``sample`` labelled rows with the smallest hashes (a documented bound);
scoring covers whole texts of all rows. With no labelled rows every score is 0.5.

Cases: null and empty texts have no terms: their score is the mean label; a text
whose neighbours all have cosine 0 gets that too; equal cosines go to the labelled
row that comes first by hash; repeated rows get equal results; a null id belongs to no fold: it has no label and is not held out; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.langid import fold
from corvane.llm.shared import SpanHasher, bounded_pieces, flat_bytes, lowered, table, tidy, word_spans, written

SAMPLE, DIMENSIONS, NEIGHBOURS, THRESHOLD, SHARPNESS = 6_000, (40, 80), 25, 0.3, 4.0
LEXICAL_WEIGHTS = (1.0, 0.25)  # of trigrams and words beside shapes
MOST_TRIGRAMS, MOST_WORDS = 3_000, 2_000  # of the vocabulary
BLOCK_ROWS = 256


def _classes() -> np.ndarray:
    """A class for each byte: small letters, capitals, digits, beginnings and continuations
    of longer characters, space, line feed, other controls, and marks one by one or together."""
    out = np.full(256, 7, np.int32)
    out[97:123], out[65:91], out[48:58], out[0xC0:], out[0x80:0xC0], out[32], out[10] = 0, 1, 2, 3, 4, 5, 6
    for k, marks in enumerate((".", ",", ";:", "!", "?", "'\"`", "()[]{}<>", "|", "#", "$", "%", "&", "*", "-_", "=+~^", "/\\@")):
        for c in marks:
            out[ord(c)] = 8 + k
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
MEASURES = 8
BINS = 8
SHAPES = N_CLASSES**3 + MEASURES * BINS
BIN_COUNT = 60.0  # a bin counts as a term seen so often


Rows = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Vocabulary:
    """Trigrams (three bytes, A-Z as a-z, as one number) and hashes of words that are terms; both ascend. Their terms follow the shapes'."""

    trigrams: np.ndarray
    words: np.ndarray

    _slot: np.ndarray | None = None

    def __len__(self) -> int:
        return SHAPES + len(self.trigrams) + len(self.words)

    def of_trigrams(self, codes: np.ndarray) -> np.ndarray:
        """How often each trigram of the vocabulary stands among the codes."""
        if self._slot is None:
            self._slot = np.full(1 << 24, len(self.trigrams), np.int16)
            self._slot[self.trigrams] = np.arange(len(self.trigrams))
        return np.bincount(self._slot[codes], minlength=len(self.trigrams) + 1)[:-1]

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.bincount(at[self.words[at] == hashes], minlength=len(self.words))


def trigram_codes(data: np.ndarray) -> np.ndarray:
    b = lowered(data).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def term_rows(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> Rows:
    """Terms and damped counts of consecutive texts."""
    n = len(offsets) - 1
    if not len(data):
        return [(np.zeros(0, np.int32), np.zeros(0, np.float32))] * n
    code, trigrams = CLASS[data], trigram_codes(data)
    starts, ends, first = word_spans(data, offsets)
    hashes, plain = SpanHasher(data), SpanHasher(lowered(data))
    words, spelt = hashes(starts, ends), plain(starts, ends)
    breaks = np.flatnonzero(data == 10)
    out = []
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b - a < 1:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        c = code[a:b]
        counts = np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=1)
        terms = np.flatnonzero(counts)
        values = np.log1p(counts[terms])
        w = words[first[i] : first[i + 1]]
        nw = max(1, len(w))
        inner = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
        lines = hashes(np.concatenate([[a], inner + 1]), np.concatenate([inner, [b]]))
        by_class = np.bincount(c, minlength=N_CLASSES) / (b - a)
        distinct = len(np.unique(w)) / nw
        measures = (
            distinct,
            (w[1:] == w[:-1]).sum() / nw if len(w) > 1 else 0.0,
            1 - len(np.unique(lines)) / len(lines),
            2 * by_class[1],
            2 * by_class[8:].sum(),
            by_class[2] * 2,
            min(1.0, (b - a) / nw / 16),
            min(1.0, np.log1p(nw) / 10),
        )
        bins = [N_CLASSES**3 + m * BINS + min(BINS - 1, int(max(0.0, float(x)) * BINS)) for m, x in enumerate(measures)]
        lexical = np.concatenate([vocabulary.of_trigrams(trigrams[a : max(a, b - 2)]), vocabulary.of_words(spelt[first[i] : first[i + 1]])])
        held = np.flatnonzero(lexical)
        out.append((np.concatenate([terms, bins, SHAPES + held]).astype(np.int32), np.concatenate([values, np.full(MEASURES, np.log1p(BIN_COUNT)), np.log1p(lexical[held])]).astype(np.float32)))
    return out


@dataclass
class LatentModel:
    vocabulary: Vocabulary
    column: np.ndarray  # of each term, -1 where no labelled text has it
    axes: np.ndarray  # terms x dimensions, with the inverse document frequencies in it
    vectors: np.ndarray  # labelled rows, unit length
    labels: np.ndarray
    mean: float

    def project(self, rows: Rows) -> np.ndarray:
        return unit(dense(rows, self.column, len(self.axes)) @ self.axes)

    def scores(self, rows: Rows, neighbours: int) -> np.ndarray:
        return votes(self.project(rows), self.vectors, self.labels, neighbours, self.mean)


def votes(asked: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int, mean: float) -> np.ndarray:
    """Mean label of each row's nearest labelled vectors, weighted by a power of their cosines."""
    cosines = asked @ vectors.T
    k = min(neighbours, cosines.shape[1])
    if not k:
        return np.full(len(asked), mean)
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(1)
    voted = (weight * labels[near]).sum(1)
    return np.clip(np.where(total > 0, voted / np.where(total > 0, total, 1), mean), 0, 1)


def dense(rows: Rows, column: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, (terms, values) in enumerate(rows):
        at = column[terms]
        out[i, at[at >= 0]] = values[at >= 0]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def fit(rows: Rows, labels: np.ndarray, vocabulary: Vocabulary, dimensions: int | tuple[int, ...] = DIMENSIONS) -> LatentModel:
    """A model from labelled rows; rows are made dense a block at a time."""
    column = np.full(len(vocabulary), -1, np.int32)
    if not rows:
        return LatentModel(vocabulary, column, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), 0.5)
    frequency = np.bincount(np.concatenate([t for t, _ in rows]), minlength=len(vocabulary))
    used = np.flatnonzero(frequency >= min(2, len(rows)))
    column[used] = np.arange(len(used))
    idf = np.log1p(len(rows) / frequency[used]).astype(np.float32)
    tried = sorted({dimensions} if isinstance(dimensions, int) else set(dimensions))
    labels = labels.astype(np.float64)
    asked = np.arange(len(rows)) % 5 == 0
    choice = len(set(labels[asked])) > 1 and not asked.all()
    best, chosen = -1.0, None
    for weight in LEXICAL_WEIGHTS if choice else LEXICAL_WEIGHTS[:1]:
        scale = idf * np.where(used >= SHAPES, np.float32(weight), np.float32(1))
        axes = (latent_axes(rows, column, scale, tried[-1]) * scale[:, None]).astype(np.float32)
        raw = np.concatenate([dense(rows[i : i + BLOCK_ROWS], column, len(used)) @ axes for i in range(0, len(rows), BLOCK_ROWS)])
        for d in tried:
            x = unit(raw[:, :d])
            area = ranked_area(votes(x[asked], x[~asked], labels[~asked], NEIGHBOURS, float(labels.mean())), labels[asked]) if choice else 0.0
            if area >= best:  # of equals the later one, with more axes
                best, chosen = area, (axes[:, :d], x)
    return LatentModel(vocabulary, column, *chosen, labels, float(labels.mean()))


def latent_axes(rows: Rows, column: np.ndarray, idf: np.ndarray, wanted: int, rounds: int = 2) -> np.ndarray:
    """The right singular vectors of the weighted rows, by subspace iteration: terms x dimensions, the largest first."""
    width = len(idf)
    wanted = min(wanted, width)
    basis = np.linalg.qr(np.random.default_rng(10).normal(size=(width, min(width, wanted + 16))).astype(np.float32))[0]
    for last in range(rounds, -1, -1):
        image = np.zeros_like(basis)
        small = np.zeros((basis.shape[1],) * 2)
        for i in range(0, len(rows), BLOCK_ROWS):
            x = unit(dense(rows[i : i + BLOCK_ROWS], column, width) * idf)
            y = x @ basis
            if last:
                image += x.T @ y
            else:
                small += y.T.astype(np.float64) @ y
        if last:
            basis = np.linalg.qr(image)[0]
    _, turned = np.linalg.eigh(small)
    return basis @ turned[:, ::-1][:, :wanted].astype(np.float32)


def ranked_area(scores: np.ndarray, labels: np.ndarray) -> float:
    """The chance that a row of label 1 scores over one of label 0, ties being half."""
    values, inverse = np.unique(scores, return_inverse=True)
    ones, zeros = np.bincount(inverse, labels, len(values)), np.bincount(inverse, 1 - labels, len(values))
    return float((ones * (np.cumsum(zeros) - zeros / 2)).sum() / max(1.0, ones.sum() * zeros.sum()))


def vocabulary_of(sample: DataFrame) -> Vocabulary:
    """The trigrams and words that most texts of a sample hold; only these come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (x for batch in batches for x in bounded_pieces(batch, "text")):
            data, offsets = flat_bytes(some.column(0))
            if not len(data):
                continue
            codes, low = trigram_codes(data), lowered(data)
            starts, ends, first = word_spans(data, offsets)
            words = SpanHasher(low)(starts, ends).view(np.int64)
            for i in range(len(offsets) - 1):
                a, b = int(offsets[i]), int(offsets[i + 1])
                found = np.unique(codes[a : max(a, b - 2)]).astype(np.int64), np.unique(words[first[i] : first[i + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], list(map(len, found))).astype(np.int32)), pa.array(np.concatenate(found))], names=["kind", "term"])

    counts = sample.select("text").mapInArrow(tidy(run), "kind int, term long").groupBy("kind", "term").count().filter("count > 1")
    best = [counts.filter(F.col("kind") == k).orderBy(F.desc("count"), "term").limit(n).select("kind", "term") for k, n in ((0, MOST_TRIGRAMS), (1, MOST_WORDS))]
    rows = best[0].unionByName(best[1]).collect()
    return Vocabulary(np.sort(np.array([r["term"] for r in rows if r["kind"] == 0], np.int64)), np.sort(np.array([r["term"] for r in rows if r["kind"] == 1], np.int64).view(np.uint64)))


def _terms_of(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(key, label, terms, vals) for (key, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in bounded_pieces(batch, "text"):
                found = term_rows(*flat_bytes(some.column(2)), vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))],
                    names=["key", "label", "terms", "vals"],
                )

    return rows.mapInArrow(run, "key long, label int, terms array<int>, vals array<float>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LatentModel:
    """From labelled rows; ``labels`` has (doc_id, quality)."""
    key = F.xxhash64("doc_id", F.lit(10))
    # The broadcast is bounded by the sample. Of rows with one id and label one counts, and of documents with one id that whose text hashes lowest.
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"), key.alias("key")).distinct()
    chosen = F.broadcast(marked.orderBy("key", "doc_id", "label").limit(sample))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = written(texts, "quality-sample")
    vocabulary = vocabulary_of(texts)
    # As arrays, not as rows: their terms are views of one array.
    got = _terms_of(texts, vocabulary).toArrow()
    keys, label = (np.asarray(got.column(c)) for c in ("key", "label"))
    terms, values = (got.column(c).combine_chunks() for c in ("terms", "vals"))
    ends, held, weights = np.asarray(terms.offsets), np.asarray(terms.values), np.asarray(values.values)
    order = np.lexsort((label, keys))
    return fit([(held[ends[i] : ends[i + 1]], weights[ends[i] : ends[i + 1]]) for i in order.tolist()], label[order].astype(float), vocabulary)


def score(docs: DataFrame, model: LatentModel, extra: tuple[str, ...] = ("doc_id",), neighbours: int = NEIGHBOURS) -> DataFrame:
    """(*extra, score) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("text", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for some in bounded_pieces(batch, "text"):
                terms = term_rows(*flat_bytes(some.column(0)), model.vocabulary)
                scores = np.concatenate([model.scores(terms[i : i + BLOCK_ROWS], neighbours) for i in range(0, len(terms), BLOCK_ROWS)])
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(scores, pa.float64())], names=[*extra, "score"])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType())]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.filter(fold(5) != 0))
    rows = score(docs, model)
    return rows.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
