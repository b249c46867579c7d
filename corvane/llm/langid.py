"""Operator 3: language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of byte n-grams,
n from 1 to 3, that both hold (in lower case), divided by the geometric mean of the numbers each
holds. A bounded number of labelled texts serve as Nystroem landmarks: a text is
its kernel values against them, whitened by the landmarks' own kernel matrix. On
these features one ridge regression per language separates it from the rest. A
text is scored by two matrix products: presence x landmarks, values x weights.

Only grams of landmarks can count for a kernel value. Those that many landmarks hold are
columns of a dense matrix, in which a text is a 0/1 row; the rarer ones are lists of their landmarks. So no
gram is left out, however many languages there are. The number of all of a text's distinct grams is counted beside it.

Fitting takes, in each language that a row names, the labelled texts with the smallest hashes: ``SAMPLE_ROWS``
shared out evenly, but no more than ``SAMPLE_PER_LANGUAGE`` and no fewer than ``LEAST_PER_LANGUAGE`` in any (documented bounds on
rows; their texts are whole, and become grams where they are). The landmarks are the first of them. Scoring covers whole
texts of all rows. A session without labelled rows learns nothing: every text is
``und`` with score 0.

Cases: a null text, or one without a letter, is ``und`` with score 0; ties between
languages go to the first in alphabetical order; repeated rows get equal results, and one of them is learned from; a
null id belongs to no fold: it is neither learned from nor held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import bounded_pieces, flat_bytes, table, tidy

SAMPLE_ROWS, SAMPLE_PER_LANGUAGE, LEAST_PER_LANGUAGE = 6_000, 300, 8
LANDMARKS, LANDMARKS_PER_LANGUAGE, LEAST_LANDMARKS = 1_000, 24, 2
RIDGE, DENSE_SHARE = 1e-2, 16
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 128


def _codes(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes of all 1-, 2- and 3-grams of a byte array, in disjoint ranges."""
    b = data.astype(np.int32)
    return b, 256 + (b[:-1] << 8 | b[1:]), 65_792 + (b[:-2] << 16 | b[1:-1] << 8 | b[2:])


def grams(text: bytes) -> np.ndarray:
    return np.unique(np.concatenate(_codes(np.frombuffer(text, np.uint8)))) if text else np.zeros(0, np.int32)


@dataclass
class KernelModel:
    languages: list[str]
    codes: np.ndarray  # the landmarks' grams, ascending within the dense ones, then within the others
    dense: np.ndarray  # the first grams x landmarks: presence
    first: np.ndarray  # the other grams' lists of landmarks
    lists: np.ndarray
    roots: np.ndarray  # of each landmark's number of grams
    weights: np.ndarray  # landmarks x languages

    _slot: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        """Place of each gram's code, -1 for a gram of no landmark."""
        if self._slot is None:
            self._slot = np.full(65_792 + (1 << 24), -1, np.int16 if len(self.codes) < 32_000 else np.int32)
            self._slot[self.codes] = np.arange(len(self.codes))
        return self._slot

    def kernels(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Kernel values of consecutive texts against all landmarks."""
        slot, rows, n_dense = self.slots(), len(offsets) - 1, len(self.dense)
        presence = np.zeros((rows, n_dense), np.float32)
        rare = np.zeros((rows, len(self.roots)), np.float32)
        sizes = np.ones(rows, np.float32)
        for i in range(rows):
            a, b = offsets[i], offsets[i + 1]
            if b <= a:
                continue
            held = 0
            for codes in _codes(data[a:b]):
                codes = np.sort(codes)
                codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes
                held += len(codes)
                at = slot[codes].astype(np.int64)
                presence[i, at[(at >= 0) & (at < n_dense)]] = 1
                at = at[at >= n_dense] - n_dense
                if len(at):
                    n = self.first[at + 1] - self.first[at]
                    place = np.arange(n.sum()) + np.repeat(self.first[at] - np.cumsum(n) + n, n)
                    rare[i] += np.bincount(self.lists[place], minlength=len(self.roots))
            sizes[i] = held
        return (presence @ self.dense + rare) / self.roots / np.sqrt(sizes)[:, None]

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.kernels(data, offsets) @ self.weights


def fit(texts: list[str], languages: list[str], landmarks: int | None = None, ridge: float = RIDGE) -> KernelModel | None:
    """A model from labelled texts."""
    raw = [t.lower().encode() for t in texts]
    return fit_grams([grams(x) for x in raw], languages, landmarks, ridge)


def fit_grams(held: list[np.ndarray], languages: list[str], landmarks: int | None = None, ridge: float = RIDGE) -> KernelModel | None:
    """A model from the distinct grams of labelled texts; the first ``landmarks`` of each language are its landmarks."""
    known = sorted(set(languages))
    if not known:
        return None
    landmarks = landmarks or max(LEAST_LANDMARKS, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(known)))
    places: dict[str, list[int]] = {x: [] for x in known}
    for k, x in enumerate(languages):
        places[x].append(k)
    chosen = [i for x in known for i in places[x][:landmarks]]
    every = np.concatenate([held[i] for i in chosen])
    owner = np.repeat(np.arange(len(chosen)), [len(held[i]) for i in chosen])
    codes, which, counts = np.unique(every, return_inverse=True, return_counts=True)
    common = counts * DENSE_SHARE > len(chosen)
    rank = np.empty(len(codes), np.int64)
    n_dense = int(common.sum())
    rank[common], rank[~common] = np.arange(n_dense), np.arange(n_dense, len(codes))
    ordered = np.empty(len(codes), np.int32)
    ordered[rank] = codes
    which = rank[which.ravel()]
    dense = np.zeros((n_dense, len(chosen)), np.float32)
    dense[which[which < n_dense], owner[which < n_dense]] = 1
    by = np.argsort(which, kind="stable")
    by = by[which[by] >= n_dense]
    first = np.searchsorted(which[by], np.arange(n_dense, len(codes) + 1))
    roots = np.sqrt(np.maximum(1, np.array([len(held[i]) for i in chosen]))).astype(np.float32)
    model = KernelModel(known, ordered, dense, first, owner[by], roots, np.zeros((len(chosen), len(known)), np.float32))
    features = np.stack([_against(model, g) for g in held]).astype(np.float64)
    inner = features[chosen]
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = features @ whiten
    names = np.array(languages)
    target = np.stack([np.where(names == x, 1.0, -1.0) for x in known], 1)
    weight = np.sqrt(1 / np.array([len(places[x]) for x in languages]))[:, None]
    a, b = features * weight, target * weight
    solved = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b)
    model.weights = (whiten @ solved).astype(np.float32)
    return model


def _against(model: KernelModel, held: np.ndarray) -> np.ndarray:
    """Kernel values of one text's grams."""
    at, n_dense = model.slots()[held].astype(np.int64), len(model.dense)
    out = model.dense[at[(at >= 0) & (at < n_dense)]].sum(0)
    at = at[at >= n_dense] - n_dense
    n = model.first[at + 1] - model.first[at]
    place = np.arange(n.sum()) + np.repeat(model.first[at] - np.cumsum(n) + n, n)
    return (out + np.bincount(model.lists[place], minlength=len(model.roots))) / model.roots / np.sqrt(max(1, len(held)))


def labelled_sample(docs: DataFrame, per_language: int | None = None) -> list[tuple[str, np.ndarray]]:
    """(language, grams) of the labelled texts with the smallest hashes in each language, in the order of hashes. Hashes are ranked
    first; texts are then read for the chosen ones and stay where they are."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Equal rows have equal hashes and count once.
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(3)).alias("_k"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return []
    per_language = per_language or max(LEAST_PER_LANGUAGE, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(sizes)))
    # Of a large language only the lowest hashes are ranked, four times as many as are wanted, so that no task gets all its rows.
    shares = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, 4.0 * per_language / n)))])
    part = (F.shiftrightunsigned("_k", 32) / float(1 << 32)) <= F.element_at(shares, F.col("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_k"))
    ranked = rows.filter(part).select("lang", "_k").distinct().withColumn("_r", place).filter(F.col("_r") <= per_language).drop("_r")
    found = rows.join(F.broadcast(ranked), ["lang", "_k"]).select("lang", "_k", "text")  # bounded by rows of a sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (x for batch in batches for x in bounded_pieces(batch, "text")):
            held = pa.array([grams(x.lower().encode()) for x in some.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), held], names=["lang", "k", "grams"])

    once = found.mapInArrow(run, "lang string, k long, grams array<int>").groupBy("lang", "k").agg(F.first("grams").alias("grams"))
    got = once.toArrow()
    order = np.argsort(np.asarray(got.column("k")), kind="stable").tolist()
    langs, held = got.column("lang").to_pylist(), got.column("grams").combine_chunks()
    ends, flat = np.asarray(held.offsets), np.asarray(held.values)
    return [(langs[i], flat[ends[i] : ends[i + 1]]) for i in order]


def train(docs: DataFrame, per_language: int | None = None) -> KernelModel | None:
    rows = labelled_sample(docs, per_language)
    return fit_grams([g for _, g in rows], [x for x, _ in rows])


def identify(docs: DataFrame, model: KernelModel | None, extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*extra, lang_pred, score) of every whole text. The score is the margin of the best
    language brought from -1..1 to 0..1. The model is bounded, and broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("text", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for some in (x for batch in batches for x in bounded_pieces(batch, "text", BLOCK_BYTES)):
            strings = some.column(0).to_pylist()
            data, offsets = flat_bytes(pa.array([x and x.lower() for x in strings], pa.large_string()))
            names, scores = [UNKNOWN] * len(strings), np.zeros(len(strings))
            if model is not None:
                known = [bool(x) and LETTER.search(x) is not None for x in strings]
                for lo in range(0, len(strings), BLOCK_ROWS):
                    hi = min(lo + BLOCK_ROWS, len(strings))
                    margins = model.margins(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    best = margins.argmax(1)
                    for k in range(hi - lo):
                        if known[lo + k]:
                            names[lo + k] = model.languages[best[k]]
                            scores[lo + k] = min(1.0, max(0.0, (1 + float(margins[k, best[k]])) / 2))
            yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*extra, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def fold(modulus: int):
    """Unsigned CRC-32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(fold(4) != 2))
    rows = identify(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return rows.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
