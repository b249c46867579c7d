"""Operator 1: byte-level BPE by forced-boundary splitting.

Two bytes that stand side by side in no token of the vocabulary can never be
merged into one, whatever stands around them: between them every encoding has a
cut. Each piece of the pre-tokenizer is cut at all such places, the fragments
are encoded independently (and remembered, as most of them return), and their ids
are put together again. Merging never looks across such a cut, so the ids are
exactly those of merging the whole piece. All of it works on the bytes of a whole batch of texts:
new fragments are merged side by side, one merge in each row a round.

Cases: a null text is encoded as an empty one (no ids); strings of added tokens
become that token's id; a row is encoded on its own, so ties and repeated rows
give equal results; an empty table gives an empty result; columns other than the
id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.pieces import PieceTable, cut, encoded_rows, rows_beyond, rows_holding, spread
from corvane.llm.shared import bounded_pieces, flat_bytes, table, tidy

SHORT, NEVER = 16, np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    itself if it is visible in Latin-1, else the next one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in seen}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class MergeRanks:
    """The rank of each pair of ids that is merged, ``NEVER`` for the others, for whole arrays of pairs."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        at, some = self._slot(keys), np.arange(len(keys))
        while len(some):  # of those that want one empty slot the last gets it; the others try the next
            free = self.keys[at[some]] < 0
            self.keys[at[some[free]]] = keys[some[free]]
            won = self.keys[at[some]] == keys[some]
            self.ranks[at[some[won]]] = some[won]
            some = some[~won]
            at[some] = (at[some] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at, out = self._slot(keys), np.full(len(keys), NEVER, np.int32)
        some = np.flatnonzero((a >= 0) & (b >= 0))
        while len(some):
            held = self.keys[at[some]]
            same = held == keys[some]
            out[some[same]] = self.ranks[at[some[same]]]
            some = some[~same & (held >= 0)]
            at[some] = (at[some] + 1) & ((1 << self.bits) - 1)
        return out


class ForcedBoundaryBPE:
    """Encoder and decoder for one tokenizer file of the byte-level kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        names = byte_characters()
        byte_of = {c: b for b, c in enumerate(names)}
        vocab = model["vocab"]
        self.token_bytes: dict[int, bytes] = {}
        self.forced = np.ones(1 << 16, bool)
        for token, i in vocab.items():
            raw = bytes(byte_of[c] for c in token)
            self.token_bytes[i] = raw
            for a, b in zip(raw, raw[1:]):
                self.forced[a << 8 | b] = False
        self.byte_id = np.array([vocab[c] for c in names], np.int32)
        merges = [tuple(vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair)) for pair in model["merges"]]
        results = [vocab[a + b] for a, b in (pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"])]
        self.merge = {pair: (rank, new) for rank, (pair, new) in enumerate(zip(merges, results))}
        self.ranks, self.results = MergeRanks(merges), np.array(results, np.int32)
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        for content, i in self.added.items():
            self.token_bytes[i] = content.encode()
        self.added_at = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.fragments = PieceTable(self._encode_fragments)
        every = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes, default=-1) + 2)]  # the last stands for all unknown ids
        self.bytes_of = np.frombuffer(b"".join(every), np.uint8)
        self.bytes_count = np.array(list(map(len, every)), np.int64)
        self.bytes_first = np.cumsum(self.bytes_count) - self.bytes_count
        self._library = None
        self._path = path

    def forced_starts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``starts`` of pieces, and each byte that never follows its predecessor inside a token."""
        begins = np.zeros(len(data), bool)
        if len(data):
            begins[1:] = self.forced[data[:-1].astype(np.int32) << 8 | data[1:]]
            begins[starts] = True
        return np.flatnonzero(begins)

    def cuts(self, raw: bytes) -> list[int]:
        """Where ``raw`` must be cut."""
        return self.forced_starts(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64)).tolist()[1:]

    def _encode_fragments(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments, end to end, and how many each has: short ones all together, each round one merge in every row."""
        sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
        out: list[np.ndarray | None] = [None] * len(fragments)
        count = np.zeros(len(fragments), np.int64)
        for width in (SHORT // 2, SHORT):
            some = np.flatnonzero((sizes <= width) & (count == 0))
            if len(some):
                rows = np.frombuffer(b"".join([fragments[i].ljust(width, b"\0") for i in some.tolist()]), np.uint8).reshape(-1, width)
                ids = self._merged(rows, sizes[some])
                count[some] = (ids >= 0).sum(1)
                for i, row, n in zip(some.tolist(), ids, count[some].tolist()):
                    out[i] = row[:n]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = np.array(self._merged_long(self.byte_id[np.frombuffer(fragments[i], np.uint8)].tolist()), np.int32)
            count[i] = len(out[i])
        return (np.concatenate(out) if out else np.zeros(0, np.int32)).astype(np.uint32), count

    def _merged(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of fragments of up to ``SHORT`` bytes, one a row, padded with -1: in each the leftmost pair of the lowest rank is
        merged until no pair has a rank."""
        n, width = rows.shape
        column = np.arange(width)
        ids = np.where(column < sizes[:, None], self.byte_id[rows], -1)
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        live = np.arange(n)
        while True:
            at = rank[live].argmin(1)
            best = rank[live, at]
            live, at, best = live[best < NEVER], at[best < NEVER], best[best < NEVER]
            if not len(live):
                return ids
            moved = np.minimum(column + (column > at[:, None]), width - 1)
            mine = np.take_along_axis(ids[live], moved, 1)
            mine[:, -1] = -1
            mine[np.arange(len(live)), at] = self.results[best]
            ids[live] = mine
            ranks = np.take_along_axis(rank[live], np.minimum(moved[:, :-1], width - 2), 1)
            ranks[:, -1] = NEVER
            here = np.arange(len(live))
            after = np.where(at + 1 < width, mine[here, np.minimum(at + 1, width - 1)], -1)
            ok = at < width - 1
            ranks[here[ok], at[ok]] = self.ranks(mine[here[ok], at[ok]], after[ok])
            ok = at > 0
            ranks[here[ok], at[ok] - 1] = self.ranks(mine[here[ok], at[ok] - 1], mine[here[ok], at[ok]])
            rank[live] = ranks

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same for a long fragment: a heap of pairs over a linked list."""
        n, get = len(ids), self.merge.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if m := get((new, ids[right[j]])):
                    heapq.heappush(heap, (m[0], i, new, ids[right[j]], m[1]))
            if left[i] >= 0 and (m := get((ids[left[i]], new))):
                heapq.heappush(heap, (m[0], left[i], ids[left[i]], new, m[1]))
        return [x for x in ids if x >= 0]

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts end to end, and where each text's begin: of texts of agreed characters without added tokens."""
        return self.fragments.encoded(data, offsets, self.forced_starts(data, cut(data, offsets)))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for any texts."""
        apart = np.union1d(rows_beyond(data, offsets), rows_holding(data, offsets, [x.encode() for x in self.added]))
        return encoded_rows(self.encoded, data, offsets, apart, self._apart)

    def _plain(self, text: str) -> bytes:
        """A text without added tokens. With characters on which Unicode versions may differ, the tokenizers library cuts it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        whole = np.array([0, len(raw)])
        if not len(rows_beyond(raw, whole)):
            return self.encoded(raw, whole)[0].tobytes()
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        sizes = [len(text[a:b].encode()) for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.fragments.encoded(raw, whole, self.forced_starts(raw, np.cumsum([0, *sizes[:-1]])))[0].tobytes()

    def _apart(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.added_at.finditer(text) if self.added_at else ():
            out += [self._plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.rows(raw, np.array([0, len(raw)]))[0].tolist()

    def decoded(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Bytes of rows of ids that begin at ``first``. Ids outside the vocabulary have none."""
        known = np.minimum(ids.astype(np.int64), len(self.bytes_count) - 1)
        raw, at = spread(self.bytes_of, self.bytes_first[known], self.bytes_count[known], first)
        whole, at = raw.tobytes(), at.tolist()
        return [whole[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        some = np.array(list(ids), np.int64)
        some[some < 0] = len(self.bytes_count) - 1
        return self.decoded(some, np.array([0, len(some)]))[0].decode("utf-8", "replace")


_coders: dict[str, ForcedBoundaryBPE] = {}


def coder(path: str) -> ForcedBoundaryBPE:
    """One coder per worker and file: its tables and what it remembers are used by all tasks."""
    if path not in _coders:
        _coders[path] = ForcedBoundaryBPE(path)
    return _coders[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each row's text: (id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            ids, first = bpe.rows(*flat_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.view(np.int32)))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids: (id, text). Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids and their decoding as digests, in one pass over the texts, so that no ids leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for some in (x for batch in batches for x in bounded_pieces(batch, "text")):
            ids, first = bpe.rows(*flat_bytes(some.column(1)))
            raw, at = ids.astype("<u4", copy=False).tobytes(), (4 * first).tolist()
            a = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at, at[1:])]
            b = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in bpe.decoded(ids, first)]
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_tokenizer())
