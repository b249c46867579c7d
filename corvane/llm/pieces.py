"""Pieces of the byte-level pre-tokenizer, cut and looked up for whole batches at once.

A batch of texts is one array of bytes. Runs of letters, numbers, other characters and white space, the
space that belongs to the next run, and contractions become the starts of pieces by array
operations. A piece of up to sixteen bytes is its own key: two 64-bit words and a length, compared exactly, in an open hash
table of arrays; its value is a run of ids in another array. So a piece that was seen before costs
no Python object, and what is remembered has a bound in bytes.

Only characters under U+0530 are cut here, on whose classes all Unicode versions in use agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

#: Below this code point all Unicode versions in use agree on letters, numbers and spaces.
AGREED_BELOW = 0x530
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
SLOT_BITS, MOST_ENTRIES, MOST_LONG = 21, 1_200_000, 50_000
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _classes() -> np.ndarray:
    out = np.zeros(AGREED_BELOW, np.uint8)
    for kind, category in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        test = regex.compile(category)
        out[[c for c in range(AGREED_BELOW) if test.match(chr(c))]] = kind
    return out


_CLASS = _classes()
_ASCII = np.zeros(256, np.uint8)
_ASCII[:128] = _CLASS[:128]


def rows_beyond(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold a character from U+0530 on."""
    high = np.flatnonzero(data >= 0xD4)
    if not len(high):
        return high
    after = np.append(data, np.uint8(0))[high + 1]
    high = high[(data[high] > 0xD4) | (after >= 0xB0)]
    return np.unique(np.searchsorted(offsets, high, side="right") - 1)


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all pieces of consecutive texts, in bytes. No text may hold a character from U+0530 on."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    plain = bool((data < 128).all())
    if plain:
        at, kind = None, _ASCII[data]
    else:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        head = data[at]
        kind = _ASCII[head]
        wide = np.flatnonzero(head >= 0xC0)
        kind[wide] = _CLASS[(head[wide].astype(np.int64) & 0x1F) << 6 | data[at[wide] + 1] & 0x3F]
    first = data if plain else data[at]
    size = len(kind)
    begins = offsets[:-1][offsets[:-1] < n]
    begins = begins if plain else np.searchsorted(at, begins)
    opens = np.zeros(size + 1, bool)  # a text begins
    opens[begins] = opens[size] = True
    start = np.ones(size + 1, bool)
    start[1:size] = kind[1:] != kind[:-1]
    start |= opens
    runs = np.flatnonzero(start)
    # White space before something else: its last character stands alone, or belongs to what follows if it is a space.
    ends = runs[1:][(kind[runs[:-1]] == _SPACE)]
    ends = ends[~opens[ends]]
    start[ends - 1] = True
    start[ends[first[ends - 1] == 32]] = False
    # Contractions: an apostrophe alone among others, that begins a piece, and small letters after it.
    mark = runs[:-1][(first[runs[:-1]] == 39) & (np.diff(runs) == 1)]
    mark = mark[start[mark]]
    mark = mark[~opens[mark + 1]]
    if len(mark):
        padded = np.append(first, np.zeros(3, np.uint8))
        a, b = padded[mark + 1], padded[mark + 2]
        b = np.where(opens[np.minimum(mark + 2, size)], 0, b)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)
        for some, length in ((mark[one], 2), (mark[two], 3)):
            start[some + 1] = False
            start[some + length] = True
    chosen = np.flatnonzero(start[:size])
    return chosen if plain else at[chosen]


class PieceTable:
    """Ids of pieces. ``encode`` gives those of new pieces, end to end, and how many each has; when the table is full it forgets all."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int = SLOT_BITS, most: int = MOST_ENTRIES):
        self.encode, self.bits, self.most = encode, bits, min(most, (1 << bits) * 6 // 10)
        self.clear()

    def clear(self) -> None:
        slots = 1 << self.bits
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.length, self.entry = np.zeros(slots, np.uint8), np.zeros(slots, np.int32)
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.n_entries, self.n_ids = np.zeros(1 << 14, np.uint32), 0, 0
        self.long: dict[bytes, int] = {}

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Entries of new pieces."""
        ids, count = self.encode(pieces)
        k, at = self.n_entries, self.n_ids
        self.first, self.count, self.ids = grown(self.first, k + len(count)), grown(self.count, k + len(count)), grown(self.ids, at + len(ids))
        self.ids[at : at + len(ids)] = ids
        self.first[k : k + len(count)] = at + np.cumsum(count) - count
        self.count[k : k + len(count)] = count
        self.n_entries, self.n_ids = k + len(count), at + len(ids)
        return np.arange(k, k + len(count), dtype=np.int32)

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each piece; unknown ones are encoded."""
        if self.n_entries > self.most or len(self.long) > MOST_LONG:
            self.clear()
        n = ends - starts
        out = np.full(len(n), -1, np.int32)
        raw = np.zeros(len(data) + 17, np.uint8)
        raw[: len(data)] = data
        words = np.ndarray((len(data) + 10,), np.uint64, raw.data, strides=(1,))
        short = np.flatnonzero(n <= 16)
        size = n[short]
        low = words[starts[short]] & _MASK[np.minimum(size, 8)]
        high = np.zeros(len(short), np.uint64)
        more = np.flatnonzero(size > 8)
        high[more] = words[starts[short[more]] + 8] & _MASK[size[more] - 8]
        size = size.astype(np.uint8)
        h = (low ^ (high * _MIX[1]) ^ (size.astype(np.uint64) * _MIX[2])) * _MIX[0]
        h = (h ^ (h >> np.uint64(29))) * _MIX[3]
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        pending, last = np.arange(len(short)), (1 << self.bits) - 1
        missing = []
        while len(pending):
            s = slot[pending]
            held = self.length[s]
            same = (held == size[pending]) & (self.low[s] == low[pending]) & (self.high[s] == high[pending])
            out[short[pending[same]]] = self.entry[s[same]]
            empty = held == 0
            missing.append(pending[empty])
            pending = pending[~same & ~empty]
            slot[pending] = (slot[pending] + 1) & last
        gone = np.concatenate(missing) if missing else pending
        if len(gone):
            order = np.lexsort((size[gone], high[gone], low[gone]))
            gone = gone[order]
            new = np.ones(len(gone), bool)
            new[1:] = (low[gone][1:] != low[gone][:-1]) | (high[gone][1:] != high[gone][:-1]) | (size[gone][1:] != size[gone][:-1])
            heads = gone[new]
            whole = data.tobytes()
            added = self._add([whole[x:y] for x, y in zip(starts[short[heads]].tolist(), ends[short[heads]].tolist())])
            out[short[gone]] = added[np.cumsum(new) - 1]
            at, some = slot[heads], np.arange(len(heads))
            while len(some):  # of those that want one empty slot the last gets it; the others try the next
                free = self.length[at[some]] == 0
                self.entry[at[some[free]]] = added[some[free]]
                won = free.copy()
                won[free] = self.entry[at[some[free]]] == added[some[free]]
                s, h = at[some[won]], heads[some[won]]
                self.low[s], self.high[s], self.length[s] = low[h], high[h], size[h]
                some = some[~won]
                at[some] = (at[some] + 1) & last
        wide = np.flatnonzero(n > 16)
        if len(wide):
            whole = data.tobytes()
            pieces = [whole[a:b] for a, b in zip(starts[wide].tolist(), ends[wide].tolist())]
            fresh = list(dict.fromkeys(x for x in pieces if x not in self.long))
            once = dict(zip(fresh, self._add(fresh).tolist())) if fresh else {}
            out[wide] = [e if (e := self.long.get(x)) is not None else once[x] for x in pieces]
            self.long.update((x, e) for x, e in once.items() if len(x) <= 64)
        return out

    def encoded(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts end to end, and where each text's begin; ``starts`` are those of the pieces if they are known."""
        starts = cut(data, offsets) if starts is None else starts
        first = np.searchsorted(starts, offsets)
        entry = self.entries(data, starts, np.append(starts[1:], len(data)))
        return spread(self.ids, self.first[entry], self.count[entry], first)


def grown(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` with room for ``size`` of them at least."""
    return values if size <= len(values) else np.resize(values, max(size, 2 * len(values)))


def spread(values: np.ndarray, first: np.ndarray, count: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` end to end, and where each row of runs begins."""
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], count)
    return values[at], ends[rows]


def rows_holding(data: np.ndarray, offsets: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Rows in which any of ``words`` occurs."""
    found, raw = [], data.tobytes()
    for w in words:
        at = raw.find(w)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(w) <= offsets[row + 1]:
                found.append(row)
            at = raw.find(w, at + 1)
    return np.unique(np.array(found, np.int64))


def encoded_rows(encoded: Callable, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray, one: Callable[[str], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, and where each row's begin; ``one`` gives those of the rows ``apart``, ``encoded`` the others'."""
    if not len(apart):
        return encoded(data, offsets)
    parts, sizes, at = [], [], 0
    for row in [*apart.tolist(), len(offsets) - 1]:
        if row > at:
            some = offsets[at : row + 1]
            ids, first = encoded(data[some[0] : some[-1]], some - some[0])
            parts.append(ids)
            sizes.append(np.diff(first))
        if row < len(offsets) - 1:
            ids = np.frombuffer(one(data[offsets[row] : offsets[row + 1]].tobytes().decode()), "<u4")
            parts.append(ids)
            sizes.append(np.array([len(ids)]))
        at = row + 1
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
