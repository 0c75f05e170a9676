"""Interning of n-grams in flat arrays: words of many texts at once, xxhash64 of byte spans, an open-addressed table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from skylattice.llm.arrays import ranges, starts

#: The multipliers of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes of texts taken at once, and occurrences that share a table.
BLOCK, OCCURRENCES = 1 << 20, 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words: digits, letters and every byte beyond ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _IN_WORD[_a : _b + 1] = True
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class Grams:
    """Occurrences of n-grams in a block of texts: spans of a buffer in which one space follows every word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, longest: int):
        """``data``: UTF-8 of the texts side by side; text k lies between ``bounds`` k and k + 1."""
        word = _IN_WORD[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edge = bounds[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]  # a word does not go on in the next text
        begins[edge] = word[edge]
        ends[edge - 1] = word[edge - 1]
        at, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        size = end - at
        to = starts(size + 1)
        self.buffer = np.full(int(to[-1]) + 8, 0x20, dtype=np.uint8)
        self.buffer[ranges(to[:-1], size)] = _LOWER[data[word]]
        owner = np.searchsorted(bounds, at, side="right") - 1
        self.words = np.bincount(owner, minlength=len(bounds) - 1).astype(np.int64)
        parts = []
        for n in range(1, longest + 1):
            last = np.arange(n - 1, len(at))
            first = last - (n - 1)
            whole = owner[first] == owner[last]
            first, last = first[whole], last[whole]
            parts.append((to[first], to[last] + size[last] - to[first], owner[first]))
        self.at, self.size, self.owner = (np.concatenate(p) for p in zip(*parts))
        self.lanes = np.ndarray(len(self.buffer) - 7, "<u8", self.buffer, 0, (1,))

    def text(self, k: int) -> memoryview:
        return self.buffer[self.at[k] : self.at[k] + self.size[k]].data

    def hashes(self, take: slice) -> np.ndarray:
        """xxhash64 (seed 0) of these occurrences."""
        at, size = self.at[take], self.size[take].astype(np.uint64)
        acc = _P5 + size
        done = np.zeros(len(at), dtype=np.int64)
        for _ in range(3):
            k = np.flatnonzero(size - done.astype(np.uint64) >= 8)
            if not len(k):
                break
            lane = self.lanes[at[k] + done[k]]
            acc[k] = _turn(acc[k] ^ (_turn(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            done[k] += 8
        rest = self.size[take] - done
        k = np.flatnonzero(rest >= 4)
        acc[k] = _turn(acc[k] ^ ((self.lanes[at[k] + done[k]] & _HEAD[4]) * _P1), 23) * _P2 + _P3
        done[k] += 4
        rest[k] -= 4
        for _ in range(3):
            k = np.flatnonzero(rest > 0)
            acc[k] = _turn(acc[k] ^ (self.buffer[at[k] + done[k]].astype(np.uint64) * _P5), 11) * _P1
            done[k] += 1
            rest[k] -= 1
        acc = (acc ^ (acc >> np.uint64(33))) * _P2
        acc = (acc ^ (acc >> np.uint64(29))) * _P3
        acc ^= acc >> np.uint64(32)
        base = take.indices(len(self.at))[0]
        for k in np.flatnonzero(size >= 32).tolist():
            acc[k] = xxhash.xxh64_intdigest(self.text(base + k))
        return acc


class Table:
    """Open-addressed slots of the n-grams among some occurrences: bucket and count of each, and whose slot it is."""

    def __init__(self, grams: Grams, take: slice, buckets: int):
        at, size, hashes = grams.at[take], grams.size[take], grams.hashes(take)
        room = 1 << max(4, (2 * len(at)).bit_length())
        head = grams.lanes[at] & _HEAD[np.minimum(size, 8)]
        holder = np.full(room, -1, dtype=np.int64)
        self.slot = np.zeros(len(at), dtype=np.int64)
        probe, waiting = (hashes & np.uint64(room - 1)).astype(np.int64), np.arange(len(at))
        while len(waiting):
            place = probe[waiting]
            free = holder[place] < 0
            holder[place[free]] = waiting[free]  # of several that come for a free slot the last one has it
            other = holder[place]
            same = (hashes[other] == hashes[waiting]) & (size[other] == size[waiting]) & (head[other] == head[waiting])
            check = np.flatnonzero(same & (size[waiting] > 8) & (other != waiting))
            same[check] = self._equal(grams.buffer, at[other[check]], at[waiting[check]], size[waiting[check]])
            self.slot[waiting[same]] = place[same]
            waiting = waiting[~same]
            probe[waiting] = (probe[waiting] + 1) & (room - 1)
        self.count = np.bincount(self.slot, minlength=room)
        self.bucket = np.zeros(room, dtype=np.int64)
        taken = np.flatnonzero(holder >= 0)
        base = take.indices(len(grams.at))[0]
        self.bucket[taken] = [zlib.crc32(grams.text(base + k)) % buckets for k in holder[taken].tolist()]

    @staticmethod
    def _equal(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.zeros(0, dtype=bool)
        differ = buffer[ranges(a, size)] != buffer[ranges(b, size)]
        return np.add.reduceat(differ, starts(size)[:-1], dtype=np.int64) == 0


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of an Arrow column (null: empty) in blocks of about ``BLOCK`` bytes or one text: number, bytes and bounds."""
    if pa.types.is_string(texts.type):
        width = np.int32
    else:
        texts, width = texts.cast(pa.large_string()), np.int64
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
        yield last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def tables(grams: Grams, buckets: int) -> Iterator[tuple[slice, Table]]:
    """Tables of all occurrences, ``OCCURRENCES`` at a time."""
    for at in range(0, len(grams.at), OCCURRENCES):
        take = slice(at, min(at + OCCURRENCES, len(grams.at)))
        yield take, Table(grams, take, buckets)
