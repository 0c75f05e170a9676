"""Byte-fallback merge encoding with seeded dropout of merges, and lossless decoding.

A word (its leading spaces and what follows) starts as single characters. Candidate merges of neighbours wait in an
agenda, best score first, leftmost first among equals; a candidate whose keyed hash (of the key, its first character,
its middle and its end) falls below the dropout rate is skipped for good, and others are merged, which brings new
candidates. Without dropout the result equals the library's own encoding. Characters that end up outside of the
vocabulary become byte pieces.

Words of up to ``SHORT`` characters advance together as rows of a matrix, one merge of each row a step; longer words
run a heap. Both give the same pieces. Every occurrence of a word has its own key, a hash of the seed, the document and
the word's place. Outcomes are remembered with the candidates on their way: that without skips, and those in which just
some of its candidates are skipped. An occurrence takes the one whose candidates its own key skips, and lets be, in the
same way; where its key skips others too, it is merged anew.

Defined results: null and empty texts have no pieces; repeated rows get the same pieces; the lower-one-eighth-block
character that stands for a space in the vocabulary is encoded by its bytes, so that it is decoded as itself; a null id
counts as 0 in a key; candidates of one rank go from left to right; a text of any length is encoded as a whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.arrays import ranges
from skylattice.llm.storage import mixed, small_batches
from skylattice.llm.worker import held

SPACE = "▁"
#: Stands for a literal SPACE inside of a word; no text has it, since a lone surrogate is not a character.
LITERAL = "\ud800"
SHORT = 24
#: A word: spaces (written as SPACE) and what follows them up to the next one. No piece crosses a word's start.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NEVER = np.iinfo(np.int32).max
_ALL = (1 << 64) - 1


class Pairs:
    """Look-up of many pairs of pieces at once: hash tables, each of which takes the keys that the one before had no free
    place for."""

    SHIFT, FREE = np.uint64(46), np.uint64(1 << 63)

    def __init__(self, merges: dict[int, int]):
        keys = np.array(list(merges), dtype=np.uint64)
        values = np.array(list(merges.values()), dtype=np.int32)
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        while len(keys) or not self.tables:
            factor = np.uint64(_mixed_one(len(self.tables) + 1) | 1)
            place = (keys * factor) >> self.SHIFT
            held, found = np.full(1 << (64 - int(self.SHIFT)), self.FREE), np.full(1 << (64 - int(self.SHIFT)), -1, dtype=np.int32)
            _, first = np.unique(place, return_index=True)
            held[place[first]], found[place[first]] = keys[first], values[first]
            self.tables.append((factor, held, found))
            keys, values = np.delete(keys, first), np.delete(values, first)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The merged piece of each key, or -1."""
        out, at = np.full(len(keys), -1, dtype=np.int32), None
        for factor, held, found in self.tables:
            place = (keys * factor) >> self.SHIFT
            there = held[place]
            hit = there == keys
            if at is None:
                out, at = np.where(hit, found[place], np.int32(-1)), np.flatnonzero(~hit & (there != self.FREE))
            else:
                out[at[hit]] = found[place[hit]]
                at = at[~hit & (there != self.FREE)]
            if not len(at):
                break
            keys = keys[~hit & (there != self.FREE)]
        return out


class Vocabulary:
    """Pieces, their ranks, and the merges of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        plain = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[piece] = i
        order = sorted(plain.values(), key=lambda i: -model.get_score(i))
        self.rank = np.full(n, _NEVER, dtype=np.int32)
        self.rank[order] = np.arange(len(order))
        self.chars = {p: i for p, i in plain.items() if len(p) == 1}
        self.size = n
        self.of_point = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.chars.items():
            self.of_point[ord(c)] = i
        merges = {}
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                a, b = plain.get(piece[:k]), plain.get(piece[k:])
                if a is not None and b is not None:
                    merges[a * n + b] = i
        self.merges = merges
        self.pairs = Pairs(merges)
        spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in spelled], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the merged piece, or -1. Negative ids (characters outside of the vocabulary) never merge."""
        found = self.pairs.find((a.astype(np.int64) * self.size + b).astype(np.uint64))
        found[(a < 0) | (b < 0)] = -1
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _place(first: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    place = (first.astype(np.uint64) << np.uint64(42)) | (middle.astype(np.uint64) << np.uint64(21)) | end.astype(np.uint64)
    return mixed(place + np.uint64(0x9E3779B97F4A7C15))


def _place_table() -> np.ndarray:
    """The hashed places of words of up to SHORT characters, by (first * SIDE + middle) * SIDE + end."""
    k = np.arange(SIDE**3)
    return _place(k // SIDE**2, k // SIDE % SIDE, k % SIDE)


def _falls(key: np.ndarray, place: np.ndarray, rate: float) -> np.ndarray:
    return (mixed(key ^ place) >> np.uint64(11)) < np.uint64(int(rate * (1 << 53)))


def _skip_one(key: int, first: int, middle: int, end: int, rate: float) -> bool:
    return _mixed_one(key ^ _mixed_one(first << 42 | middle << 21 | end, 0x9E3779B97F4A7C15)) >> 11 < int(rate * (1 << 53))


SIDE = SHORT + 1
PLACES = _place_table()


def _mixed_one(x: int, more: int = 0) -> int:
    """``mixed`` of one integer."""
    x = x + more & _ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def agenda(word: list[int], key: int, rate: float, v: Vocabulary) -> list[tuple[int, int]]:
    """(piece or -1, first character) of a word given as character ids; a heap of candidate merges."""
    n = len(word)
    ids, end, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []
    def offer(i: int, j: int) -> None:
        """The pieces that start at i and j, side by side."""
        if ids[i] >= 0 and ids[j] >= 0:
            merged = v.merges.get(ids[i] * v.size + ids[j])
            if merged is not None and not _skip_one(key, i, j, end[j], rate):
                heapq.heappush(heap, (int(v.rank[merged]), i, j, end[j], merged))

    alive = [True] * n
    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, stop, merged = heapq.heappop(heap)
        if not (alive[i] and alive[j] and end[i] == j and end[j] == stop):
            continue
        ids[i], end[i], alive[j] = merged, stop, False
        if stop < n:
            before[stop] = i
            offer(i, stop)
        if before[i] >= 0:
            offer(before[i], i)
    return [(ids[i], i) for i in range(n) if alive[i]]


def together(
    words: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float, v: Vocabulary, offers: list | None = None, skipped: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The same for many words at once (rows padded with -1): piece ids and which places still begin a piece. ``offers``
    takes the rows and places (indices of PLACES) of the candidates that came up. ``skipped`` lists for each row the places
    that are skipped (padded with -1), in the place of its key."""
    n, width = words.shape
    place = np.arange(width)
    alive = place[None, :] < lengths[:, None]
    inner = np.flatnonzero(place[None, :] + 1 < lengths[:, None])
    # from here on a place is row * width + place, so that all are flat
    ids, live = words.copy().reshape(-1), np.arange(n)
    base, over = live * width, live * width + lengths
    after = np.arange(1, n * width + 1)  # where the piece ends, and the next one begins
    before = np.arange(-1, n * width - 1)
    rank, merged = np.full(n * width, _NEVER, dtype=np.int32), np.full(n * width, -1, dtype=np.int32)

    def offer(row: np.ndarray, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> None:
        """The pieces [i, j) and [j, end) of rows, side by side."""
        m = v.pair(ids[i], ids[j])
        rank[i] = _NEVER
        up = np.flatnonzero(m >= 0)
        row, i, m, first = row[up], i[up], m[up], base[row[up]]
        at = ((i - first) * SIDE + j[up] - first) * SIDE + end[up] - first
        if offers is not None:
            offers.append((row, at))
        if skipped is not None:
            left = np.flatnonzero(~(skipped[row] == at[:, None]).any(axis=1))
        elif rate > 0:
            left = np.flatnonzero(~_falls(keys[row], PLACES[at], rate))
        else:
            left = slice(None)
        i, m = i[left], m[left]
        merged[i], rank[i] = m, v.rank[m]

    offer(inner // width, inner, inner + 1, inner + 2)
    ranks, gone = rank.reshape(n, width), alive.reshape(-1)
    while len(live):
        i = ranks[live].argmin(axis=1) + base[live]
        some = rank[i] < _NEVER
        live, i = live[some], i[some]
        if not len(live):
            break
        j = after[i]
        ids[i], end = merged[i], after[j]
        after[i] = end
        gone[j] = False
        rank[j] = rank[i] = _NEVER
        some = np.flatnonzero(end < over[live])
        row, at, next_ = live[some], i[some], end[some]
        before[next_] = at
        offer(row, at, next_, after[next_])
        some = np.flatnonzero(i > base[live])
        row, at = live[some], i[some]
        offer(row, before[at], at, after[at])
    return ids.reshape(n, width), alive


def _gathered(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``flat`` side by side, and their new starts; those that begin below zero stay as they are."""
    n = np.where(start >= 0, n, 0)
    return flat[ranges(start, n)], np.where(start >= 0, np.cumsum(n) - n, start)


class Encoder:
    """Encodes words and remembers their outcome without skips, and up to ``limit`` outcomes with some. Beyond ``limit``
    words the later half is forgotten, since frequent words are met, and kept, first."""

    #: Candidates of a word, and numbers of words, that a code of both can hold.
    BITS, WORDS = 40, 1 << 23

    def __init__(self, path: str, rate: float, seed: int, limit: int = 300_000):
        self.v, self.rate, self.seed, self.limit = vocabulary(path), rate, seed, limit
        self._no_patterns()
        self.words: dict[str, int] = {}
        self.names: list[str] = []
        self.points, self.letters = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)  # of all words, and where each begins
        self.start = np.full(1 << 16, -1, dtype=np.int64)  # by word; as the next three
        self.length = np.zeros(1 << 16, dtype=np.int64)
        self.first = np.zeros(1 << 16, dtype=np.int64)  # of its candidates in ``places``
        self.offered = np.zeros(1 << 16, dtype=np.int64)
        self.flat = np.zeros(1 << 20, dtype=np.int32)
        self.places = np.zeros(0, dtype=np.uint16)
        self.used = 0

    def _no_patterns(self) -> None:
        """Outcomes with skips: by a word's number and which of its candidates are skipped. ``more_places`` are the further
        candidates on the way, none of which is skipped."""
        self.patterns: dict[int, int] = {}
        self.more = np.zeros((4, 1 << 12), dtype=np.int64)  # start, length, first and number of its ``more_places``
        self.more_places = np.zeros(0, dtype=np.uint16)

    def _forget(self) -> None:
        self._no_patterns()
        kept = self.limit // 2
        for word in self.names[kept:]:
            del self.words[word]
        del self.names[kept:]
        self.start[kept:] = -1
        self.letters = self.letters[: kept + 1]
        self.points = self.points[: self.letters[-1]]
        flat, self.start[:kept] = _gathered(self.flat, self.start[:kept], self.length[:kept])
        self.flat[: len(flat)], self.used = flat, len(flat)
        self.places, self.first[:kept] = _gathered(self.places, self.first[:kept], self.offered[:kept])

    def encode(self, doc_ids: list[int | None], texts: list[str]) -> list[np.ndarray]:
        split = [_WORDS.findall(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.names) > self.limit:
            self._forget()
        known, names = self.words, self.names
        new = [w for w in set().union(*split) if w not in known]
        known.update(zip(new, range(len(names), len(names) + len(new))))
        names += new
        self.points = np.concatenate([self.points, np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), dtype="<u4")])
        self.letters = np.concatenate([self.letters, self.letters[-1] + np.cumsum(np.fromiter(map(len, new), dtype=np.int64, count=len(new)))])
        count = np.array([len(ws) for ws in split])
        number = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(count.sum()))
        starts = np.concatenate([[0], np.cumsum(count)])
        order = np.arange(len(number)) - np.repeat(starts[:-1], count)
        owner = np.repeat(np.array([(d or 0) & _ALL for d in doc_ids], dtype=np.uint64), count)
        key = mixed(mixed(owner + np.uint64(self.seed)) + order.astype(np.uint64))
        if len(names) > len(self.start):
            grow = max(len(names), 2 * len(self.start)) - len(self.start)
            self.start = np.concatenate([self.start, np.full(grow, -1, dtype=np.int64)])
            self.length, self.first, self.offered = (np.concatenate([x, np.zeros(grow, dtype=np.int64)]) for x in (self.length, self.first, self.offered))
        self._learn(np.flatnonzero(self.start[: len(names)] < 0))
        found = [self._pieces(number[at : at + (1 << 17)], key[at : at + (1 << 17)]) for at in range(0, len(number), 1 << 17)]
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *[x for x, _ in found]])
        ends = np.cumsum(np.concatenate([np.zeros(1, dtype=np.int64), *[n for _, n in found]]))[starts]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _pieces(self, number: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of occurrences of words, one after the other, and how many each has."""
        start, length, mark = self.start[number], self.length[number], self.used
        if self.rate > 0:
            n = self.offered[number]
            which = np.repeat(np.arange(len(number)), n)
            skipped = np.flatnonzero(_falls(key[which], PLACES[self.places[ranges(self.first[number], n)]], self.rate))
            place = skipped - (np.cumsum(n) - n)[which[skipped]]
            anew = length == 0  # long words
            anew[which[skipped]] = True
            some = anew & (length > 0) & (n <= self.BITS) & (number < self.WORDS)
            bits = np.bincount(which[skipped], weights=np.ldexp(1.0, np.minimum(place, self.BITS)), minlength=len(number))  # exact
            rows = np.flatnonzero(some)
            rows, found = self._patterned(rows, number[rows].astype(np.uint64) << np.uint64(self.BITS) | bits[rows].astype(np.uint64))
            start[rows], length[rows], first, more = self.more[:, found]
            anew[rows] = False
            which = np.repeat(rows, more)
            anew[which[_falls(key[which], PLACES[self.more_places[ranges(first, more)]], self.rate)]] = True
            rows, mark = np.flatnonzero(anew), self.used
            self._merge(number[rows], key[rows], self.rate, rows, start, length)
        flat = self.flat[ranges(start, length)]
        self.used = mark
        return flat, length

    def _patterned(self, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``rows`` whose outcome is remembered, and its number; those met twice are learned while there is room."""
        codes, inverse, k = np.unique(codes, return_inverse=True, return_counts=True)
        found = np.array([self.patterns.get(c, -1) for c in codes.tolist()], dtype=np.int64)
        new = np.flatnonzero((found < 0) & (k > 1))[: max(0, self.limit - len(self.patterns))]
        if len(new):
            found[new] = np.arange(len(self.patterns), len(self.patterns) + len(new))
            self._learn_patterns(codes[new], found[new])
            self.patterns.update(zip(codes[new].tolist(), found[new].tolist()))
        found = found[inverse]
        return rows[found >= 0], found[found >= 0]

    def _learn_patterns(self, codes: np.ndarray, slots: np.ndarray) -> None:
        if slots[-1] >= self.more.shape[1]:
            self.more = np.concatenate([self.more, np.zeros((4, max(self.more.shape[1], len(slots))), dtype=np.int64)], axis=1)
        number = (codes >> np.uint64(self.BITS)).astype(np.int64)
        n = self.offered[number]
        which, at = np.repeat(np.arange(len(number)), n), self.places[ranges(self.first[number], n)].astype(np.int64)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        own = np.flatnonzero(codes[which] >> place.astype(np.uint64) & np.uint64(1))
        k = np.bincount(which[own], minlength=len(number))
        skipped = np.full((len(number), int(k.max())), -1, dtype=np.int64)
        skipped[which[own], np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)] = at[own]
        offers: list[tuple[np.ndarray, np.ndarray]] = []
        self._merge(number, np.zeros(len(number), dtype=np.uint64), self.rate, slots, self.more[0], self.more[1], offers, skipped)
        rows, places = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*offers))
        known, pairs = np.sort(which << 16 | at), rows << 16 | places
        fresh = known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] != pairs
        rows, places = rows[fresh], places[fresh]
        n = np.bincount(rows, minlength=len(number))
        self.more[2, slots], self.more[3, slots] = len(self.more_places) + np.cumsum(n) - n, n
        self.more_places = np.concatenate([self.more_places, places[np.argsort(rows, kind="stable")].astype(np.uint16)])

    def _learn(self, number: np.ndarray) -> None:
        offers: list[tuple[np.ndarray, np.ndarray]] = []
        if self.rate > 0:
            long = self.letters[number + 1] - self.letters[number] > SHORT
            self.start[number[long]], self.length[number[long]], self.offered[number[long]] = 0, 0, 0
            number = number[~long]
        self._merge(number, np.zeros(len(number), dtype=np.uint64), 0.0, number, self.start, self.length, offers)
        if self.rate > 0 and offers:
            rows, places = (np.concatenate(x) for x in zip(*offers))
            n = np.bincount(rows, minlength=len(number))
            self.first[number], self.offered[number] = len(self.places) + np.cumsum(n) - n, n
            self.places = np.concatenate([self.places, places[np.argsort(rows, kind="stable")].astype(np.uint16)])

    def _merge(self, number, keys, rate, slots, start, length, offers: list | None = None, skipped: np.ndarray | None = None) -> None:
        """Merges words with their keys, or with the places that are ``skipped``; ``start`` and ``length`` at ``slots`` say
        where in ``flat`` their pieces are."""
        v, lengths = self.v, self.letters[number + 1] - self.letters[number]
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, SHORT)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(rows), 1 << 13):
                part = rows[at : at + (1 << 13)]
                within = np.arange(high) < lengths[part][:, None]
                points = np.zeros((len(part), high), dtype=np.int64)
                points[within] = self.points[ranges(self.letters[number[part]], lengths[part])]
                table = np.where(within, v.of_point[points], np.int32(-1))
                here = None if offers is None else []
                ids, alive = together(table, lengths[part], keys[part], rate, v, here, None if skipped is None else skipped[part])
                if here:
                    offers += [(part[r], place) for r, place in here]
                self._keep_all(slots[part], ids, alive, points, start, length)
        for r in np.flatnonzero(lengths > SHORT):
            word = self.names[number[r]]
            found = agenda([v.chars.get(c, -1) for c in word], int(keys[r]), rate, v)
            self._keep(slots[r], [p for p, _ in found], [i for _, i in found], word, start, length)

    def _room(self, n: int) -> None:
        if self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), n), dtype=np.int32)])

    def _keep_all(self, slots: np.ndarray, ids: np.ndarray, alive: np.ndarray, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        pieces, n = ids[alive], alive.sum(axis=1)
        odd = np.flatnonzero(pieces < 0)
        if len(odd):  # characters outside of the vocabulary become bytes
            chars, which = np.unique(points[alive][odd], return_inverse=True)
            spelled = [(SPACE if c == ord(LITERAL) else chr(c)).encode("utf-8", "surrogatepass") for c in chars.tolist()]
            size = np.array([len(x) for x in spelled], dtype=np.int64)
            row = np.repeat(np.arange(len(n)), n)
            many = np.ones(len(pieces), dtype=np.int64)
            many[odd] = size[which]
            n = np.bincount(row, weights=many, minlength=len(n)).astype(np.int64)
            first = np.cumsum(many) - many
            pieces = np.repeat(pieces, many)
            flat = self.v.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
            pieces[ranges(first[odd], many[odd])] = flat[ranges((np.cumsum(size) - size)[which], many[odd])]
        self._room(len(pieces))
        self.flat[self.used : self.used + len(pieces)] = pieces
        start[slots], length[slots] = self.used + np.cumsum(n) - n, n
        self.used += len(pieces)

    def _keep(self, slot: int, ids: list[int], places: list[int], text: str, start: np.ndarray, length: np.ndarray) -> None:
        """A word with characters outside of the vocabulary, which become bytes."""
        out = []
        for p, i in zip(ids, places):
            if p >= 0:
                out.append(p)
            else:
                c = SPACE if text[i] == LITERAL else text[i]
                out += self.v.byte_ids[list(c.encode("utf-8", "surrogatepass"))].tolist()
        self._room(len(out))
        self.flat[self.used : self.used + len(out)] = out
        start[slot], length[slot] = self.used, len(out)
        self.used += len(out)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.v.raw[ranges(self.v.begins[ids], self.v.sizes[ids])].tobytes()
        return raw[1:].decode("utf-8", "surrogatepass")  # without the space that every text is given in front


def _encoder(path: str, rate: float, seed: int) -> Encoder:
    return held(("dropout", path, rate, seed), lambda: Encoder(path, rate, seed))


def encode_documents(
    docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and lossless (the ids decode to the text) of every
    document; one pass without a shuffle. Another ``seed`` (an epoch's number, say) gives other segmentations."""

    def run(batches):
        encoder = _encoder(model_path, rate, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                doc_ids, part = (c.slice(at, 256).to_pylist() for c in batch.columns)
                part = [t or "" for t in part]
                found = encoder.encode(doc_ids, part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + 256],
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()),
                        pa.array([encoder.decode(x) == t for x, t in zip(found, part)], pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "lossless"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, lossless boolean")
