"""Tokenizer front end that splits whole blocks of texts into words at once and encodes each distinct word once.

Both vocabularies split text at white space, and words at the border of letters and punctuation, before they merge. So a
text's ids are the ids of its words in order, and a word's are those of its letters and of the punctuation after them.
Splitting, and finding the distinct words of a block, are columnar operations; a word of plain letters goes to the
vocabulary's merge model directly, since nothing is left to normalize or split in it, and any other one through the whole
tokenizer. The memo holds at most ``limit`` parts of words between blocks: when it is full, the later half goes, since
frequent ones are met, and kept, first.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skylattice.llm.arrays import ranges, starts
from skylattice.llm.worker import held

#: Texts that are taken from a batch at a time.
SLICE = 1024
#: Characters of texts that are split at a time (a longer text is a block of its own).
BLOCK_CHARS = 2 << 20
#: Separators that Python takes for white space but the vocabularies don't: such texts are encoded as a whole.
_SEPARATORS = "[\x1c-\x1f]"
#: White space besides single spaces and line feeds.
_UNUSUAL = "[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]"
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Latin and Cyrillic letters whose lower case is one letter too and that no normal form changes.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-žЁА-яё"
_STEM = f"^[{_LETTERS}]+$"
_PLAIN = f"^ ?[{_LETTERS}]+$"
#: Punctuation that is split off the letters before it.
_TAIL = ".,;:!?%&#*$)]}\"-_~/="


class Memo:
    """Part of a word -> its ids. Entries lie in ``flat`` in the order in which they came."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.number: dict[str, int] = {}
        self.at = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def find(self, parts: pa.Array) -> np.ndarray:
        """Numbers of the parts, all of which are known afterwards."""
        if len(self.number) > self.limit:
            kept = self.limit // 2
            self.number = dict(islice(self.number.items(), kept))
            self.at = self.at[: kept + 1].copy()
            self.flat = self.flat[: self.at[-1]].copy()
        number, names = self.number, parts.to_pylist()
        found = np.fromiter((number.get(w, -1) for w in names), dtype=np.int64, count=len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            ids, counts = self.encode([names[k] for k in new.tolist()])
            found[new] = np.arange(len(number), len(number) + len(new))
            number.update(zip([names[k] for k in new.tolist()], found[new].tolist()))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, ids])
        return found


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum())), counts


def _cut(texts: pa.Array, lengths: np.ndarray) -> pa.Array:
    """What comes after the first ``lengths`` bytes of each text."""
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    n = np.diff(at) - lengths
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ranges(at[:-1] + lengths, n)]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(starts(n).astype(np.int32)), pa.py_buffer(data))


class TextEncoder:
    """ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words_only = self.tokenizer.normalizer is not None  # white space is dropped, so a word stands alone
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # how the model writes a character
        letters = [chr(c) for c in range(0x80, 0x500) if re.match(f"[{_LETTERS}]", chr(c))]
        self.table = {ord(c): written.pre_tokenize_str(c)[0][0] for c in [" ", *letters]}
        self.memo = Memo(self._new, limit)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _new(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(pa.array(parts, pa.string()), _PLAIN).to_pylist()
        rest = iter(self.tokenizer.encode_batch_fast([p for p, yes in zip(parts, plain) if not yes], add_special_tokens=False))
        merge, table, ids, counts = self.model.tokenize, self.table, array("I"), array("q")
        for p, yes in zip(parts, plain):
            if yes:
                found = [t.id for t in merge(p.replace(" ", "Ġ") if p.isascii() else p.translate(table))]
            else:
                found = next(rest).ids
            ids.extend(found)
            counts.append(len(found))
        return np.frombuffer(ids, dtype=np.uint32), np.frombuffer(counts, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and where each text's begin (and the last one's end). Null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        found, at = [], 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), BLOCK_CHARS, side="right")))
            found.append(self._block(texts.slice(at, n)))
            at += n
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *[i for i, _ in found]])
        return ids, starts(np.concatenate([np.zeros(0, dtype=np.int64), *[c for _, c in found]]))

    def documents(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text, with ``end_id`` after them."""
        ids, at = self.encode(texts)
        ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.words_only:
            return self._texts(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
        odd = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
        whole = odd & pc.match_substring_regex(texts, _SEPARATORS).to_numpy(zero_copy_only=False)
        parts = []
        for some, encode in ((~odd, self._lines), (odd & ~whole, self._chunks), (whole, lambda t: self._whole(t.to_pylist()))):
            if some.all():
                return encode(texts)
            if some.any():
                parts.append((np.flatnonzero(some), *encode(texts.filter(pa.array(some)))))
        order = np.argsort(np.concatenate([k for k, *_ in parts]))
        ids, counts = (np.concatenate(x) for x in list(zip(*parts))[1:])
        return ids[ranges(starts(counts)[:-1][order], counts[order])], counts[order]

    def _lines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose words are parted by single spaces and line feeds. Words with a space before them stand for
        themselves; a line feed before a word stays with it, and a text's first word is marked by a tab."""
        return self._texts(pc.split_pattern(pc.binary_join_element_wise("\t", pc.replace_substring(texts, "\n", " \n"), ""), " "))

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Any other texts: white space that is no word's own stands alone, so it is marked by a tab too."""
        found = [[c[1:] if c[0] == " " and not c.isspace() else "\t" + c for c in _CHUNKS.findall(t)] for t in texts.to_pylist()]
        return self._texts(pa.array(found, pa.list_(pa.string())))

    def _texts(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids and their counts of texts that are given as lists of marked words."""
        length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(lists).dictionary_encode()
        ids, at = self._words(words.dictionary)
        index = words.indices.to_numpy(zero_copy_only=False)
        n = np.diff(at)[index]
        return ids[ranges(at[index], n)], np.diff(starts(n)[starts(length)])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of marked words, and where each word's begin: a line feed, letters and punctuation, or none of these."""
        marked = line = np.zeros(len(words), dtype=bool)
        if not self.words_only:
            line = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
            marked = line | pc.starts_with(words, "\t").to_numpy(zero_copy_only=False)
            words = _cut(words, marked.astype(np.int64))
        stem = pc.utf8_rtrim(words, _TAIL)
        split = pc.match_substring_regex(stem, _STEM).to_numpy(zero_copy_only=False)
        tail = _cut(words, np.where(split, pc.binary_length(stem).to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy(zero_copy_only=False)))
        if self.words_only:
            stem = pc.utf8_lower(stem)
        stem = pc.if_else(pa.array(split), stem, words)
        if not self.words_only:
            stem = pc.binary_join_element_wise(pc.if_else(pa.array(marked), "", " "), stem, "")
        found = pa.chunked_array([pa.array(["", "\n"], pa.string()), stem, tail]).dictionary_encode().combine_chunks()
        number = self.memo.find(found.dictionary)[found.indices.to_numpy(zero_copy_only=False)]
        none, feed, number = number[0], number[1], number[2:].reshape(2, len(words))
        number = np.stack([np.where(line, feed, none), *number], axis=1).ravel()
        at, n = self.memo.at[number], np.diff(self.memo.at)[number]
        return self.memo.flat[ranges(at, n)], starts(n)[::3]


def encoder(path: str) -> TextEncoder:
    """The worker's encoder of a vocabulary."""
    return held(("tokens", path), lambda: TextEncoder(path))
