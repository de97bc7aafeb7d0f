"""Token ids of whole texts, for the packing operators.

Words are looked up by hash; a word not seen before is encoded once per worker
by the compiled merges, and its ids are kept in one growing array.
"""

from __future__ import annotations

import numpy as np

from vitalis.llm.bpe import Memo
from vitalis.llm.textkit import worker_cache
from vitalis.llm.tokens import compiled, encode_distinct, split_special, word_bytes, word_hashes, words_of

ID_TYPE = np.uint16  # every id of the vocabulary is below 65 536 (checked when it is loaded)

MOST_WORDS = 600_000
BLOCK_CHARS = 4 << 20  # of texts at a time: the words new to a worker are encoded together, fewer and longer array steps


class WordIds:
    """Ids of the words seen so far: hash -> place in one array of ids."""

    def __init__(self):
        self.memo = Memo(most_bits=30)
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.count, self.ids, self.filled = 0, np.zeros(1 << 16, ID_TYPE), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Store words' ids (one after the other in ``flat``); returns their numbers."""
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(sizes) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.filled:self.filled + len(flat)] = flat
        number = np.arange(self.count, self.count + len(sizes), dtype=np.int32)
        self.begin[number] = self.filled + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.size[number] = sizes
        self.count += len(sizes)
        self.filled += len(flat)
        return number


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., for ``size[0]`` places, then begin[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class IdEncoder:
    def __init__(self, path: str):
        self.merges, self.special = compiled(path)
        highest = max(int(self.merges.piece_ids.max()), *self.special.values())
        if highest >= 1 << 16:
            raise ValueError("token ids of this vocabulary need more than 16 bits")
        self.words = worker_cache().setdefault(("ids", path), WordIds())

    def __call__(self, texts: list[str], with_least: bool = False):
        """(ids, offsets of the texts[, the smallest word hash of each text])."""
        ids, counts, least, a = [], [], [], 0
        sizes = np.cumsum([len(t) + 1 for t in texts])
        while a < len(texts):
            done = sizes[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(sizes, done + BLOCK_CHARS, side="right")))
            some, n, low = self._block(texts[a:b])
            ids.append(some)
            counts.append(n)
            least.append(low)
            a = b
        ids = np.concatenate(ids) if ids else np.zeros(0, ID_TYPE)
        offs = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        if with_least:
            return ids, offs, np.concatenate(least) if least else np.zeros(0, np.uint64)
        return ids, offs

    def _block(self, texts):
        if self.words.memo.used > MOST_WORDS:  # bounded memory: forget, and learn again
            self.words.__init__()
        segments, owner, found = split_special(texts, self.special)
        points, start, end, seg = words_of(segments)
        hashes = word_hashes(points, start, end)
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        numbers = self.words.memo.get(uniq)
        miss = np.flatnonzero(numbers < 0)
        if len(miss):
            fresh = self._encode(word_bytes(points, start[first[miss]], end[first[miss]]))
            numbers[miss] = self.words.add(*fresh)
            self.words.memo.put(uniq[miss], numbers[miss])
        number = numbers[inverse]
        size = self.words.size[number].astype(np.int64)
        begin = self.words.begin[number]
        owner_of_word = owner[seg]
        if found:  # special strings stand between the words of the segment before and those of the next
            extra = self.words.add(np.array([i for _, i in found], ID_TYPE), np.ones(len(found), np.int32))
            at = np.searchsorted(seg, np.array([s for s, _ in found]), side="right")
            size = np.insert(size, at, 1)
            begin = np.insert(begin, at, self.words.begin[extra])
            owner_of_word = np.insert(owner_of_word, at, owner[np.array([s for s, _ in found])])
        ids = self.words.ids[spread(begin, size)]
        counts = np.bincount(owner_of_word, weights=size, minlength=len(texts)).astype(np.int64)
        low = np.full(len(texts), np.uint64(0xFFFFFFFFFFFFFFFF))
        if len(seg):
            runs = np.flatnonzero(np.append(True, np.diff(owner[seg]) != 0))
            low[owner[seg][runs]] = np.minimum.reduceat(hashes, runs)
        return ids, counts, low

    def _encode(self, words: list[bytes]):
        sizes = np.zeros(len(words), np.int32)
        rows_of, pieces_of = [], []
        for rows, lens, last, counts in encode_distinct(self.merges, words):
            pieces = self.merges.pieces_of(last, counts, lens)
            sizes[rows] = counts[np.arange(len(rows)), lens]
            rows_of.append(np.repeat(rows, sizes[rows]))
            pieces_of.append(pieces[pieces >= 0])
        rows, pieces = np.concatenate(rows_of), np.concatenate(pieces_of)
        return pieces[np.argsort(rows, kind="stable")].astype(ID_TYPE), sizes
