"""Byte-pair encoding as batched array work, for published vocabularies.

``Merges`` holds a vocabulary's pieces and merges as hash tables of arrays. Two facts make
encoding a left-to-right dynamic programme instead of a merge queue:

* a sequence of pieces is the encoding of its text if and only if every two
  neighbours are the encoding of their own concatenation (a merge across a
  boundary would also happen when the two stand alone);
* hence for every prefix of a word the last piece is the one piece that ends
  there and is compatible with the last piece of the prefix before it.

``encode_words`` advances many words of about equal length together, one symbol at a time: hashes of
the substrings that end at the position probe the table of piece keys, and the
compatible candidate becomes the back pointer. Whether two pieces are
compatible is found by running the merges on just these two, and remembered.
"""

from __future__ import annotations

import json

import numpy as np

from vitalis.llm.textkit import mix

EMPTY = np.uint64(0)


class Memo:
    """An open-addressing hash table from 64-bit keys to 32-bit values, probed with whole arrays."""

    def __init__(self, bits: int = 16, most_bits: int = 22):
        self.most_bits = most_bits
        self._reset(bits)

    def _reset(self, bits):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1 where a key is not held. Keys must not be 0."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (held != EMPTY)
            left, slot = left[go], slot[go]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> bool:
        """Add distinct keys that are not held yet. True if the table was emptied first to stay in bounds."""
        emptied = False
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            bits = max(self.bits, int(np.ceil(np.log2(4 * (self.used + len(keys) + 1)))))
            if bits > self.most_bits and self.used:
                bits, emptied = max(16, int(np.ceil(np.log2(4 * (len(keys) + 1))))), True
            old = (self.keys, self.values)
            self._reset(bits)
            if not emptied:
                live = old[0] != EMPTY
                self._place(old[0][live], old[1][live])
        self._place(keys, values)
        return emptied

    def _place(self, keys, values):
        left, slot = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = keys[left[free]]
            self.values[slot[free]] = values[left[free]]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)
        self.used += len(keys)


def _pair_key(a, b):
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


class Merges:
    """A vocabulary's symbols, pieces and merges.

    ``pieces``: id -> tuple of symbols; a symbol is an int that the caller gives a
    meaning (a byte, a byte at a word's end, a code point). ``pairs``: (left id,
    right id, rank, made id), the lowest rank merging first.
    """

    def __init__(self, pieces: dict[int, tuple[int, ...]], pairs: list[tuple[int, int, int, int]]):
        table = np.array(sorted(pairs), np.int64).reshape(-1, 4)
        self.ranks, self.made = table[:, 2].copy(), table[:, 3].copy()
        self.pairs = Memo(18)
        self.pairs.put(mix(_pair_key(table[:, 0], table[:, 1])), np.arange(len(table), dtype=np.int32))
        self.atoms = {p[0]: i for i, p in pieces.items() if len(p) == 1}
        self.sym_offs = np.zeros(max(pieces) + 2, np.int64)
        for i, p in pieces.items():
            self.sym_offs[i + 1] = len(p)
        self.sym_offs = np.cumsum(self.sym_offs)
        self.syms = np.zeros(self.sym_offs[-1], np.int64)
        for i, p in pieces.items():
            self.syms[self.sym_offs[i]:self.sym_offs[i + 1]] = p
        ids = np.array(sorted(pieces), np.int64)
        lens = np.diff(self.sym_offs)[ids]
        keys = np.zeros(len(ids), np.uint64)
        for size in np.unique(lens):
            rows = np.flatnonzero(lens == size)
            h = np.zeros(len(rows), np.uint64)
            for k in range(size):
                h = step_hash(h, self.syms[self.sym_offs[ids[rows]] + k])
            keys[rows] = seal(h)
        order = np.argsort(keys)
        self.piece_keys, self.piece_ids = keys[order], ids[order].astype(np.int32)
        self.longest = int(lens.max())
        self._drop_unreachable(ids, lens)

    def _drop_unreachable(self, ids, lens):
        """Keep the pieces that their own text is encoded to, and note the last merge that makes each."""
        size_all = int(ids.max()) + 1
        fine = np.ones(size_all, bool)
        self.split = np.full((size_all, 2), -1, np.int64)
        self.formed = np.full(size_all, -1, np.int64)
        for size in np.unique(lens[lens > 1]):
            rows = ids[lens == size]
            enc, pair = self.run(self._atoms_of(rows, size), with_last=True)
            fine[rows] = (enc[:, 0] == rows) & (enc[:, 1:] < 0).all(axis=1)
            self.split[rows] = pair
            self.formed[rows] = self._rank(pair[:, 0], pair[:, 1])[0]
        keep = fine[self.piece_ids]
        self.piece_keys, self.piece_ids = self.piece_keys[keep], self.piece_ids[keep]
        self.pieces = Memo(18)
        self.pieces.put(self.piece_keys, self.piece_ids)
        self.right, self.right_gone = self._spines(1)
        self.left, self.left_gone = self._spines(0)

    def _spines(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """For each piece: what stands at its ``side`` edge over time, latest first, and the rank that ends it."""
        never = np.iinfo(np.int64).max
        now = np.arange(len(self.split))
        gone = np.full(len(now), never)
        levels, ends = [], []
        while (now >= 0).any():
            levels.append(now)
            ends.append(gone)
            held = np.maximum(now, 0)
            gone = np.where(now >= 0, self.formed[held], never)
            now = np.where(now >= 0, self.split[held, side], -1)
        return np.stack(levels, axis=1), np.stack(ends, axis=1)

    def _atoms_of(self, ids, size):
        syms = self.syms[self.sym_offs[ids][:, None] + np.arange(size)]
        return self.atom_ids(syms)

    def atom_ids(self, syms: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_atom_sym"):
            self._atom_sym = np.array(sorted(self.atoms), np.int64)
            self._atom_id = np.array([self.atoms[s] for s in self._atom_sym], np.int64)
        at = np.minimum(np.searchsorted(self._atom_sym, syms), len(self._atom_sym) - 1)
        return np.where(self._atom_sym[at] == syms, self._atom_id[at], -2)

    def _rank(self, a, b):
        at = self.pairs.get(mix(_pair_key(a, b)).reshape(-1)).reshape(a.shape)
        hit = (at >= 0) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], np.iinfo(np.int64).max), self.made[at]

    def run(self, rows: np.ndarray, with_last: bool = False):
        """Apply the merges to rows of ids: lowest rank first, then leftmost. -1 pads the result on the right.

        ``with_last``: also the pair that the last merge joined, of rows that end as one piece.
        """
        rows = rows.copy()
        out = np.full_like(rows, -1)
        pair = np.full((len(rows), 2), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            if rows.shape[1] < 2:
                out[live, :rows.shape[1]] = rows
                break
            rank, made = self._rank(rows[:, :-1], rows[:, 1:])
            at = rank.argmin(axis=1)
            k = np.arange(len(rows))
            go = rank[k, at] < np.iinfo(np.int64).max
            out[live[~go], :rows.shape[1]] = rows[~go]
            rows, at, made, live = rows[go], at[go], made[go], live[go]
            if not len(live):
                break
            k = np.arange(len(rows))
            if rows.shape[1] == 2:
                pair[live] = rows
            cols = np.arange(rows.shape[1] - 1)
            rows[k, at] = made[k, at]
            rows = np.where(cols[None, :] > at[:, None], rows[:, 1:], rows[:, :-1])
        return (out, pair) if with_last else out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is the encoding of a's text followed by b's just (a, b)? Any a below 0 (no piece before) is fine."""
        if not hasattr(self, "_pairs"):
            self._pairs = Memo()
        key = mix(_pair_key(a, b) + np.uint64(1))
        key[key == EMPTY] = 1
        known = self._pairs.get(key)
        miss = np.flatnonzero((known < 0) & (a >= 0))
        if len(miss):
            uniq, first, inv = np.unique(key[miss], return_index=True, return_inverse=True)
            good = (~self._crossed(a[miss[first]].astype(np.int64), b[miss[first]].astype(np.int64))).astype(np.int32)
            self._pairs.put(uniq, good)
            known[miss] = good[inv]
        return (known == 1) | (a < 0)

    def _crossed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Would a merge join an edge of x with an edge of y when x and y stand side by side?

        Merges take place in the order of their ranks. The pair of an edge s of x and
        an edge u of y can merge from ``when`` on: its own rank, or the rank that forms
        s or u if that is later. It does if neither has been merged away by then; of
        equal ranks the one further left comes first.
        """
        crossed = np.zeros(len(x), bool)
        for i in range(self.right.shape[1]):
            rows = np.flatnonzero((self.right[x, i] >= 0) & ~crossed)
            for j in range(self.left.shape[1]):
                rows = rows[(self.left[y[rows], j] >= 0) & ~crossed[rows]]
                if not len(rows):
                    break
                s, u = self.right[x[rows], i], self.left[y[rows], j]
                rank, _ = self._rank(s, u)
                when = np.maximum(rank, np.maximum(self.formed[s], self.formed[u]))
                crossed[rows] = ((rank < np.iinfo(np.int64).max) & (when < self.right_gone[x[rows], i])
                                 & (when <= self.left_gone[y[rows], j]))
        return crossed

    def encode_words(self, words: np.ndarray, lens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Encode rows of symbols: (last, counts). ``lens``, if the rows differ in length, must descend.

        last[w, i] is the last piece of the first i symbols and counts[w, i] how
        many pieces they make; the pieces follow from ``last`` from right to left.
        A symbol without a piece of its own makes a last piece of -2 and stands alone.
        """
        n, size = words.shape
        last = np.full((n, size + 1), -1, np.int32)
        counts = np.zeros((n, size + 1), np.int32)
        # hashes of the substrings that end at the position, the longest first
        begun: list[np.ndarray] = []
        for i in range(1, size + 1):
            k = n if lens is None else int(np.searchsorted(-lens, -i, side="right"))
            sym = words[:k, i - 1]
            begun = [step_hash(h[:k], sym) for h in begun[-(self.longest - 1):]] if self.longest > 1 else []
            begun.append(step_hash(np.zeros(k, np.uint64), sym))
            for back, h in enumerate(reversed(begun), 1):
                found = self.pieces.get(seal(h))
                rows = np.flatnonzero((found >= 0) & (last[:k, i] < 0))
                if not len(rows):
                    continue
                piece, before = found[rows], last[rows, i - back]
                good = self.compatible(before, piece)
                rows, piece = rows[good], piece[good]
                last[rows, i] = piece
                counts[rows, i] = counts[rows, i - back] + 1
            alone = np.flatnonzero(last[:k, i] < 0)
            last[alone, i] = -2
            counts[alone, i] = counts[alone, i - 1] + 1
        return last, counts

    def pieces_of(self, last: np.ndarray, counts: np.ndarray, lens: np.ndarray | None = None) -> np.ndarray:
        """The ids of each row, padded with -1 on the right (-2: a symbol that has no piece)."""
        n = len(last)
        at = np.full(n, last.shape[1] - 1) if lens is None else lens.copy()
        rows = np.arange(n)
        total = counts[rows, at]
        out = np.full((n, int(total.max()) if n else 0), -1, np.int64)
        k = total - 1
        while len(rows):
            piece = last[rows, at[rows]].astype(np.int64)
            out[rows, k[rows]] = piece
            at[rows] -= np.where(piece < 0, 1, self.sym_offs[piece + 1] - self.sym_offs[piece])
            k[rows] -= 1
            rows = rows[at[rows] > 0]
        return out


def step_hash(h: np.ndarray, sym: np.ndarray) -> np.ndarray:
    return h * np.uint64(0xD6E8FEB86659FD93) + (sym.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)


def seal(h: np.ndarray) -> np.ndarray:
    return mix(h)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: printable Latin-1 stands for
    itself, the other bytes for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


WORD_END = 256


def load_word_bpe(path: str) -> tuple[Merges, dict[str, int]]:
    """Merges of a byte-level vocabulary with word ends (.json) and its special strings.

    Symbols are bytes; the last byte of a word is WORD_END + byte.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters, end = byte_letters(), data["model"]["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    pieces = {}
    for text, i in data["model"]["vocab"].items():
        if text in special:
            continue
        closed = text.endswith(end) and len(text) > len(end)
        syms = [letters[c] for c in (text[:-len(end)] if closed else text)]
        if closed:
            syms[-1] += WORD_END
        pieces[i] = tuple(syms)
    vocab, pairs = data["model"]["vocab"], []
    for rank, merge in enumerate(data["model"]["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs.append((vocab[a], vocab[b], rank, vocab[a + b]))
    return Merges(pieces, pairs), special
