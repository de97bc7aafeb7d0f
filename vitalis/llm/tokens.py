"""Operator 8 - token counts by a compiled finite-state tokenizer.

The tokenizer of ``word_bpe_49k.json`` is compiled into two levels of
deterministic transducers.

*Words.* Normalised text (NFC, white space, lower case) is cut into words by
the vocabulary's published pattern: contractions, runs of letters, single digits,
runs of other signs. That pattern is compiled by hand into a transducer of 7 states over
13 character classes; a transition is annotated with the word starts it emits
(at this character, at the one before). A block of text is cut into chunks of
256 characters, each chunk's map from entry state to exit state is computed for
all chunks in lockstep, the maps are composed by a parallel prefix scan, and
with every chunk's entry state known a second lockstep pass emits the starts.

*Pieces.* Inside a word the state is the last piece of each prefix; reading a
byte moves to the next state and emits the change in the number of tokens
(``bpe.Merges.encode_words``). It is compiled lazily: a word's total is
remembered by its hash for the life of the worker.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import col
from vitalis.llm.bpe import WORD_END, Memo, load_word_bpe
from vitalis.llm.textkit import _powers, small_batches, span_hash, worker_cache

VOCABULARY = "word_bpe_49k.json"
CONTEXT_LIMIT = 2048
BLOCK_CHARS = 1 << 20
CHUNK = 256

# Character classes. Letters that occur in contractions have classes of their own.
SPACE, LETTER, NUMBER, SIGN, QUOTE = range(5)
IN_CONTRACTION = "strevmld"
CLASSES = 5 + len(IN_CONTRACTION)
# States: outside a word, in letters, in signs, after a quote that starts a word,
# after such a quote and r, v or l (a contraction if e, e or l follows).
GAP, LETTERS, SIGNS, AFTER_QUOTE, AFTER_R, AFTER_V, AFTER_L = range(7)
STATES = 7
HERE, BEFORE = 1, 2


def word_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted starts) by state * CLASSES + class."""
    move = np.zeros((STATES, CLASSES), np.uint8)
    emit = np.zeros((STATES, CLASSES), np.uint8)
    letter_classes = [LETTER, *range(5, CLASSES)]
    of = {c: 5 + k for k, c in enumerate(IN_CONTRACTION)}
    for s in range(STATES):
        pending = BEFORE if s in (AFTER_R, AFTER_V, AFTER_L) else 0  # the letter was a word's start after all
        move[s, SPACE], emit[s, SPACE] = GAP, pending
        move[s, NUMBER], emit[s, NUMBER] = GAP, pending | HERE
        move[s, SIGN], emit[s, SIGN] = SIGNS, pending | (0 if s in (SIGNS, AFTER_QUOTE) else HERE)
        if s in (SIGNS, AFTER_QUOTE):
            move[s, QUOTE], emit[s, QUOTE] = SIGNS, 0
        else:
            move[s, QUOTE], emit[s, QUOTE] = AFTER_QUOTE, pending | HERE
        for c in letter_classes:
            move[s, c], emit[s, c] = LETTERS, pending | (HERE if s in (GAP, SIGNS, AFTER_QUOTE) else 0)
    for c in "stmd":
        move[AFTER_QUOTE, of[c]], emit[AFTER_QUOTE, of[c]] = GAP, 0
    for c, s, last in (("r", AFTER_R, "e"), ("v", AFTER_V, "e"), ("l", AFTER_L, "l")):
        move[AFTER_QUOTE, of[c]], emit[AFTER_QUOTE, of[c]] = s, 0
        move[s, of[last]], emit[s, of[last]] = GAP, 0
    return move.reshape(-1), emit.reshape(-1)


def run_transducer(classes: np.ndarray) -> np.ndarray:
    """Start flags of a block that begins outside a word and ends in white space."""
    move, emit = word_transducer()
    n = len(classes)
    rows = -(-n // CHUNK)
    steps = np.full(rows * CHUNK, SPACE, np.uint8)
    steps[:n] = classes
    steps = np.ascontiguousarray(steps.reshape(rows, CHUNK).T)
    # each chunk's map, all entry states at once
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for j in range(CHUNK):
        maps = move[maps * np.uint8(CLASSES) + steps[j]]
    # inclusive prefix scan under composition: after the round of width d a column holds the maps of its last 2d chunks
    d = 1
    while d < rows:
        later = maps[:, d:]
        maps = np.concatenate([maps[:, :d], np.take_along_axis(later, maps[:, :-d].astype(np.int64), axis=0)], axis=1)
        d *= 2
    state = np.concatenate([[np.uint8(GAP)], maps[GAP, :-1]]).astype(np.uint8)
    out = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        k = state * np.uint8(CLASSES) + steps[j]
        out[j] = emit[k]
        state = move[k]
    out = out.T.reshape(-1)[:n]
    starts = (out & HERE).astype(bool)
    starts[:-1] |= (out[1:] & BEFORE).astype(bool)
    return starts


def _unicode_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every code point (the one form of two characters is handled apart)."""
    cache = worker_cache()
    if "unicode" not in cache:
        classes = np.full(0x110000, SIGN, np.uint8)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            kind = unicodedata.category(ch)[0]
            if kind == "L":
                classes[c] = LETTER
                low = ch.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
            elif kind == "N":
                classes[c] = NUMBER
                low = ch.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
            elif kind == "S" and ch.lower() != ch:
                lower[c] = ord(ch.lower())
        # The characters with the White_Space property.
        space = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                 0x205F, 0x3000]
        classes[space] = SPACE
        classes[ord("'")] = QUOTE
        for k, c in enumerate(IN_CONTRACTION):
            classes[ord(c)] = 5 + k
        cache["unicode"] = classes, lower
    return cache["unicode"]


def split_special(texts: list[str], special: dict[str, int]):
    """Texts cut at special strings: (segments, document of each, [(segment it follows, id)])."""
    segments, owner, found = [], [], []
    for d, text in enumerate(texts):
        if "<|" in text and any(s in text for s in special):
            at = 0
            while True:
                hits = [(text.find(s, at), s) for s in special]
                hits = [h for h in hits if h[0] >= 0]
                if not hits:
                    break
                k, s = min(hits, key=lambda h: (h[0], -len(h[1])))
                segments.append(text[at:k])
                owner.append(d)
                found.append((len(segments) - 1, special[s]))
                at = k + len(s)
            text = text[at:]
        segments.append(text)
        owner.append(d)
    return segments, np.array(owner, np.int64), found


def words_of(segments: list[str]):
    """(code points, start, end, segment) of all words of the normalised segments."""
    classes, lower = _unicode_tables()
    clean = [s if s.isascii() or unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s)
             for s in segments]
    clean = [s.replace("İ", "i̇") if "İ" in s else s for s in clean]
    lens = np.array([len(s) + 1 for s in clean], np.int64)
    points = lower[np.frombuffer((" ".join(clean) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    kinds = classes[points]
    starts = run_transducer(kinds)
    edge = np.flatnonzero(starts | (kinds == SPACE))
    which = np.flatnonzero(starts[edge])
    start, end = edge[which], edge[which + 1]
    return points, start, end, np.searchsorted(np.cumsum(lens), start, side="right")


def word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    prefix = np.empty(len(points) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((points + np.uint32(1)) * _powers(len(points) + 1)[0][:len(points)], out=prefix[1:])
    h = span_hash(prefix, start, end)
    h[h == 0] = 1
    return h


def word_bytes(points, start, end) -> list[bytes]:
    """The UTF-8 bytes of some words."""
    lens = end - start
    at = np.repeat(start - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
    text = points[at].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    cuts = np.concatenate([[0], np.cumsum(lens)])
    return [text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def compiled(path: str):
    """Merges and special strings of a vocabulary, loaded once per worker."""
    cache = worker_cache()
    if ("bpe", path) not in cache:
        cache["bpe", path] = load_word_bpe(path)
    return cache["bpe", path]


# Words of up to so many bytes advance together; the matrices of one go are bounded by LOCKSTEP cells.
LENGTHS = (12, 24, 48, 96, 192)
LOCKSTEP = 4_000_000


def encode_distinct(merges, words: list[bytes]):
    """Yields (rows into ``words``, their lengths, last, counts): words of like length together."""
    lens = np.array([len(w) for w in words])
    order = np.argsort(-lens, kind="stable")
    top = np.searchsorted(np.array(LENGTHS), lens[order])
    edges = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(order)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        while a < b:
            size = int(lens[order[a]])
            some = order[a:min(b, a + max(1, LOCKSTEP // size))]
            a += len(some)
            own = lens[some]
            flat = np.frombuffer(b"".join(words[i] for i in some), np.uint8)
            syms = np.zeros((len(some), size), np.int64)
            syms[np.arange(size)[None, :] < own[:, None]] = flat
            syms[np.arange(len(some)), own - 1] += WORD_END
            yield some, own, *merges.encode_words(syms, own)


class TokenCounter:
    """Token counts of texts; remembers the words it has seen."""

    def __init__(self, path: str):
        self.merges, self.special = compiled(path)
        self.memo = worker_cache().setdefault(("counts", path), Memo())

    def __call__(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        a = 0
        sizes = np.cumsum([len(t) + 1 for t in texts])
        while a < len(texts):
            done = sizes[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(sizes, done + BLOCK_CHARS, side="right")))
            total[a:b] = self._block(texts[a:b])
            a = b
        return total

    def _block(self, texts):
        segments, owner, found = split_special(texts, self.special)
        points, start, end, seg = words_of(segments)
        total = np.bincount([owner[s] for s, _ in found], minlength=len(texts)) if found else np.zeros(
            len(texts), np.int64)
        if len(start):
            uniq, first, inverse = np.unique(word_hashes(points, start, end), return_index=True, return_inverse=True)
            counts = self.memo.get(uniq)
            miss = np.flatnonzero(counts < 0)
            if len(miss):
                words = word_bytes(points, start[first[miss]], end[first[miss]])
                for rows, lens, _, emitted in encode_distinct(self.merges, words):
                    counts[miss[rows]] = emitted[np.arange(len(rows)), lens]
                self.memo.put(uniq[miss], counts[miss])
            total = total + np.bincount(owner[seg], weights=counts[inverse], minlength=len(texts)).astype(np.int64)
        return total


def _count(path, text_name, keep):
    def run(batches):
        counter = TokenCounter(path)
        for batch in small_batches(batches, len(keep)):
            texts = batch.column(batch.schema.get_field_index(text_name))
            texts = ["" if t is None else t for t in texts.to_pylist()]
            n_bytes = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(k)) for k in keep),
                 pa.array(n_bytes, pa.int64()), pa.array(counter(texts), pa.int64())],
                [*keep, "n_bytes", "n_tokens"])
    return run


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(df: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None,
                 limit: int = CONTEXT_LIMIT) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with n_bytes, n_tokens and over_limit of each whole text.

    ``path`` is the vocabulary file, the same on every machine. A null text
    counts as empty; empty texts have no tokens; special strings inside a text
    count as one token each. A narrow operator: no shuffle. Kept columns must
    not be called n_bytes, n_tokens or over_limit (ValueError).
    """
    keep = df.columns if keep is None else keep
    clash = {"n_bytes", "n_tokens", "over_limit"} & set(keep)
    if clash:
        raise ValueError(f"the table already has columns named {sorted(clash)}")
    inner = [f"c{k}" for k in range(len(keep))]
    fields = [T.StructField(n, df.schema[c].dataType) for n, c in zip(inner, keep, strict=True)]
    counted = (df.select(*(col(c).alias(n) for n, c in zip(inner, keep, strict=True)), col(text_col).alias("text"))
               .mapInArrow(_count(path or vocabulary_path(), "text", inner),
                           T.StructType([*fields, T.StructField("n_bytes", T.LongType()),
                                         T.StructField("n_tokens", T.LongType())])))
    return counted.select(*(F.col(n).alias(c) for n, c in zip(inner, keep, strict=True)), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, keep=["doc_id"])
