"""Operator 7 - SentencePiece encoding and decoding by a batched numpy Viterbi.

The public model file is a byte-pair model: its scores order merges, so the
best path by summed scores is *not* what the library returns. The Viterbi
therefore maximises over the paths that the merges allow: a piece may follow
another only if the two are the encoding of their own concatenation (see
``bpe.Merges``), which leaves exactly the library's segmentation.

Texts are normalised as the model asks (a blank in front, blanks as U+2581) and
cut into units that no piece can cross: before a blank that follows another
character, and around characters without a piece. Units of equal length form
the rows of a matrix and advance together: at each position the hashes of the
substrings that end there probe the sorted piece keys, candidates that may not
follow the piece before them score nothing, and the maximum's length and id
are stored as back pointers. Characters without a piece become their bytes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import col
from vitalis.llm.bpe import Merges, seal, step_hash
from vitalis.llm.textkit import small_batches, worker_cache
from vitalis.llm.tokenids import ID_TYPE, MOST_WORDS, WordIds, spread
from vitalis.llm.tokens import vocabulary_path, word_hashes

MODEL = "piece_bpe_32k.model"
BLANK = 0x2581
BLOCK_CHARS = 1 << 20
LOCKSTEP = 1_000_000


class PieceModel:
    """Pieces, merges and the bytes each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces, scores, self.byte_ids, text = {}, {}, np.zeros(256, np.int64), [b""] * n
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value], text[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[i] = tuple(map(ord, name))
                scores[i] = sp.get_score(i)
                text[i] = name.replace(chr(BLANK), " ").encode("utf-8")
        by_text = {p: i for i, p in pieces.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = [(by_text[p[:k]], by_text[p[k:]], order[scores[i]], i) for i, p in pieces.items()
                 for k in range(1, len(p)) if p[:k] in by_text and p[k:] in by_text]
        self.merges = Merges(pieces, pairs)
        self.known = np.zeros(0x110000, bool)
        self.known[[p[0] for p in pieces.values() if len(p) == 1]] = True
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_size = np.array([len(t) for t in text], np.int64)
        self.text_begin = np.cumsum(self.text_size) - self.text_size
        if n > 1 << 16:
            raise ValueError("ids of this model need more than 16 bits")


def loaded(path: str) -> PieceModel:
    cache = worker_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = PieceModel(path)
    return cache["pieces", path]


def viterbi(units: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Back pointers of rows of code points of equal length: (piece id, piece length) by end position.

    Id -2, length 1: a character without a piece.
    """
    n, size = units.shape
    piece = np.full((n, size + 1), -1, np.int64)
    width = np.ones((n, size + 1), np.int64)
    begun: list[np.ndarray] = []
    for i in range(1, size + 1):
        begun = [step_hash(h, units[:, i - 1]) for h in begun[-(merges.longest - 1):]]
        begun.append(step_hash(np.zeros(n, np.uint64), units[:, i - 1]))
        keys = seal(np.stack(begun[::-1], axis=1))  # column b: the b + 1 characters that end here
        at = np.minimum(np.searchsorted(merges.piece_keys, keys), len(merges.piece_keys) - 1)
        found = merges.piece_keys[at] == keys
        r, b = np.nonzero(found)
        ids = merges.piece_ids[at[r, b]].astype(np.int64)
        score = np.zeros(found.shape, np.int64)
        score[r, b] = merges.compatible(piece[r, i - 1 - b], ids) * (b + 1)
        best = score.argmax(axis=1)
        rows = np.arange(n)
        hit = score[rows, best] > 0
        piece[:, i] = np.where(hit, merges.piece_ids[at[rows, best]], -2)
        width[:, i] = np.where(hit, best + 1, 1)
    return piece, width


def trace(piece: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, all rows one after the other; number of ids of each row)."""
    n, size = len(piece), piece.shape[1] - 1
    out = np.full((n, size), -1, np.int64)
    at, k, rows = np.full(n, size), size - 1, np.arange(n)
    while len(rows):
        out[rows, k] = piece[rows, at[rows]]
        at[rows] -= width[rows, at[rows]]
        rows, k = rows[at[rows] > 0], k - 1
    real = out != -1
    return out[real], real.sum(axis=1)


class PieceEncoder:
    """Encodes and decodes texts; remembers the units it has seen."""

    def __init__(self, path: str):
        self.model = loaded(path)
        self.units = worker_cache().setdefault(("units", path), WordIds())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts)."""
        ids, counts, a = [np.zeros(0, ID_TYPE)], [np.zeros(0, np.int64)], 0
        sizes = np.cumsum([len(t) + 1 for t in texts])
        while a < len(texts):
            done = sizes[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(sizes, done + BLOCK_CHARS, side="right")))
            some, n = self._block(texts[a:b])
            ids.append(some)
            counts.append(n)
            a = b
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def _block(self, texts):
        if self.units.memo.used > MOST_WORDS:
            self.units.__init__()
        lens = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not lens.sum():
            return np.zeros(0, ID_TYPE), np.zeros(len(texts), np.int64)
        points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        points[points == 32] = BLANK
        offs = np.concatenate([[0], np.cumsum(lens)])
        blank, odd = points == BLANK, ~self.model.known[points]
        cut = np.zeros(len(points) + 1, bool)
        cut[offs] = True
        cut[1:-1] |= (blank[1:] & ~blank[:-1]) | odd[1:] | odd[:-1]
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        uniq, first, inverse = np.unique(word_hashes(points, start, end), return_index=True, return_inverse=True)
        numbers = self.units.memo.get(uniq)
        miss = np.flatnonzero(numbers < 0)
        if len(miss):
            numbers[miss] = self.units.add(*self._fresh(points, start[first[miss]], end[first[miss]]))
            self.units.memo.put(uniq[miss], numbers[miss])
        number = numbers[inverse]
        size = self.units.size[number].astype(np.int64)
        ids = self.units.ids[spread(self.units.begin[number], size)]
        owner = np.searchsorted(offs, start, side="right") - 1
        return ids, np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)

    def _fresh(self, points, start, end):
        """(ids, number of ids) of units, in order."""
        lens = end - start
        sizes = np.zeros(len(start), np.int64)
        rows_of, ids_of = [], []
        for length in np.unique(lens):
            every = np.flatnonzero(lens == length)
            step = max(1, LOCKSTEP // (int(length) * self.model.merges.longest))
            for k in range(0, len(every), step):
                rows = every[k:k + step]
                units = points[start[rows][:, None] + np.arange(length)].astype(np.int64)
                ids, n = trace(*viterbi(units, self.model.merges))
                if length == 1 and (ids == -2).any():  # a character without a piece: its bytes
                    made = [[int(i)] if i >= 0 else self.model.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]
                            .tolist() for i, c in zip(ids, units[:, 0], strict=True)]
                    n = np.array([len(m) for m in made])
                    ids = np.array([i for m in made for i in m], np.int64)
                sizes[rows] = n
                rows_of.append(np.repeat(rows, n))
                ids_of.append(ids)
        order = np.argsort(np.concatenate(rows_of), kind="stable")
        return np.concatenate(ids_of)[order].astype(ID_TYPE), sizes

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The text of each run of ids as UTF-8, without the blank in front."""
        m = self.model
        size = m.text_size[ids]
        raw = m.text[spread(m.text_begin[ids], size)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(size)])[offs]
        out = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [t[1:] if t[:1] == b" " else t for t in out]


def _encode(path, keep):
    def run(batches):
        encoder = PieceEncoder(path)
        for batch in small_batches(batches, len(keep)):
            texts = ["" if t is None else t for t in batch.column(batch.num_columns - 1).to_pylist()]
            ids, offs = encoder.encode(texts)
            wide = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([wide[4 * a:4 * b] for a, b in zip(offs[:-1], offs[1:], strict=True)],
                                               pa.binary())], [*keep, "ids"])
    return run


def _decode(path, keep):
    def run(batches):
        encoder = PieceEncoder(path)
        for batch in batches:
            rows = [np.frombuffer(b or b"", "<u4") for b in batch.column(batch.num_columns - 1).to_pylist()]
            offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            texts = encoder.decode(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), offs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                [*keep, "decoded"])
    return run


def _mapped(df: DataFrame, make, source: str, name: str, kind) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"the table already has a column named {name!r}")
    inner = [f"c{k}" for k in range(len(df.columns))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(inner, df.schema.fields, strict=True)]
    out = (df.select(*(col(c).alias(n) for n, c in zip(inner, df.columns, strict=True)), col(source).alias("source"))
           .mapInArrow(make(inner), T.StructType([*fields, T.StructField("made", kind)])))
    return out.select(*(F.col(n).alias(c) for n, c in zip(inner, df.columns, strict=True)), F.col("made").alias(name))


def encode_pieces(df: DataFrame, path: str | None = None, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the ids of every whole text (little-endian unsigned 32-bit). Null and empty texts: no ids.

    A narrow operator; ``name`` must be free (ValueError).
    """
    path = path or vocabulary_path(MODEL)
    return _mapped(df, lambda keep: _map_as(_encode(path, keep), "ids"), text_col, name, T.BinaryType())


def decode_pieces(df: DataFrame, path: str | None = None, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids of each row; null or no ids: the empty text."""
    path = path or vocabulary_path(MODEL)
    return _mapped(df, lambda keep: _map_as(_decode(path, keep), "decoded"), ids_col, name, T.StringType())


def _map_as(run, made):
    def named(batches):
        for batch in run(batches):
            yield batch.rename_columns(["made" if n == made else n for n in batch.schema.names])
    return named


def _digest(path):
    names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "round_trip"]

    def run(batches):
        encoder = PieceEncoder(path)
        byte = np.zeros(1 << 16, bool)
        byte[encoder.model.byte_ids] = True
        for batch in small_batches(batches, 1):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            ids, offs = encoder.encode(texts)
            wide, fell = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(byte[ids])])
            back = encoder.decode(ids.astype(np.int64), offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(offs)), pa.array(np.diff(fell[offs])),
                 pa.array([zlib.crc32(wide[4 * a:4 * b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                 pa.array([t == s.encode("utf-8") for t, s in zip(back, texts, strict=True)])], names)
    return run


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, round_trip of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(_digest(vocabulary_path(MODEL)), "doc_id long, n_pieces long, n_byte_pieces long, "
                           "ids_crc32 long, decoded_sha256 string, round_trip boolean")
