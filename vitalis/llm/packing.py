"""Operator 9 - packing with lexical retrieval.

Documents become token ids once and are dealt along a lexical order: the key
of a document is the smallest of its words' hashes, scrambled, so documents that
share vocabulary (copies above all) stand side by side, followed by a hash of
the id, so a large group of copies spreads over as many partitions as it needs.
Inside a partition consecutive documents of about ``SHARD_TOKENS`` ids make a
shard with an inverted BM25 index over token ids. The inverse document
frequencies come from all documents (one number per vocabulary entry).

In a shard a seed document opens a window of 2048 ids; the index returns its
best unused neighbours, which fill the window until it is full. The document
that crosses the end is cut, and what is left of it is the next seed. Only a
shard's last window is not full: it is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import col
from vitalis.llm.layout import measured, shuffle_partitions, written
from vitalis.llm.textkit import mix, release, small_batches
from vitalis.llm.tokenids import IdEncoder, ID_TYPE
from vitalis.llm.tokens import vocabulary_path

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1_000_000
PARTITION_BYTES = 64 << 20
K1, B = 1.2, 0.75
IDS = "doc_id long, key long, n long, ids binary"


def _encode(path):
    def run(batches):
        release("bpe", "ids", "unicode", "powers", "bytes", "lower", "solid")
        encoder = IdEncoder(path)
        for batch in small_batches(batches, 1):
            doc_ids = batch.column(0).cast(pa.int64())
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            ids, offs, lows = encoder(texts, with_least=True)
            spread = mix(doc_ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1))
            key = (mix(lows) & np.uint64(0xFFFFFFFF00000000)) | (spread >> np.uint64(32))
            raw = ids.tobytes()
            w = ids.itemsize
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(key.view(np.int64)), pa.array(np.diff(offs)),
                 pa.array([raw[a * w:b * w] for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())],
                ["doc_id", "key", "n", "ids"])
    return run


def _document_frequencies(batches):
    counts = np.zeros(0, np.int64)
    for batch in small_batches(batches, 1, 1 << 20):
        ids = np.frombuffer(b"".join(batch.column(1).to_pylist()), ID_TYPE).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), batch.column(0).to_numpy())
        cell = np.unique((doc << 32) | ids)
        part = np.bincount(cell & 0xFFFFFFFF)
        if len(part) > len(counts):
            part, counts = counts, part
        counts[:len(part)] += part
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["term", "df"])


def inverse_frequencies(encoded: DataFrame) -> np.ndarray:
    """BM25 idf of every token id, from all documents (as many numbers as the vocabulary has ids)."""
    rows = (encoded.select("n", "ids").mapInArrow(_document_frequencies, "term long, df long")
            .groupBy("term").agg(F.sum("df").alias("df")).collect())
    total = encoded.count()
    highest = max((r["term"] for r in rows), default=0)
    idf = np.full(max(END_ID, highest) + 1, np.log1p(2.0 * total + 1))
    for r in rows:
        idf[r["term"]] = np.log1p((total - r["df"] + 0.5) / (r["df"] + 0.5))
    return idf


class Shard:
    """An inverted BM25 index over the documents of a shard, with the used ones marked."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray):
        n = len(docs)
        lens = np.array([len(d) for d in docs])
        doc = np.repeat(np.arange(n, dtype=np.int64), lens)
        cell, tf = np.unique((doc << 32) | np.concatenate(docs).astype(np.int64), return_counts=True)
        doc, term = cell >> 32, cell & 0xFFFFFFFF
        norm = K1 * (1 - B + B * lens / max(1.0, lens.mean()))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        # a seed's query: all of its terms
        self.query_terms, self.query_offs = term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.post = np.searchsorted(term[order], np.arange(int(term.max()) + 2 if len(term) else 1))
        self.n = n
        self.used = np.zeros(n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents by falling score (those without a common term are left out)."""
        terms = self.query_terms[self.query_offs[seed]:self.query_offs[seed + 1]]
        parts = [slice(self.post[t], self.post[t + 1]) for t in terms]
        if not parts:
            return np.zeros(0, np.int64)
        docs = np.concatenate([self.docs[p] for p in parts])
        score = np.bincount(docs, np.concatenate([self.weights[p] for p in parts]), minlength=self.n)
        score[self.used] = 0
        hits = np.flatnonzero(score > 0)
        if len(hits) > 64:  # the window takes few; order the best first and the others only if they are asked for
            top = hits[np.argpartition(-score[hits], 63)[:64]]
            top = top[np.lexsort((top, -score[top]))]
            return top
        return hits[np.lexsort((hits, -score[hits]))]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, window: int = WINDOW):
    """Yields (document, start, length, sequence, offset): every id of every document in one piece."""
    shard = Shard(docs, idf)
    sequence, offset, unused = 0, 0, 0
    seed = start = -1
    queue: list[int] = []
    rest: list[tuple[int, int, int]] = []  # pieces of the window that is being filled
    while True:
        if seed < 0:
            while queue and shard.used[queue[0]]:
                queue.pop(0)
            if not queue and rest:
                queue = shard.neighbours(rest[0][0]).tolist()
            if queue:
                seed = queue.pop(0)
            else:
                while unused < shard.n and shard.used[unused]:
                    unused += 1
                if unused == shard.n:
                    break
                seed = unused
            shard.used[seed], start = True, 0
        take = min(len(docs[seed]) - start, window - offset)
        rest.append((seed, start, take))
        offset += take
        start += take
        if offset == window:
            at = 0
            for doc, begin, size in rest:
                yield doc, begin, size, sequence, at
                at += size
            sequence, offset, rest, queue = sequence + 1, 0, [], []
        if start == len(docs[seed]):
            seed = -1
    # the last window: powers of two, largest first
    left, at, room = offset, 0, 0
    for doc, begin, size in rest:
        while size:
            if not room:
                room, at = 1 << (left.bit_length() - 1), 0
                left -= room
            take = min(size, room)
            yield doc, begin, take, sequence, at
            begin, size, room, at = begin + take, size - take, room - take, at + take
            if not room:
                sequence += 1


def _pack(idf, window):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        release()  # the shards need the room of the encoder's tables
        base, sequences = TaskContext.get().partitionId() << 40, 0

        def shard_out(doc_ids, docs):
            nonlocal sequences
            pieces = list(pack_shard(docs, idf, window))
            out = {k: [] for k in names}
            for doc, begin, size, sequence, at in pieces:
                out["doc_id"].append(doc_ids[doc])
                out["start"].append(begin)
                out["length"].append(size)
                out["ids_crc32"].append(zlib.crc32(docs[doc][begin:begin + size].astype("<u4").tobytes()))
                out["doc_tokens"].append(len(docs[doc]))
                out["sequence_id"].append(base + sequences + sequence)
                out["offset"].append(at)
            sequences += pieces[-1][3] + 1
            return pa.RecordBatch.from_arrays([pa.array(out[k], pa.int64()) for k in names], names)

        ids, docs, total = [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(raw.as_buffer(), ID_TYPE)
                ids.append(doc_id)
                docs.append(np.append(one, ID_TYPE(END_ID)))
                total += len(one) + 1
                if total >= SHARD_TOKENS:
                    yield shard_out(ids, docs)
                    ids, docs, total = [], [], 0
        if docs:
            yield shard_out(ids, docs)
    return run


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_by_retrieval(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the vocabulary file at ``path`` followed by END_ID.

    * null text: empty, its only id is END_ID; so is an empty text
    * null id: packed like any other, with a null doc_id in the result
    * repeated rows: each is packed as a document of its own
    * texts longer than a window: cut, every id in exactly one piece
    * an empty table gives no pieces; further columns are not read
    """
    spark = df.sparkSession
    _, total = measured(df, text_col)
    path = path or vocabulary_path()
    encoded = written(df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
                      .mapInArrow(_encode(path), IDS), "token-ids")
    idf = inverse_frequencies(encoded)
    parts = max(shuffle_partitions(spark), -(-total // PARTITION_BYTES))
    return (encoded.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
            .select("doc_id", "ids").mapInArrow(_pack(idf, window), PIECES))


def op9_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    return pack_by_retrieval(spark.read.parquet(f"{sf_dir}/documents.parquet"))
