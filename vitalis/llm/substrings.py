"""Operator 1 - substring deduplication by difference-cover anchors.

A window is ``WINDOW`` (13) consecutive words. Word positions that are 0, 1 or
3 modulo 7 are *cover* positions: these residues are a perfect difference
cover, so for any two positions i and j there is a shift below 7 that carries
both to cover positions at once. Hence two equal 13-word windows, wherever they
lie, contain an equal 7-word anchor that starts at a cover position of both.
Only 3/7 of the positions are hashed and shuffled; an anchor that no second
document has rules out all windows around it. Around the shared anchors the
match is extended to whole 13-word windows, which are compared by 96 bits of
hash and by the smallest document that has them.

Work is done per *chunk* (a few MB of documents, dealt by content hash). A
chunk sends each distinct anchor once, as sorted keys packed into one binary
per bucket, and gets one bit per key back; the same then holds for windows
with the smallest doc_id. So a passage that a third of all documents repeat is
one key per chunk, never a group of rows. The dealt documents are one shuffle
that all three passes over the text read (a reused exchange).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import col
from vitalis.llm.layout import chunk_of, chunks_for, fresh_names, measured, power_bits, shuffle_partitions
from vitalis.llm.textkit import (
    blocks, bucket_edges, pack_high, prefix_hash, span_hash, text_buffer, unpack_high,
    window_hash, window_room, word_spans,
)

WINDOW = 13
# A perfect difference cover modulo 7.
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
KEY_BYTES = 6
LAST = np.int64(2**63 - 1)


def anchor_mask(word_offs: np.ndarray) -> np.ndarray:
    """Cover positions, counted from each document's first word, that have room for an anchor."""
    total = int(word_offs[-1])
    local = np.arange(total) - np.repeat(word_offs[:-1], np.diff(word_offs))
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    return cover[local % PERIOD] & window_room(word_offs, ANCHOR)


class Chunk:
    """Word hashes of a chunk's documents, in (doc_id, text) order."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str):
        self.table = table
        ids = table[id_col].combine_chunks().cast(pa.int64())
        self.ids = ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        self.buf, self.offs = text_buffer(table[text_col])
        words, self.starts, self.ends = [], [], []
        self.word_offs = np.zeros(len(self.offs), np.int64)
        done = 0
        for a, b in blocks(self.offs):
            lo, hi = self.offs[a], self.offs[b]
            part = self.buf[lo:hi]
            s, e, wo = word_spans(part, self.offs[a:b + 1] - lo)
            words.append(span_hash(prefix_hash(part), s, e))
            self.starts.append(s + lo)
            self.ends.append(e + lo)
            self.word_offs[a:b + 1] = wo + done
            done += len(s)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.starts = np.concatenate(self.starts) if self.starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(self.ends) if self.ends else np.zeros(0, np.int64)
        self.doc_of_word = np.repeat(self.ids, np.diff(self.word_offs))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys): the anchors' word positions and truncated hashes."""
        at = np.flatnonzero(anchor_mask(self.word_offs))
        if not len(at):
            return at, np.zeros(0, np.uint64)
        low = np.uint64(8 * (8 - KEY_BYTES))
        return at, (window_hash(self.words, ANCHOR, 0x8CB92BA72F3D8DD7)[at] >> low) << low

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Positions of the 13-word windows that hold one of the shared anchors (given by word position)."""
        total = len(self.words)
        edge = np.zeros(total + 1, np.int32)
        np.add.at(edge, np.maximum(shared - PERIOD + 1, 0), 1)
        np.add.at(edge, shared + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & window_room(self.word_offs, WINDOW)) if total else shared

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the windows that start at these word positions."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        high = window_hash(self.words, WINDOW, 0x8CB92BA72F3D8DD7)[at]
        low = (window_hash(self.words, WINDOW, 0xE7037ED1A0B428DB)[at] >> np.uint64(32)).astype(np.uint32)
        return high, low


def distinct_windows(high, low, docs):
    """(order, group of each ordered row, first row of each group), groups sorted by hash, then document."""
    order = np.lexsort((docs, low, high))
    h, w = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unbits(parts: list[tuple[int, bytes, int]]) -> np.ndarray:
    """Flags of all buckets, in bucket order, from (bucket, bits, count)."""
    out = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, b, n in sorted(parts)]
    return np.concatenate(out) if out else np.zeros(0, bool)


def _sorted_chunk(table: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """The chunk in an order that does not depend on how the shuffle delivered it."""
    return table.sort_by([(id_col, "ascending"), (text_col, "ascending")])


SEND = "bucket long, cid long, n long, keys binary, low binary, docs binary"
REPLY = "cid long, bucket long, n long, bits binary"
SEND_ARROW = pa.schema([("bucket", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()),
                        ("keys", pa.binary()), ("low", pa.binary()), ("docs", pa.binary())])
REPLY_ARROW = pa.schema([("cid", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])


def _send_anchors(names, bits):
    id_col, text_col, cid_col = names

    def run(table: pa.Table) -> pa.Table:
        cid = table[cid_col][0].as_py()
        chunk = Chunk(_sorted_chunk(table, id_col, text_col), id_col, text_col)
        at, keys = chunk.anchors()
        docs = chunk.doc_of_word[at]
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        several = np.zeros(len(first), bool)
        if len(first):  # positions ascend within a key, hence documents too: first and last tell
            last = np.append(first[1:], len(keys)) - 1
            several = docs[first] != docs[last]
        keys = keys[first]
        edges, rows = bucket_edges(keys, bits), []
        for b in range(1 << bits):
            lo, hi = edges[b], edges[b + 1]
            if hi > lo:
                rows.append({"bucket": b, "cid": cid, "n": int(hi - lo), "keys": pack_high(keys[lo:hi], KEY_BYTES),
                             "low": _bits(several[lo:hi]), "docs": b""})
        return pa.Table.from_pylist(rows, SEND_ARROW)
    return run


def _find_shared(table: pa.Table) -> pa.Table:
    """In one bucket: which anchors of each chunk lie in two documents or more."""
    rows = sorted(table.to_pylist(), key=lambda r: r["cid"])
    keys = np.concatenate([unpack_high(r["keys"], KEY_BYTES) for r in rows])
    own = np.concatenate([np.unpackbits(np.frombuffer(r["low"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    shared = own.copy()
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    # a key that one chunk alone holds, in two of its documents, is that chunk's own matter: `own`
    at, out = 0, []
    for r in rows:
        out.append({"cid": r["cid"], "bucket": r["bucket"], "n": r["n"], "bits": _bits(shared[at:at + r["n"]])})
        at += r["n"]
    return pa.Table.from_pylist(out, REPLY_ARROW)


def _send_windows(names, bits):
    id_col, text_col, cid_col = names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SEND_ARROW.empty_table()
        cid = left[cid_col][0].as_py()
        chunk = Chunk(_sorted_chunk(left, id_col, text_col), id_col, text_col)
        at, keys = chunk.anchors()
        if not len(at):
            return SEND_ARROW.empty_table()
        uniq, inverse = np.unique(keys, return_inverse=True)
        flags = _unbits([(r["bucket"], r["bits"], r["n"]) for r in right.to_pylist()])
        assert len(flags) == len(uniq)
        start = chunk.candidates(at[flags[inverse]])
        mine = np.zeros(len(chunk.words), bool)
        mine[start] = True
        # the chunk's own note of its candidates comes back with the replies
        rows = [{"bucket": -1 - cid, "cid": cid, "n": len(mine), "keys": b"", "low": _bits(mine), "docs": b""}]
        high, low = chunk.windows(start)
        docs = chunk.doc_of_word[start]
        order, _, first = distinct_windows(high, low, docs)
        pick = order[first]
        high, low, docs = high[pick], low[pick], docs[pick]
        edges = bucket_edges(high, bits)
        wide = docs.dtype if len(docs) and docs.max() > 0xFFFFFFFF or (len(docs) and docs.min() < 0) else np.uint32
        for b in range(1 << bits):
            lo, hi = edges[b], edges[b + 1]
            if hi > lo:
                rows.append({"bucket": b, "cid": cid, "n": int(hi - lo), "keys": high[lo:hi].tobytes(),
                             "low": low[lo:hi].tobytes(), "docs": docs[lo:hi].astype(wide).tobytes()})
        return pa.Table.from_pylist(rows, SEND_ARROW)
    return run


def _find_earlier(table: pa.Table) -> pa.Table:
    """In one bucket: which windows of each chunk start in a document before all of the chunk's own that have it."""
    rows = sorted(table.to_pylist(), key=lambda r: r["cid"])
    if rows[0]["bucket"] < 0:
        return pa.Table.from_pylist([{"cid": r["cid"], "bucket": -1, "n": r["n"], "bits": r["low"]} for r in rows],
                                    REPLY_ARROW)
    high = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
    low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
    docs = np.concatenate([np.frombuffer(r["docs"], np.int64 if len(r["docs"]) == 8 * r["n"] else np.uint32)
                           .astype(np.int64) for r in rows])
    order, group, first = distinct_windows(high, low, docs)
    earlier = np.zeros(len(docs), bool)
    earlier[order] = docs[order] > docs[order[first]][group]
    at, out = 0, []
    for r in rows:
        out.append({"cid": r["cid"], "bucket": r["bucket"], "n": r["n"], "bits": _bits(earlier[at:at + r["n"]])})
        at += r["n"]
    return pa.Table.from_pylist(out, REPLY_ARROW)


def removed_words(chunk: Chunk, start: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Flag of each word of the chunk that a repeated window covers."""
    total = len(chunk.words)
    if not len(start):
        return np.zeros(total, bool)
    high, low = chunk.windows(start)
    docs = chunk.doc_of_word[start]
    order, group, first = distinct_windows(high, low, docs)
    own_first = docs[order[first]]
    repeat = np.zeros(len(start), bool)
    repeat[order] = earlier[group] | (docs[order] > own_first[group])
    edge = np.zeros(total + 1, np.int32)
    at = start[repeat]
    edge[at] += 1
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(names, out_names):
    id_col, text_col, cid_col = names
    words_name, removed_name, sha_name = out_names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = [f for f in left.schema if f.name != cid_col] + [
            pa.field(words_name, pa.int64()), pa.field(removed_name, pa.int64()), pa.field(sha_name, pa.string())]
        if not left.num_rows:
            return pa.schema(fields).empty_table()
        chunk = Chunk(_sorted_chunk(left, id_col, text_col), id_col, text_col)
        replies = right.to_pylist()
        start = np.flatnonzero(_unbits([(0, r["bits"], r["n"]) for r in replies if r["bucket"] < 0]))
        gone = removed_words(chunk, start, _unbits([(r["bucket"], r["bits"], r["n"])
                                                    for r in replies if r["bucket"] >= 0]))
        total = np.concatenate([[0], np.cumsum(gone)])
        n_removed = total[chunk.word_offs[1:]] - total[chunk.word_offs[:-1]]
        # a removed word goes with the white space behind it: up to the next word or the document's end
        after = np.append(chunk.starts[1:], len(chunk.buf))
        ends = np.repeat(chunk.offs[1:], np.diff(chunk.word_offs))
        step = np.zeros(len(chunk.buf) + 1, np.int32)
        np.add.at(step, chunk.starts[gone], 1)
        np.add.at(step, np.minimum(after, ends)[gone], -1)
        keep = np.cumsum(step[:-1]) == 0
        sizes = np.concatenate([[0], np.cumsum(keep)])[chunk.offs]
        kept, raw = chunk.buf[keep].tobytes(), chunk.table[text_col].combine_chunks()
        parts = [kept[sizes[d]:sizes[d + 1]] for d in range(len(chunk.ids))]
        texts = [None if null else part.decode("utf-8")
                 for part, null in zip(parts, raw.is_null().to_pylist(), strict=True)]
        made = {text_col: texts, words_name: np.diff(chunk.word_offs), removed_name: n_removed,
                sha_name: [hashlib.sha256(b" ".join(part.split())).hexdigest() for part in parts]}
        return pa.Table.from_arrays(
            [pa.array(made[f.name], f.type) if f.name in made else chunk.table[f.name] for f in fields],
            schema=pa.schema(fields))
    return run


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     n_words: str = "n_words", n_removed: str = "n_removed",
                     kept_sha256: str = "kept_sha256") -> DataFrame:
    """Cut every word that lies in a 13-word window which also starts in a document with a smaller id.

    Returns the table's columns, ``text_col`` cut (a word goes with the white
    space behind it; a text that loses nothing is unchanged), with the number of
    words, of removed words, and the SHA-256 of the kept words joined by one
    space. Windows are judged on the input texts.

    * null text: no words, stays null; empty text: no words
    * null id: counts as larger than every other id; such rows do not cut each other
    * repeated rows (same id): they share an id, so they do not cut each other
    * fewer than 13 words: never cut
    * the result columns' names must be free in ``df`` (ValueError otherwise); further columns pass through
    """
    spark = df.sparkSession
    clash = {n_words, n_removed, kept_sha256} & set(df.columns)
    if clash:
        raise ValueError(f"the table already has columns named {sorted(clash)}")
    _, total = measured(df, text_col)
    parts = shuffle_partitions(spark)
    chunks = chunks_for(spark, total)
    bits = power_bits(max(2 * parts, total >> 23))
    (cid,) = fresh_names(df, "chunk")
    dealt = df.withColumn(cid, chunk_of([col(id_col), col(text_col)], chunks)).repartition(
        max(parts, chunks // 4), col(cid))
    names = (id_col, text_col, cid)
    by_chunk = dealt.groupBy(col(cid))
    shared = (by_chunk.applyInArrow(_send_anchors(names, bits), SEND)
              .groupBy("bucket").applyInArrow(_find_shared, REPLY))
    earlier = (by_chunk.cogroup(shared.groupBy("cid")).applyInArrow(_send_windows(names, bits), SEND)
               .groupBy("bucket").applyInArrow(_find_earlier, REPLY))
    fields = [f for f in df.schema.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]
                          + [T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType()),
                             T.StructField(kept_sha256, T.StringType())])
    return by_chunk.cogroup(earlier.groupBy("cid")).applyInArrow(
        _cut(names, (n_words, n_removed, kept_sha256)), schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
