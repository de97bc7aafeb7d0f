"""Operator 10 - token-id matrices by best-fit-decreasing packing.

Documents are dealt into chunks of a few MB by content hash. In a chunk every
document becomes ids followed by END_ID; one that is longer than a row is split
losslessly into full rows and a rest. Pieces are placed longest first, each
into the open row with the least room that still holds it. That row is found by
descending a segment tree over room sizes (0 to the row length), whose nodes
say whether any open row below them has that much room. A chunk leaves a few
rows unfilled at most, so what is lost does not grow with the input.

A row of the result is one sequence: its ids, filled up with PAD_ID, the
cumulative lengths of its segments, and the document and start of each. Where
positions start again is the cumulative lengths but the last.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import col
from vitalis.llm.layout import chunk_of, chunks_for, measured, shuffle_partitions
from vitalis.llm.tokenids import ID_TYPE, IdEncoder
from vitalis.llm.tokens import vocabulary_path
from vitalis.session import checkpoint_dir

ROW = 2048
END_ID = 1
PAD_ID = 0
CHUNK_BYTES = 8 << 20


class RoomTree:
    """Counts of open rows by room, with the smallest sufficient room found in log time."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def smallest(self, need: int) -> int:
        """The smallest room of at least ``need`` that some row has, or -1."""
        at = self.leaves + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:  # a left child whose sibling has rows: all of them larger
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """The pieces of each row; every piece is at most ``row`` long."""
    tree, rows, by_room = RoomTree(row), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.smallest(sizes[i])
        if room < 0:
            rows.append([])
            k, room = len(rows) - 1, row
        else:
            k = by_room[room].pop()
            tree.change(room, -1)
        rows[k].append(i)
        left = room - sizes[i]
        if left:
            by_room.setdefault(left, []).append(k)
            tree.change(left, 1)
    return rows


PACKED = ("sequence_id long, n_tokens long, ids binary, cu_seqlens array<int>, doc_ids array<long>, "
          "starts array<long>, resets binary")
PACKED_ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                          ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
                          ("starts", pa.list_(pa.int64())), ("resets", pa.binary())])


def reset_bits(cu_seqlens: list[int], row: int) -> bytes:
    """One bit for each place, the lowest first: set where positions begin anew (every segment, and the filling)."""
    flags = np.zeros(row, bool)
    flags[[c for c in cu_seqlens if c < row]] = True
    return np.packbits(flags, bitorder="little").tobytes()


def positions(resets: bytes, row: int) -> np.ndarray:
    """The position of every place of a row from its reset bits."""
    flags = np.unpackbits(np.frombuffer(resets, np.uint8), count=row, bitorder="little")
    places = np.arange(row)
    return places - np.maximum.accumulate(np.where(flags == 1, places, 0))


def _pack(path, row):
    def run(table: pa.Table) -> pa.Table:
        cid = table["chunk"][0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        doc_ids = table["doc_id"].to_pylist()
        ids, offs = IdEncoder(path)(["" if t is None else t for t in table["text"].to_pylist()])
        pieces = []  # (document, start, length with the end id)
        for d in range(len(doc_ids)):
            total = int(offs[d + 1] - offs[d]) + 1
            pieces += [(d, s, min(row, total - s)) for s in range(0, total, row)]
        rows = best_fit_decreasing([p[2] for p in pieces], row)
        out = {name: [] for name in PACKED_ARROW.names}
        for k, members in enumerate(rows):
            matrix, at, cuts = np.full(row, PAD_ID, ID_TYPE), 0, [0]
            for i in members:
                d, s, size = pieces[i]
                own = ids[offs[d] + s:min(offs[d] + s + size, offs[d + 1])]
                matrix[at:at + len(own)] = own
                if len(own) < size:
                    matrix[at + len(own)] = END_ID
                at += size
                cuts.append(at)
            out["sequence_id"].append((cid << 32) + k)
            out["n_tokens"].append(at)
            out["ids"].append(matrix.tobytes())
            out["cu_seqlens"].append(cuts)
            out["doc_ids"].append([doc_ids[pieces[i][0]] for i in members])
            out["starts"].append([pieces[i][1] for i in members])
            out["resets"].append(reset_bits(cuts, row))
        return pa.Table.from_pydict(out, PACKED_ARROW)
    return run


def pack_matrices(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                  row: int = ROW) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (``row`` little-endian unsigned 16-bit ids),
    cu_seqlens, doc_ids, starts, resets (a bit for each place; see ``positions``).

    * null and empty texts: one id, END_ID
    * null id: packed, with a null in doc_ids
    * repeated rows: packed as often as they occur
    * an empty table gives no sequences; other columns are not read
    """
    spark = df.sparkSession
    _, total = measured(df, text_col)
    chunks = chunks_for(spark, total, CHUNK_BYTES)
    docs = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return (docs.withColumn("chunk", chunk_of([F.col("doc_id"), F.col("text")], chunks))
            .repartition(max(shuffle_partitions(spark), chunks // 2), "chunk").groupBy("chunk")
            .applyInArrow(_pack(path or vocabulary_path(), row), PACKED))


def write_packed(df: DataFrame, folder: str, **options) -> DataFrame:
    """Write the packed sequences of ``df`` as Parquet and read them again."""
    pack_matrices(df, **options).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def position_ids(cu_seqlens: np.ndarray, row: int = ROW) -> np.ndarray:
    """Positions of a sequence: from 0 in every segment and in the filling."""
    starts = np.unique(cu_seqlens[cu_seqlens < row])
    return np.arange(row) - np.repeat(starts, np.diff(np.append(starts, row)))


def _digest(batches):
    for batch in batches:
        rows = batch.to_pydict()
        crc = [zlib.crc32(np.frombuffer(ids, ID_TYPE)[:n].astype("<u4").tobytes())
               for ids, n in zip(rows["ids"], rows["n_tokens"], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("sequence_id"), batch.column("n_tokens"), pa.array(crc, pa.int64()),
             batch.column("cu_seqlens"), batch.column("doc_ids"), batch.column("starts"),
             pa.array([zlib.crc32(r) for r in rows["resets"]], pa.int64())],
            ["sequence_id", "n_tokens", "ids_crc32", "cu_seqlens", "doc_ids", "starts", "resets_crc32"])


def op10_token_matrices(spark, sf_dir: str) -> DataFrame:
    """sequence_id, n_tokens, ids_crc32, cu_seqlens, doc_ids, starts, resets_crc32 of every written sequence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    return write_packed(docs, folder).mapInArrow(
        _digest, "sequence_id long, n_tokens long, ids_crc32 long, cu_seqlens array<int>, doc_ids array<long>, "
                 "starts array<long>, resets_crc32 long")
