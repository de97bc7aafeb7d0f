"""Operator 4 - MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct 5-word shingles (54-bit hashes). Its signature
has 70 symbols: 16 bits of the minimum under each of 70 hash orders, so the
Hamming distance of two signatures (in symbols) measures 1 - Jaccard. The
signature is split into 14 chunks of 5 symbols. By pigeonhole, two signatures
at distance 27 or less agree in all but one symbol of some chunk; every chunk
is therefore indexed under each of its 5 one-symbol-masked keys, which
enumerates exactly the chunks within one error. All pairs up to distance 27
share a key, and a pair at Jaccard 0.75 (mean distance 17.5) is missed with
probability (1 - 0.75^5 - 5*0.25*0.75^4)^14, below 1e-6.

Documents with equal sets form a class and are represented by their smallest
id. No group is expanded into all its pairs. In the first round each key's
members meet only the key's smallest member (a star). With the components these
links make, only keys with members of several components can still hide a
link; their documents go to a second round, an exact prefix join: each set is
ordered by rarity, two sets at the threshold must share an element among the
rarest quarter of the larger and seventh of the smaller one, and the places of
that element bound their overlap. Near-copies of one text that are too far apart
to be linked differ in rare shingles, so they mostly never meet. Every
candidate of either round is confirmed on the full sets.

The sets of the candidates' documents are cut from the texts where these lie:
a Bloom filter of the wanted ids (at most 8 MB) goes to the tasks, so texts are
never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import col
from vitalis.llm.components import connected_components
from vitalis.llm.layout import chunk_of, power_bits, shuffle_partitions, written
from vitalis.llm.textkit import (
    blocks, bucket_edges, lower_ascii, mix, prefix_hash, span_hash, text_buffer, window_hash, word_spans,
)

SHINGLE = 5
THRESHOLD = 75
CHUNKS = 14
SYMBOLS = 5
SIGNATURE = CHUNKS * SYMBOLS
# A pair at the threshold differs in more symbols than this with probability below 1e-6.
MOST_DIFFERENT = 36
SET_BITS = 54
BLOCK_DOCS = 1 << (64 - SET_BITS)
REPS_PER_CHUNK = 4096


def shingles(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of a block of at most BLOCK_DOCS texts: distinct, ordered by both."""
    buf = lower_ascii(buf)
    start, end, wo = word_spans(buf, offs)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = span_hash(prefix_hash(buf), start, end)
    lens = np.diff(wo)
    doc = np.repeat(np.arange(len(lens)), lens)
    room = np.arange(len(words)) + size <= wo[1:][doc]
    hashed = np.zeros(len(words), np.uint64)
    n = len(words) - size + 1
    if n > 0:
        hashed[:n] = window_hash(words, size, 0x8CB92BA72F3D8DD7)
    for d in np.flatnonzero((lens > 0) & (lens < size)):
        w = words[wo[d]:wo[d + 1]]
        hashed[wo[d]] = window_hash(w, len(w), 0xE7037ED1A0B428DB)[0]
        room[wo[d]] = True
    low = np.uint64((1 << SET_BITS) - 1)
    key = (doc[room].astype(np.uint64) << np.uint64(SET_BITS)) | (hashed[room] & low)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> np.uint64(SET_BITS)).astype(np.int64), key & low


def doc_blocks(offs: np.ndarray):
    for a, b in blocks(offs):
        for c in range(a, b, BLOCK_DOCS):
            yield c, min(b, c + BLOCK_DOCS)


def _orders() -> np.ndarray:
    return mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of SIGNATURE 16-bit symbols per run of hashes."""
    out = np.empty((len(first), SIGNATURE), np.uint16)
    for k, a in enumerate(_orders()):
        least = np.minimum.reduceat(hashes * a, first)
        out[:, k] = (mix(least ^ np.uint64(k)) >> np.uint64(48)).astype(np.uint16)
    return out


SKETCH = "id long, n_shingles long, set_key binary, signature binary"


def _sketch(size):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            buf, offs = text_buffer(batch.column(1))
            counts = np.zeros(len(ids), np.int64)
            keys, sigs = [None] * len(ids), [None] * len(ids)
            for a, b in doc_blocks(offs):
                lo, hi = offs[a], offs[b]
                doc, h = shingles(buf[lo:hi], offs[a:b + 1] - lo, size)
                if not len(doc):
                    continue
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                own = doc[first]
                n = np.diff(np.append(first, len(doc)))
                counts[a + own] = n
                one = np.add.reduceat(mix(h), first)
                two = np.add.reduceat(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), first)
                sig = signatures(h, first)
                for i, d in enumerate(own):
                    keys[a + d] = one[i].tobytes() + two[i].tobytes()
                    sigs[a + d] = sig[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["id", "n_shingles", "set_key", "signature"])
    return run


def _marks(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions of each id."""
    h = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.stack([(h >> np.uint64(64 - bits)), (mix(h) >> np.uint64(64 - bits))]).astype(np.int64)


def _mark(bits):
    def run(batches):
        found = np.zeros(1 << bits, bool)
        for batch in batches:
            found[_marks(batch.column(0).to_numpy(), bits)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([0]), pa.array([np.packbits(found).tobytes()], pa.binary())], ["slot", "marks"])
    return run


def _either(table: pa.Table) -> pa.Table:
    out = None
    for b in table["marks"]:
        one = np.frombuffer(b.as_buffer(), np.uint8)
        out = one.copy() if out is None else out | one
    return pa.Table.from_arrays([table["slot"].combine_chunks()[:1], pa.array([out.tobytes()], pa.binary())],
                                ["slot", "marks"])


FILTER_BITS = 26  # 8 MB; beyond, more ids pass that nobody asked for, and the joins drop them


def id_filter(ids: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of a table of distinct ids: (bits, log2 of their number)."""
    bits = min(FILTER_BITS, max(13, power_bits(16 * ids.count())))
    kind = "slot long, marks binary"
    some = (ids.coalesce(64).mapInArrow(_mark(bits), kind)
            .withColumn("slot", F.pmod(F.xxhash64("marks"), F.lit(8))).groupBy("slot").applyInArrow(_either, kind)
            .withColumn("slot", F.lit(0).cast("long")).groupBy("slot").applyInArrow(_either, kind).collect())
    return (bytes(some[0]["marks"]) if some else bytes(1 << (bits - 3))), bits


def _sets(size, marks, bits):
    """The shingles of the documents whose id passes the filter, as sorted 64-bit integers."""
    def run(batches):
        held = np.unpackbits(np.frombuffer(marks, np.uint8)).astype(bool)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(held[_marks(ids, bits)].all(axis=0))
            buf, offs = text_buffer(batch.column(1).take(pa.array(rows)))
            out = [b""] * len(rows)
            for a, b in doc_blocks(offs):
                lo, hi = offs[a], offs[b]
                doc, h = shingles(buf[lo:hi], offs[a:b + 1] - lo, size)
                edge = np.searchsorted(doc, np.arange(b - a + 1))
                for d in range(b - a):
                    out[a + d] = h[edge[d]:edge[d + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(out, pa.binary())], ["id", "items"])
    return run


RARITY_BITS = 20


def _prefixes(rarity, threshold):
    """The rarest shingles of each set: as many as a partner at the threshold cannot all miss."""
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, comp, b in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2),
                                    strict=True):
                items = np.frombuffer(b.as_buffer(), np.uint64)
                n = len(items)
                length = n - -(-threshold * n // 100) + 1
                order = np.lexsort((items, rarity[items.astype(np.int64) >> (SET_BITS - RARITY_BITS)]))[:length]
                out[0].append(items[order].astype(np.int64))
                for k, value in enumerate((doc, comp, n)):
                    out[k + 1].append(np.full(length, value))
                out[4].append(np.arange(length))
            cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).cast(pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(cols, ["item", "id", "comp", "n", "pos"])
    return run


def _across(placed: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the threshold. ``placed``: id, comp, items."""
    counts = np.zeros(1 << RARITY_BITS, np.int32)
    cells = (placed.select("items").mapInArrow(_counted_in_slices, "slot long, counts binary")
             .groupBy("slot").applyInArrow(_summed, "slot long, counts binary").collect())
    width = (1 << RARITY_BITS) // RARITY_SLICES
    for r in cells:
        counts[r["slot"] * width:(r["slot"] + 1) * width] = np.minimum(
            np.frombuffer(r["counts"], np.int64), 2**31 - 1)
    prefix = written(placed.mapInArrow(_prefixes(counts, threshold),
                                       "item long, id long, comp long, n long, pos long"), "prefixes")
    large = prefix.select("item", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"),
                          F.col("pos").alias("px"))
    small = (prefix.where((100 + threshold) * (F.col("n") - F.col("pos")) >= 2 * threshold * F.col("n"))
             .select("item", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"),
                     F.col("pos").alias("py")))
    return (large.join(small, (large.item == small.item) & (F.col("cx") != F.col("cy"))
                       & ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x"))))
                       & (100 * F.col("ny") >= threshold * F.col("nx"))
                       & ((100 + threshold) * F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
                          >= threshold * (F.col("nx") + F.col("ny"))))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


RARITY_SLICES = 16


def _counted_in_slices(batches):
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for b in batch.column(0):
            at = np.frombuffer(b.as_buffer(), np.uint64).astype(np.int64) >> (SET_BITS - RARITY_BITS)
            np.add.at(counts, at, 1)
    for k, part in enumerate(counts.reshape(RARITY_SLICES, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())],
                                             ["slot", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table["counts"])
    return pa.Table.from_arrays([table["slot"].combine_chunks()[:1], pa.array([total.tobytes()], pa.binary())],
                                ["slot", "counts"])


def masked_keys(sig: np.ndarray) -> np.ndarray:
    """The CHUNKS * SYMBOLS keys of each signature: a chunk's symbols with one of them masked."""
    n = len(sig)
    keys = np.empty((n, CHUNKS * SYMBOLS), np.uint64)
    weights = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for c in range(CHUNKS):
        parts = mix(sig[:, c * SYMBOLS:(c + 1) * SYMBOLS].astype(np.uint64) + np.uint64(1 + (c << 16))) * weights
        whole = parts.sum(axis=1, dtype=np.uint64)
        for m in range(SYMBOLS):
            keys[:, c * SYMBOLS + m] = mix((whole - parts[:, m]) ^ np.uint64(c * SYMBOLS + m + 1))
    return keys


SEND = "bucket long, cid long, n long, keys binary, low binary, high binary"
SEND_ARROW = pa.schema([("bucket", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()),
                        ("keys", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
REPLY_ARROW = pa.schema([("cid", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _chunk_keys(table: pa.Table, value: str):
    """(keys, values, row of each) of a chunk of representatives, ordered by key, then value."""
    sig = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, SIGNATURE)
    keys = masked_keys(sig).reshape(-1)
    row = np.repeat(np.arange(len(sig)), CHUNKS * SYMBOLS)
    values = table[value].to_numpy()[row]
    order = np.lexsort((values, keys))
    return keys[order], values[order], row[order]


def _group_starts(keys: np.ndarray) -> np.ndarray:
    return np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])) if len(low) else np.zeros(0, bool)
    new &= low != high
    return pa.Table.from_arrays([pa.array(low[new]), pa.array(high[new])], schema=PAIR_ARROW)


def _send_stars(bits):
    """A chunk's keys with the smallest id that has each; its own stars go along."""
    def run(table: pa.Table) -> pa.Table:
        cid = table["cid"][0].as_py()
        keys, ids, _ = _chunk_keys(table, "id")
        new = _group_starts(keys)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        own = _distinct_pairs(ids[first][group[~new]], ids[~new])
        rows = [{"bucket": -1 - cid, "cid": cid, "n": own.num_rows, "keys": b"",
                 "low": own["a"].to_numpy().tobytes(), "high": own["b"].to_numpy().tobytes()}]
        keys, ids = keys[first], ids[first]
        edges = bucket_edges(keys, bits)
        for b in range(1 << bits):
            lo, hi = edges[b], edges[b + 1]
            if hi > lo:
                rows.append({"bucket": b, "cid": cid, "n": int(hi - lo), "keys": keys[lo:hi].tobytes(),
                             "low": ids[lo:hi].tobytes(), "high": b""})
        return pa.Table.from_pylist(rows, SEND_ARROW)
    return run


def _stars(table: pa.Table) -> pa.Table:
    """In one bucket: the smallest id of each key, paired with the smallest of every chunk."""
    rows = table.to_pylist()
    low = np.concatenate([np.frombuffer(r["low"], np.int64) for r in rows])
    if rows[0]["bucket"] < 0:
        return _distinct_pairs(low, np.concatenate([np.frombuffer(r["high"], np.int64) for r in rows]))
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
    order = np.lexsort((low, keys))
    keys, ids = keys[order], low[order]
    new = _group_starts(keys)
    group = np.cumsum(new) - 1
    return _distinct_pairs(ids[new][group[~new]], ids[~new])


def _send_spread(bits):
    """A chunk's keys with the smallest and the largest component that has each."""
    def run(table: pa.Table) -> pa.Table:
        cid = table["cid"][0].as_py()
        keys, comps, _ = _chunk_keys(table, "comp")
        first = np.flatnonzero(_group_starts(keys))
        high = comps[np.append(first[1:], len(keys)) - 1]
        keys, low = keys[first], comps[first]
        edges, rows = bucket_edges(keys, bits), []
        for b in range(1 << bits):
            lo, hi = edges[b], edges[b + 1]
            if hi > lo:
                rows.append({"bucket": b, "cid": cid, "n": int(hi - lo), "keys": keys[lo:hi].tobytes(),
                             "low": low[lo:hi].tobytes(), "high": high[lo:hi].tobytes()})
        return pa.Table.from_pylist(rows, SEND_ARROW)
    return run


def _spread(table: pa.Table) -> pa.Table:
    """In one bucket: which of each chunk's keys occur in two components or more."""
    rows = sorted(table.to_pylist(), key=lambda r: r["cid"])
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
    low = np.concatenate([np.frombuffer(r["low"], np.int64) for r in rows])
    high = np.concatenate([np.frombuffer(r["high"], np.int64) for r in rows])
    order = np.argsort(keys, kind="stable")
    new = _group_starts(keys[order])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    mixed = np.empty(len(keys), bool)
    mixed[order] = (np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first))[group]
    at, out = 0, []
    for r in rows:
        out.append({"cid": r["cid"], "bucket": r["bucket"], "n": r["n"],
                    "bits": np.packbits(mixed[at:at + r["n"]]).tobytes()})
        at += r["n"]
    return pa.Table.from_pylist(out, REPLY_ARROW)


def _members(left: pa.Table, right: pa.Table) -> pa.Table:
    """(id, component) of a chunk's documents that have a key which several components share."""
    schema = pa.schema([("id", pa.int64()), ("comp", pa.int64())])
    if not left.num_rows:
        return schema.empty_table()
    keys, _, row = _chunk_keys(left, "comp")
    parts = sorted((r["bucket"], r["bits"], r["n"]) for r in right.to_pylist())
    mixed = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, b, n in parts]).astype(bool)
    row = np.unique(row[mixed[np.cumsum(_group_starts(keys)) - 1]])
    return pa.Table.from_arrays([pa.array(left["id"].to_numpy()[row]), pa.array(left["comp"].to_numpy()[row])],
                                schema=schema)


def _close_signatures(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SIGNATURE) for k in (2, 3))
        keep = (a != b).sum(axis=1) <= MOST_DIFFERENT
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _confirm(threshold):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = np.zeros(batch.num_rows, bool)
            last, mine = None, None
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = x.as_buffer(), y.as_buffer()
                if last is None or x.address != last:
                    mine, last = np.frombuffer(x, np.uint64), x.address
                other = np.frombuffer(y, np.uint64)
                at = np.searchsorted(mine, other)
                same = int((mine[np.minimum(at, len(mine) - 1)] == other).sum())
                keep[i] = 100 * same >= threshold * (len(mine) + len(other) - same)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))
    return run


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The candidate pairs whose full sets are similar enough; sizes and signatures sort out most others first."""
    side = reps.select("id", "n_shingles", "signature")
    near = (pairs.join(side.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"),
                                   F.col("signature").alias("sa")), "a")
            .join(side.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"),
                              F.col("signature").alias("sb")), "b")
            .where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
            .select("a", "b", "sa", "sb").mapInArrow(_close_signatures, "a long, b long"))
    return (near.join(sets.select(F.col("id").alias("a"), F.col("items").alias("xa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("items").alias("xb")), "b")
            .select("a", "b", "xa", "xb").mapInArrow(_confirm(threshold), "a long, b long"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row per row of ``df``.

    Documents are linked when 100 * |A & B| >= threshold * |A | B| over their
    distinct ``size``-word shingles (words as they stand, A-Z lower-cased; a shorter
    text is one shingle). component_id is the smallest id reachable by links.

    * null or empty text, or one without words: empty set, its own component, kept
    * null id: linked with nothing, component null, kept
    * rows that repeat an id are one document: each of them gets its component
    * other columns of ``df`` are not read, so their names cannot clash
    """
    spark = df.sparkSession
    docs = df.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    sketches = written(docs.mapInArrow(_sketch(size), SKETCH), "sketches")
    real = sketches.where("n_shingles > 0 and id is not null")
    reps = written(real.groupBy("set_key", "n_shingles")
                   .agg(F.min("id").alias("id"), F.min("signature").alias("signature")), "representatives")
    parts = shuffle_partitions(spark)
    n_reps = reps.count()
    chunks = max(2 * parts, -(-n_reps // REPS_PER_CHUNK))
    bits = power_bits(max(2 * parts, n_reps * CHUNKS * SYMBOLS >> 20))

    def dealt(table):
        return (table.withColumn("cid", chunk_of([F.col("id")], chunks))
                .repartition(max(parts, chunks // 4), "cid").groupBy("cid"))

    stars = written(dealt(reps).applyInArrow(_send_stars(bits), SEND)
                    .groupBy("bucket").applyInArrow(_stars, "a long, b long").distinct(), "stars")
    wanted = stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct()
    sets = written(docs.where(F.col("id").isNotNull())
                   .mapInArrow(_sets(size, *id_filter(wanted)), "id long, items binary"), "sets")
    links = written(_confirmed(stars, reps, sets, threshold), "star-links")

    # second round: what shares a key but not a component
    comps = connected_components(links)
    labelled = written(reps.join(comps, "id", "left").withColumn("comp", F.coalesce("component_id", "id"))
                       .drop("component_id"), "labelled")
    spread = (dealt(labelled).applyInArrow(_send_spread(bits), SEND)
              .groupBy("bucket").applyInArrow(_spread, "cid long, bucket long, n long, bits binary"))
    members = (dealt(labelled).cogroup(spread.groupBy("cid")).applyInArrow(_members, "id long, comp long").distinct())
    placed = written(members.join(sets, "id").select("id", "comp", "items"), "placed")
    more = _confirmed(_across(placed, threshold), reps, sets, threshold)
    comps = connected_components(links.union(more))

    classes = (reps.join(comps, "id", "left")
               .select("set_key", F.col("n_shingles").alias("n"), F.coalesce("component_id", "id").alias("comp")))
    found = sketches.join(classes, (sketches.set_key == classes.set_key) & (sketches.n_shingles == classes.n)
                          & sketches.id.isNotNull(), "left")
    return found.select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("comp", "id").alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.coalesce("comp", "id"))).alias("kept"))


def keep_one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose document stands for its group of near-duplicates (all columns as they are)."""
    found = near_duplicates(df, id_col, text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("gone")).distinct()
    return df.join(gone, col(id_col) == F.col("gone"), "left_anti")


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
