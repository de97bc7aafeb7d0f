"""Operator 2 - document fingerprints from improbable features.

A feature is a window of 64 bytes. Its entropy (in 1001 classes) is common or
rare in the corpus: a first pass counts the classes over all texts, and a
feature ranks the higher the rarer its class is. In every run of 64 successive
windows the best-ranked (leftmost) window wins a vote; windows with 16 votes or
more are the text's features. Each sets five bits of a 2048-bit Bloom filter;
160 features fill a filter and the next one is chained to it.

Entropies are rolled over whole batches: what a byte adds to the window's sum of
c*log2(c) depends only on how often it occurs among its 63 predecessors, and
what its leaving takes away only on its 63 successors. Both counts come from 63
shifted comparisons of the byte array.

The likeness of two fingerprints takes each filter of the shorter chain against
its best match in the other: common bits beyond those expected by chance, as
a share of the most there could be, averaged by filled bits.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import col
from vitalis.llm.layout import shuffle_partitions
from vitalis.llm.textkit import blocks, mix, text_buffer

FEATURE = 64
RUN = 64
VOTES = 16
FILTER_BITS = 2048
PER_FILTER = 160
HASHES = 5
CLASSES = 1001
LOWEST_CLASS = 100  # nearly constant windows are never features
SCALE = 1 << 14
STRIP = 1 << 17


def _gain() -> np.ndarray:
    """What one more occurrence adds to c*log2(c), in fixed point."""
    c = np.arange(FEATURE + 1, dtype=np.float64)
    f = np.zeros(FEATURE + 1)
    f[1:] = np.rint(c[1:] * np.log2(c[1:]) * SCALE)
    return np.diff(f).astype(np.int32)


def entropy_classes(buf: np.ndarray) -> np.ndarray:
    """Class (0 to 1000) of the entropy of the 64 bytes from each position on (positions n - 64 and before)."""
    n = len(buf)
    if n < FEATURE:
        return np.zeros(0, np.int16)
    gain = _gain()
    out = np.empty(n - FEATURE + 1, np.int16)
    top = SCALE * FEATURE * 6
    for lo in range(0, len(out), STRIP):
        x = buf[lo:min(n, lo + STRIP + FEATURE - 1)]
        before, after = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
        for d in range(1, FEATURE):
            same = (x[d:] == x[:-d]).view(np.uint8)
            before[d:] += same
            after[:-d] += same
        total = np.cumsum(gain[before], dtype=np.int64)[FEATURE - 1:]
        total[1:] -= np.cumsum(gain[after[:len(total) - 1]], dtype=np.int64)
        out[lo:lo + len(total)] = 1000 - total * 1000 // top
    return out


def _class_counts(batches):
    counts = np.zeros(CLASSES, np.int64)
    for batch in batches:
        buf, offs = text_buffer(batch.column(0))
        for a, b in blocks(offs):
            lo, hi = offs[a], offs[b]
            classes = entropy_classes(buf[lo:hi])
            if len(classes):
                # windows that cross a document's end do not count
                left = np.repeat(offs[a + 1:b + 1], np.diff(offs[a:b + 1]))[:len(classes)] - lo - np.arange(len(classes))
                counts += np.bincount(classes[left >= FEATURE], minlength=CLASSES)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["class", "n"])


def rarity(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy class, 0 the rarest, from the windows of all texts; 1023 for classes never used."""
    rows = (df.select(col(text_col)).mapInArrow(_class_counts, "class long, n long")
            .groupBy("class").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(CLASSES, np.int64)
    for r in rows:
        counts[r["class"]] = r["n"]
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    rank[:LOWEST_CLASS] = 1023
    return rank


def select_features(buf: np.ndarray, offs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, position) of the chosen windows of texts of 64 bytes or more, in order."""
    classes = entropy_classes(buf)
    n = len(classes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, bits = (np.uint32, 22) if n < 1 << 22 else (np.uint64, 40)
    never = kind(1023) << kind(bits)
    valid = np.zeros(n + 1, np.int32)
    long = np.diff(offs) >= FEATURE
    valid[offs[:-1][long]] += 1
    np.add.at(valid, offs[1:][long] - FEATURE + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    pos = np.arange(n, dtype=kind)
    key = np.where(valid, rank.astype(kind)[classes] << kind(bits), never) | pos
    best = key.copy()
    width = 1
    while width < RUN:  # minimum over runs of 2, 4, ... 64 windows; a text's last 63 positions are not valid
        best[:-width] = np.minimum(best[:-width], best[width:])
        width *= 2
    winner = best[valid] & kind((1 << bits) - 1)
    weight = best[valid] >> kind(bits)
    edge = np.flatnonzero(np.append(True, winner[1:] != winner[:-1]))
    votes = np.diff(np.append(edge, len(winner)))
    win = winner[edge].astype(np.int64)
    doc = np.searchsorted(offs, win, side="right") - 1
    fine = (votes >= VOTES) & (weight[edge] < 1023)
    chosen, owner = win[fine], doc[fine]
    # a text in which no window gets the votes is known by its rarest
    bare = np.flatnonzero(long & (np.bincount(owner, minlength=len(long)) == 0))
    if len(bare):
        more = np.array([offs[d] + int(key[offs[d]:offs[d + 1] - FEATURE + 1].argmin()) for d in bare], np.int64)
        chosen, owner = np.concatenate([chosen, more]), np.concatenate([owner, bare])
        order = np.argsort(owner, kind="stable")
        chosen, owner = chosen[order], owner[order]
    return owner, chosen


def _feature_hashes(buf, at):
    windows = np.lib.stride_tricks.sliding_window_view(buf, FEATURE)[at]
    parts = np.ascontiguousarray(windows).view(np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(parts.shape[1]):
        h = mix(h + parts[:, k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return h


def digests(buf: np.ndarray, offs: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text: an array of (filters, 32) 64-bit words; no filter for an empty text."""
    n = len(offs) - 1
    doc, at = select_features(buf, offs, rank)
    h = _feature_hashes(buf, at) if len(at) else np.zeros(0, np.uint64)
    sizes = np.diff(offs)
    short = np.flatnonzero((sizes > 0) & (sizes < FEATURE))
    if len(short):  # the whole text, filled up with zeros, is its feature
        pad = np.zeros((len(short), FEATURE), np.uint8)
        for i, d in enumerate(short):
            pad[i, :sizes[d]] = buf[offs[d]:offs[d + 1]]
        own = mix(_feature_hashes(pad.reshape(-1), np.arange(len(short)) * FEATURE) + sizes[short].astype(np.uint64))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, own])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    # a feature that a text repeats counts once, at its first place
    order = np.lexsort((np.arange(len(h)), h, doc))
    d, v = doc[order], h[order]
    first = np.append(True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])) if len(order) else np.zeros(0, bool)
    keep = np.sort(order[first])
    doc, h = doc[keep], h[keep]
    begin = np.searchsorted(doc, np.arange(n + 1))
    number = (np.arange(len(doc)) - begin[doc]) // PER_FILTER
    chains = -(-np.diff(begin) // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(chains)])
    bits = np.zeros(int(base[-1]) * FILTER_BITS, bool)
    place = (base[doc] + number) * FILTER_BITS
    for k in range(HASHES):
        bits[place + ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    words = np.packbits(bits).view(np.uint64).reshape(-1, FILTER_BITS // 64)
    return [words[base[i]:base[i + 1]] for i in range(n)]


def as_text(chain: np.ndarray) -> str:
    """The fingerprint as text: the number of filters and their bits in base 64."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint64).reshape(-1, FILTER_BITS // 64)


def _pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised overlap of filters (broadcasting)."""
    fa, fb = (np.bitwise_count(x).sum(axis=-1).astype(np.float64) for x in (a, b))
    both = np.bitwise_count(a & b).sum(axis=-1).astype(np.float64)
    chance, most = fa * fb / FILTER_BITS, np.minimum(fa, fb)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (both - chance) / (most - chance)
    return np.clip(np.where(most > chance, score, (both >= most).astype(float)), 0.0, 1.0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; equal fingerprints: 1; one empty and one not: 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    best = _pair_scores(a[:, None, :], b[None, :, :]).max(axis=1)
    weight = np.bitwise_count(a).sum(axis=1).astype(np.float64)
    return float((best * weight).sum() / weight.sum())


def likenesses(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Row by row; chains of one filter, the most frequent, are compared all at once."""
    out = np.zeros(len(left))
    single = np.array([len(a) == 1 and len(b) == 1 for a, b in zip(left, right, strict=True)], bool)
    one = np.flatnonzero(single)
    if len(one):
        out[one] = _pair_scores(np.concatenate([left[i] for i in one]), np.concatenate([right[i] for i in one]))
    for i in np.flatnonzero(~single):
        out[i] = likeness(left[i], right[i])
    return out


def _of_texts(texts: list[bytes], rank) -> list[np.ndarray]:
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for a, b in blocks(offs):
        out += digests(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a], rank)
    return out


def fingerprint_documents(df: DataFrame, rank: np.ndarray, text_col: str = "text",
                          name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of every whole text (null counts as empty). A narrow operator."""
    if name in df.columns:
        raise ValueError(f"the table already has a column named {name!r}")
    inner = [f"c{k}" for k in range(len(df.columns))]

    def run(batches):
        for batch in batches:
            texts = [b"" if t is None else t.encode("utf-8") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([as_text(c) for c in _of_texts(texts, rank)], pa.string())],
                [*inner, "made"])

    fields = [T.StructField(n, f.dataType) for n, f in zip(inner, df.schema.fields, strict=True)]
    made = (df.select(*(col(c).alias(n) for n, c in zip(inner, df.columns, strict=True)), col(text_col).alias("t"))
            .mapInArrow(run, T.StructType([*fields, T.StructField("made", T.StringType())])))
    return made.select(*(F.col(n).alias(c) for n, c in zip(inner, df.columns, strict=True)),
                       F.col("made").alias(name))


GROUP_BYTES = 4 << 20


def _edited(rank):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(rows, after: str):
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        following = [*texts[1:], after]
        edited = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(texts, following, strict=True)]
        edited = [t.encode("utf-8", "surrogatepass") for t in edited]
        own = _of_texts([t.encode("utf-8", "surrogatepass") for t in [*texts, after]], rank)
        changed = _of_texts(edited, rank)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
             pa.array([as_text(c) for c in own[:-1]]), pa.array([as_text(c) for c in changed]),
             pa.array(likenesses(own[:-1], changed)), pa.array(likenesses(own[:-1], own[1:]))], names)

    def run(batches):
        group, size, chunk, closed = [], 0, None, False
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            for part, visitor, doc_id, text in zip(*cols, strict=True):
                text = text or ""
                if part != chunk:
                    chunk, closed = part, False
                if closed:
                    continue
                if visitor:  # the row that follows the chunk's last one
                    if group:
                        yield made(group, text)
                    group, size, closed = [], 0, True
                    continue
                if size > GROUP_BYTES:
                    yield made(group, text)
                    group, size = [], 0
                group.append((doc_id, text))
                size += len(text)
        assert not group, "a chunk without the row that follows it"
    return run


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form (its second half replaced by the next document's start).

    The next document is the next by (id, text), null ids first; after the last
    comes the first. Documents are dealt by ranges of ids and streamed in order; each
    range also gets a copy of the next one's first row. A null text counts as empty.
    An empty table gives no rows. Rows that repeat an id follow each other by text.
    """
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    docs = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    parts = 4 * shuffle_partitions(spark)
    ids = docs.select("doc_id").where("doc_id is not null")
    cuts = sorted({float(x) for x in ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)})
    keyed = docs.withColumn("at", F.col("doc_id").cast("double"))
    if cuts:
        keyed = Bucketizer(splits=[-np.inf, *cuts, np.inf], inputCol="at", outputCol="b",
                           handleInvalid="keep").transform(keyed.fillna({"at": float("-inf")}))
    else:
        keyed = keyed.withColumn("b", F.lit(0.0))
    keyed = keyed.select(F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("b")).cast("int").alias("chunk"),
                         "doc_id", "text")
    # as many rows as there are ranges
    heads = sorted(((r["chunk"], r["first"]) for r in keyed.groupBy("chunk").agg(
        F.min("doc_id").alias("first")).collect()), key=lambda r: r[0])
    schema = "chunk int, first long"
    moved = spark.createDataFrame([(heads[k - 1][0], first) for k, (_, first) in enumerate(heads)], schema)
    visitors = docs.join(F.broadcast(moved), F.col("doc_id").eqNullSafe(F.col("first")))
    both = (keyed.select("chunk", F.lit(False).alias("visitor"), "doc_id", "text")
            .union(visitors.select("chunk", F.lit(True), "doc_id", "text")))
    return (both.repartition(max(1, parts // 2), "chunk").sortWithinPartitions("chunk", "visitor", "doc_id", "text")
            .mapInArrow(_edited(rarity(docs)), EDITED))


def op2_improbable_features(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
