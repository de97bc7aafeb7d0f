"""Operator 12 - how the sources of a language differ in their words, with late strings.

Counting shuffles no words: a term is its 64-bit digest, and per (lang, source) the
digest's occurrences and documents are added up, map-side first. Only when the
languages' frequent digests are known are words looked at: a second pass over
the texts takes the smallest and the largest string behind each frequent digest. Where
they differ, terms have collided, and that digest alone is counted again by its
strings and split. Probabilities, divergences and ranks work on digests; strings are
joined back to the rows that stay in the result.

All arithmetic is in integers. The divergence of two sources sums over all kept
terms, also those that one of them lacks: the rows of a language are dealt into
slices of terms, and a task holds the probabilities of a slice as a dense matrix of one
block of sources against the others, so no pairs of rows are made per term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalis.functions.columns import col
from vitalis.llm.layout import written
from vitalis.llm.textkit import blocks, lower_ascii, mix, prefix_hash, span_hash, text_buffer, worker_cache

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
SLICE_ROWS = 200_000  # rows of a language's (source, term) table in a slice
SOURCES = 128  # sources in a block
TERMS = 4096  # terms in a dense matrix
GATHERED = 1 << 20  # (group, digest) rows that a task gathers before it passes them on


def term_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of letters A-Z, a-z and of bytes of other scripts, none across documents."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cache = worker_cache()
    if "term bytes" not in cache:
        b = np.arange(256)
        cache["term bytes"] = (b >= 0x80) | ((b | 0x20) >= 0x61) & ((b | 0x20) <= 0x7A)
    inside = cache["term bytes"][buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _terms(batch, at: int, bits: int):
    """For each block of texts: (first row, offsets, lower-cased bytes, starts, ends, digests, row of each term)."""
    buf, offs = text_buffer(batch.column(at))
    for a, b in blocks(offs):
        x, to = lower_ascii(buf[offs[a]:offs[b]]), offs[a:b + 1] - offs[a]
        start, end = term_spans(x, to)
        digest = span_hash(prefix_hash(x), start, end) >> np.uint64(64 - bits)
        yield a, x, start, end, digest, np.searchsorted(to, start, side="right") - 1


def _codes(column) -> tuple[np.ndarray, list[str]]:
    d = column.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _edges(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array, and the end."""
    if not len(ordered):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])), len(ordered))


class _Counts:
    """Occurrences and documents of (group, digest), gathered over blocks of texts."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts, self.rows = [], 0

    def add(self, group: np.ndarray, digest: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.parts.append((group, digest, n, docs))
        self.rows += len(group)

    def block(self, group_of_row: np.ndarray, digest: np.ndarray, row: np.ndarray):
        """One block: ``digest`` and ``row`` of every term; no array is sorted but by one integer key."""
        kinds, of = np.unique(digest, return_inverse=True)
        cell = np.sort(row * len(kinds) + of)
        edge = _edges(cell)
        row, of, n = *np.divmod(cell[edge[:-1]], len(kinds)), np.diff(edge)
        cell = group_of_row[row] * len(kinds) + of
        order = np.argsort(cell)
        edge = _edges(cell[order])
        group, of = np.divmod(cell[order][edge[:-1]], len(kinds))
        self.add(group, kinds[of], np.add.reduceat(n[order], edge[:-1]), np.diff(edge))

    def flush(self):
        if not self.parts:
            return
        group, digest, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        kinds, of = np.unique(digest, return_inverse=True)
        cell = group * len(kinds) + of
        order = np.argsort(cell)
        edge = _edges(cell[order])
        group, of = np.divmod(cell[order][edge[:-1]], len(kinds))
        group, names = pa.array(group), list(self.groups)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([name[k] for name in names]).take(group) for k in (0, 1)), pa.array(kinds[of].view(np.int64)),
             *(pa.array(np.add.reduceat(x[order], edge[:-1])) for x in (n, docs))],
            ["lang", "source", "digest", "n", "docs"])


def _count(bits: int):
    """(lang, source, digest, occurrences, documents), added up within runs of texts."""
    def run(batches):
        counts = _Counts()
        for batch in batches:
            (lang, langs), (source, sources) = _codes(batch.column(0)), _codes(batch.column(1))
            pair, of = np.unique(lang * len(sources) + source, return_inverse=True)
            group = np.array([counts.groups.setdefault((langs[x // len(sources)], sources[x % len(sources)]),
                                                       len(counts.groups)) for x in pair.tolist()], np.int64)[of]
            for a, _, start, _, digest, row in _terms(batch, 2, bits):
                if len(start):
                    counts.block(group, digest, row + a)
                if counts.rows >= GATHERED:
                    yield from counts.flush()
        yield from counts.flush()
    return run


def _strings(bits: int, per_row: bool):
    """The (digest, term) of runs of texts, each about once; per row with (lang, source) and occurrences if asked."""
    names = ["lang", "source", "digest", "term", "n"] if per_row else ["digest", "term"]

    def run(batches):
        told = np.zeros(0, np.uint64)
        for batch in batches:
            for a, x, start, end, digest, row in _terms(batch, 2, bits):
                # terms may share the digest: a second one, of the bytes backwards, tells them apart here
                other = span_hash(prefix_hash(x[::-1]), len(x) - end, len(x) - start)
                both = mix(digest * np.uint64(0x9E3779B97F4A7C15) + other)
                if per_row:
                    both = mix(both + row.astype(np.uint64))
                both, one, n = np.unique(both, return_index=True, return_counts=True)
                if not per_row:
                    new = ~np.isin(both, told, assume_unique=True, kind="sort")
                    both, one = both[new], one[new]
                    told = np.union1d(told, both) if len(told) < GATHERED else both
                if not len(one):
                    continue
                data = x.tobytes()
                term = pa.array([data[s:e].decode("utf-8", "replace")
                                 for s, e in zip(start[one].tolist(), end[one].tolist(), strict=True)], pa.string())
                out = [pa.array(digest[one].view(np.int64)), term]
                if per_row:
                    at = pa.array(row[one] + a)
                    out = [batch.column(0).take(at), batch.column(1).take(at), *out, pa.array(n)]
                yield pa.RecordBatch.from_arrays(out, names)
    return run


def counted_terms(docs: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """((lang, source, digest, part, n) of each language's kept terms, (digest, part, term)).

    ``part`` numbers the terms that share a digest, 0 where there is one.
    """
    counted = written(docs.mapInArrow(_count(bits), "lang string, source string, digest long, n long, docs long")
                      .groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
                      "terms")
    # a digest's documents are at least those of each of its terms, so no kept term is missing here
    frequent = written(counted.groupBy("lang", "digest").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs)
                       .select("lang", "digest"), "frequent-digests")
    strings = written(docs.mapInArrow(_strings(bits, False), "digest long, term string")
                      .join(frequent.select("digest").distinct(), "digest", "left_semi")
                      .groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "strings")
    kept = counted.join(frequent, ["lang", "digest"]).select("lang", "source", "digest", F.lit(0).alias("part"), "n")
    mixed = strings.where("lo <> hi").select("digest")
    if mixed.isEmpty():
        return written(kept, "kept-terms"), strings.select("digest", F.lit(0).alias("part"), F.col("lo").alias("term"))
    split = written(docs.mapInArrow(_strings(bits, True), "lang string, source string, digest long, term string, n long")
                    .join(mixed, "digest", "left_semi").groupBy("lang", "source", "digest", "term")
                    .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")), "split")
    parts = written(split.select("digest", "term").distinct().select(
        "digest", F.row_number().over(Window.partitionBy("digest").orderBy("term")).alias("part"), "term"), "parts")
    split = split.join(parts, ["digest", "term"])
    enough = (split.groupBy("lang", "digest", "part").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs)
              .select("lang", "digest", "part"))
    kept = kept.join(mixed, "digest", "left_anti").select("lang", "source", "digest", "part", "n").unionByName(
        split.join(enough, ["lang", "digest", "part"]).select("lang", "source", "digest", "part", "n"))
    names = strings.where("lo = hi").select("digest", F.lit(0).alias("part"), F.col("lo").alias("term")).unionByName(parts)
    return written(kept, "kept-terms"), names


def _probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly; null without kept terms."""
    whole = "decimal(38,0)"
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    below = F.nullif((total + 2 * kept).cast(whole), F.lit(0).cast(whole))
    return F.call_function("div", above.cast(whole), below).cast("long") + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(key, table):
    """Sums over the slice's terms of the divergences of the block's sources with themselves and later blocks."""
    lang, _, block = (k.as_py() for k in key)
    idx = table.column("idx").to_numpy()
    p = table.column("p").fill_null(0).to_numpy()
    head = table.column("head").to_numpy(zero_copy_only=False)
    sources = np.sort(idx[head])
    empty = np.zeros(int(sources[-1]) + 1, np.int64)  # probabilities of an absent term
    empty[idx[head]] = p[head]
    _, term = np.unique(np.stack([table.column("digest").to_numpy()[~head], table.column("part").to_numpy()[~head]]),
                        axis=1, return_inverse=True)
    at, value = idx[~head], p[~head]
    order = np.argsort(term, kind="stable")
    term, at, value = term[order], at[order], value[order]
    mine = sources[sources // SOURCES == block]
    out = []
    edges = np.searchsorted(term, np.arange(0, (int(term[-1]) if len(term) else 0) + TERMS + 1, TERMS))
    for b in range(block, int(sources[-1]) // SOURCES + 1):
        theirs = sources[sources // SOURCES == b]
        total = np.zeros((len(mine), len(theirs)), np.int64)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi == lo:
                continue
            t, i, v = term[lo:hi] - term[lo], at[lo:hi], value[lo:hi]
            sides = []
            for side in (mine, theirs):
                m = np.repeat(empty[side][None, :], int(t[-1]) + 1, axis=0)
                of = (i >= side[0]) & (i <= side[-1])
                m[t[of], i[of] - side[0]] = v[of]
                sides.append(m)
            for k in range(len(mine)):
                one = sides[0][:, k:k + 1]
                gap = one - sides[1]
                total[k] += (gap * gap // np.maximum(one + sides[1], 1)).sum(axis=0)
        a, c = np.meshgrid(mine, theirs, indexing="ij")
        use = a < c
        out.append(pa.table([pa.array([lang] * int(use.sum()), pa.string()), pa.array(a[use], pa.int32()),
                             pa.array(c[use], pa.int32()), pa.array(total[use])], ["lang", "a", "b", "value"]))
    return pa.concat_tables(out)


def source_pairs(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed divergence of each source from each other one of its language.

    ``groups``: (lang, source, idx, absent); ``rows``: (lang, idx, digest, part, p). idx counts from 0 within the
    language without gaps, absent is the probability of a term that the source lacks.
    """
    dealt = written(groups.groupBy("lang").agg(F.max("idx").alias("top")).join(
        rows.groupBy("lang").agg(F.count(F.lit(1)).alias("r")), "lang", "left").select(
        "lang", "top", F.greatest(F.ceil(F.coalesce("r", F.lit(0)) / SLICE_ROWS), F.lit(1)).cast("long").alias("slices")),
        "slices")
    to_block = F.explode(F.sequence(F.lit(0), F.floor(F.col("idx") / SOURCES).cast("int"))).alias("block")
    body = (rows.join(dealt, "lang")
            .select("lang", F.pmod(F.xxhash64("digest"), F.col("slices")).alias("slice"), "idx", "digest", "part", "p",
                    F.lit(False).alias("head"))
            .select("*", to_block))
    heads = (groups.join(dealt, "lang")
             .select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "idx",
                     F.lit(0).cast("long").alias("digest"), F.lit(0).alias("part"), F.col("absent").alias("p"),
                     F.lit(True).alias("head")).select("*", to_block))
    sums = (body.unionByName(heads).groupBy("lang", "slice", "block")
            .applyInArrow(_pairs, "lang string, a int, b int, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sums.union(sums.select("lang", "b", "a", "value"))
    one = groups.select("lang", F.col("idx").alias("a"), "source")
    two = groups.select("lang", F.col("idx").alias("b"), F.col("source").alias("item"))
    return both.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "source", "item", "value")


def audit_sources(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  min_docs: int = MIN_DOCS, top: int = TOP_TERMS, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): which sources of a language differ most, and by which terms.

    Terms are runs of letters (A-Z, a-z and all characters beyond ASCII), A-Z
    lower-cased; a language keeps those in ``min_docs`` of its documents or more. With
    p = 1 + floor(10^9 (n + 2) / (N + 2 V)) a group's divergence from another is the sum of
    floor((p - q)^2 / (p + q)) over the language's kept terms. Part ``pair``: every other
    source of the language; part ``term``: the ``top`` terms that the source uses more
    than its language does.

    * null text, lang or source: the empty string; a text without terms still makes its group occur
    * very long texts are read whole; every row is a document, also a repeated one
    * ties: by value, then by the item's UTF-8 bytes; an empty table gives no rows
    * other columns are not read; ``bits`` < 64 narrows the digests (to see collisions split)
    """
    docs = df.select(*(F.coalesce(col(c).cast("string"), F.lit("")).alias(n)
                       for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    kept, names = counted_terms(docs, min_docs, bits)
    by_lang = kept.groupBy("lang", "digest", "part").agg(F.sum("n").alias("lang_n"))
    totals = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(
        groups.join(sizes, ["lang", "source"], "left").join(totals, "lang", "left").select(
            "lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"),
            F.coalesce("v", F.lit(0)).cast("long").alias("v"), "lang_total",
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("idx")), "groups")
    rows = written(kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "idx", "digest", "part", "lang_total", "v",
        _probability(F.col("n"), F.col("total"), F.col("v")).alias("p")), "group-terms")

    pairs = source_pairs(groups.select("lang", "source", "idx", _probability(F.lit(0), F.col("total"), F.col("v"))
                                       .alias("absent")), rows.select("lang", "idx", "digest", "part", "p"))
    own = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                         F.row_number().over(own.orderBy(F.desc("value"), "item")).alias("rank"))

    more = (rows.join(by_lang, ["lang", "digest", "part"])
            .withColumn("q", _probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))).where("p > q")
            .select("lang", "source", "digest", "part", _divergence(F.col("p"), F.col("q")).alias("value")))
    # by value alone first, with ties; then strings decide
    likely = more.withColumn("r", F.rank().over(own.orderBy(F.desc("value")))).where(F.col("r") <= top).drop("r")
    terms = (likely.join(names, ["digest", "part"])
             .withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
    return pairs.unionByName(terms)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all ``documents``."""
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
