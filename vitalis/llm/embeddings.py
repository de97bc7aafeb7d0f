"""Operator 6 - embedding near-duplicates by spherical k-means cells.

Vectors with equal label and equal components form a class and are compared
once. Each label's classes are cut into cells of about ``CELL_ROWS`` by
spherical k-means (centroids fitted on a bounded sample). Cosines are blocked
matrix products inside cells; a cell beyond ``BLOCK_ROWS`` is compared block
against block in separate tasks.

No link is lost at a cell's border: a vector x of cell c also visits the
lower-numbered cell d if a partner could live there. Vectors with cosine t or
more are at most r = sqrt(2 - 2t) apart, and a member y of d has y.(d - c) >= 0,
so x.(c - d) <= r |c - d| is necessary. Visitors are compared with residents
only, so every pair is met exactly once. How many cells a vector visits depends
on how well the data cluster: few if they do, a fixed share of the cells if
they are noise.

A task returns each vector's number of links and, instead of the links, the
smallest id of its local component, so a group of n near-copies yields n rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import col
from vitalis.llm.components import connected_components
from vitalis.llm.layout import written

THRESHOLD = 0.98
CELL_ROWS = 2048
BLOCK_ROWS = 2048
SAMPLE_PER_CELL = 64
MOST_CELLS = 4096
ROUNDS = 8
PRODUCT_CELLS = 1 << 22  # 32 MB
CLEAN = "id long, label string, dim int, vkey binary, vec binary"


def _clean(batches):
    """Vectors as float64 bytes with a 128-bit key; null where a vector can link with nothing."""
    for batch in batches:
        lists = batch.column(2)
        n = batch.num_rows
        values = lists.flatten()
        good = values.is_valid().to_numpy(zero_copy_only=False)
        flat = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        good &= np.isfinite(flat)
        sizes = np.array([0 if s is None else s for s in lists.value_lengths().to_pylist()], np.int64)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        keys, vecs = [None] * n, [None] * n
        for i in range(n):
            a, b = offs[i], offs[i + 1]
            if b > a and good[a:b].all():
                v = flat[a:b] + 0.0  # -0.0 becomes 0.0
                peak = np.abs(v).max()
                if peak > 0:
                    vecs[i] = v.tobytes()
                    keys[i] = hashlib.blake2b(vecs[i], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int32()),
             pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "label", "dim", "vkey", "vec"])


def _units(column, dim: int) -> np.ndarray:
    """Unit vectors, scaled by the largest component first so that no square over- or underflows."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim).copy()
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; the first ones are spread evenly over the (hash-ordered) sample.

    The products are taken in blocks of rows, of ``PRODUCT_CELLS`` numbers each.
    """
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    step = max(1, PRODUCT_CELLS // k)
    for _ in range(rounds):
        own = np.concatenate([(x[a:a + step] @ c.T).argmax(axis=1) for a in range(0, len(x), step)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(axis=1))
        live = norm > 1e-12
        c[live] = total[live] / norm[live, None]
    return c


def _assign(cells: dict, reach: float):
    """Each vector once in its own cell and once in every lower cell that may hold a partner."""
    def run(batches):
        for batch in batches:
            label, dim = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            groups: dict = {}
            for i, key in enumerate(zip(label, dim, strict=True)):
                groups.setdefault(key, []).append(i)
            rows, cell, home = [], [], []
            for key, at in groups.items():
                at = np.array(at)
                c = cells.get(key)
                if c is None:
                    rows.append(at)
                    cell.append(np.zeros(len(at), np.int64))
                    home.append(np.ones(len(at), bool))
                    continue
                dots = _units(batch.column(4).take(pa.array(at)), key[1]) @ c.T
                own = dots.argmax(axis=1)
                apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0.0)) if len(c) <= 256 else (
                    np.sqrt(np.maximum(2 - 2 * c @ c.T, 0.0)))
                margin = dots[np.arange(len(at)), own][:, None] - dots
                visit = (margin <= reach * apart[own] + 1e-9) & (np.arange(len(c))[None, :] < own[:, None])
                r, k = np.nonzero(visit)
                rows += [at, at[r]]
                cell += [own, k]
                home += [np.ones(len(at), bool), np.zeros(len(r), bool)]
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(np.concatenate(cell) if cell else [], pa.int64()),
                 pa.array(np.concatenate(home) if home else [], pa.bool_())],
                [*batch.schema.names, "cell", "home"])
    return run


def local_components(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches in a symmetric link matrix."""
    best = ids.copy()
    far = np.iinfo(np.int64).max
    while True:
        new = np.minimum(best, np.where(linked, best[None, :], far).min(axis=1, initial=far))
        # follow the names: a row named after id i takes what i itself has been given
        at = np.searchsorted(ids, new)
        new = np.minimum(new, new[at])
        if (new == best).all():
            return best
        best = new


def _compare(threshold):
    """One block against one block (or itself) of a cell."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("named", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table["id"].to_numpy()
        x = _units(table["vec"].combine_chunks(), table["dim"][0].as_py())
        block, home = table["block"].to_numpy(), table["home"].to_numpy()
        first, second = table["i"][0].as_py(), table["j"][0].as_py()
        linked = np.zeros((len(ids), len(ids)), bool)
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if len(a) and len(b):
            near = (x[a] @ x[b].T >= threshold) & (home[a][:, None] | home[b][None, :])
            linked[np.ix_(a, b)] = near
            linked[np.ix_(b, a)] |= near.T
            np.fill_diagonal(linked, False)
        hit = np.flatnonzero(linked.any(axis=1))
        if not len(hit):
            return schema.empty_table()
        linked = linked[np.ix_(hit, hit)]
        copies = table["copies"].to_numpy()[hit]
        return pa.Table.from_arrays([pa.array(ids[hit]), pa.array(linked @ copies),
                                     pa.array(local_components(linked, ids[hit]))], schema=schema)
    return run


def centroid_sample(classes: DataFrame, wanted: list[tuple[str, int, float]]) -> DataFrame:
    """(label, dim, id, vec) of about a share of the classes of each (label, dim, share), and of no other label.

    The share is by a hash of the vector's key: classes of one label differ in it, ids need not.
    """
    shares = classes.sparkSession.createDataFrame(
        [(label, dim, int(share * (1 << 30))) for label, dim, share in wanted], "label string, dim int, below long")
    return (classes.join(F.broadcast(shares), ["label", "dim"])
            .where(F.pmod(F.xxhash64("vkey"), F.lit(1 << 30)) < F.col("below"))
            .select("label", "dim", "id", "vec"))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                           label_col: str = "label", threshold: float = THRESHOLD,
                           cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of ``df``.

    Two vectors are linked when their labels are equal and not null, they have as
    many components, and their cosine in double precision is ``threshold`` or more.

    * null or empty vectors, zero vectors, null or non-finite components, null labels, null ids: no links
    * equal vectors of a label are linked (cosine 1)
    * rows that repeat id, label and vector count once; each gets the result
    * other columns are not read
    """
    raw = df.select(col(id_col).cast("long").alias("id"), col(label_col).cast("string").alias("label"),
                    col(vec_col).alias("vec"))
    clean = written(raw.mapInArrow(_clean, CLEAN), "vectors")
    real = clean.where("id is not null and label is not null and vkey is not null")
    classes = written(real.dropDuplicates(["id", "label", "vkey"]).groupBy("label", "dim", "vkey")
                      .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("vec").alias("vec"))
                      .select("id", "label", "dim", "copies", "vec", "vkey"), "vector-classes")

    # cells: labels of more than cell_rows classes get centroids, MOST_CELLS in all at most (blocks do the rest)
    large = (classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
             .orderBy(F.desc("n"), "label", "dim").limit(MOST_CELLS).collect())
    asked = sum(-(-r["n"] // cell_rows) for r in large)
    shrink = min(1.0, MOST_CELLS / max(1, asked))
    cells = {}
    if large:
        many = {(r["label"], r["dim"]): max(1, int(shrink * -(-r["n"] // cell_rows))) for r in large}
        sample = centroid_sample(classes, [
            (r["label"], r["dim"], min(1.0, SAMPLE_PER_CELL * many[r["label"], r["dim"]] / r["n"]))
            for r in large if many[r["label"], r["dim"]] > 1]).collect()
        by = {}
        for r in sorted(sample, key=lambda r: hashlib.md5(str(r["id"]).encode()).digest()):
            by.setdefault((r["label"], r["dim"]), []).append(bytes(r["vec"]))
        for r in large:
            key = r["label"], r["dim"]
            k = many[key]
            if key in by and k > 1:
                vecs = _units(pa.array(by[key], pa.binary()), r["dim"])
                cells[key] = spherical_kmeans(vecs, min(k, len(vecs)))
    placed = written(classes.drop("vkey").mapInArrow(
        _assign(cells, math.sqrt(2 - 2 * threshold)),
        "id long, label string, dim int, copies long, vec binary, cell long, home boolean"), "cells")
    blocks = (placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
              .select("label", "dim", "cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")))
    faced = (placed.join(blocks, ["label", "dim", "cell"])
             .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    found = written(faced.groupBy("label", "dim", "cell", "i", "j")
                    .applyInArrow(_compare(threshold), "id long, links long, named long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found, "id", "named")
    classed = (classes.join(counts, "id", "left").join(comps, "id", "left")
               .select("label", "dim", "vkey", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                       F.coalesce("component_id", "id").alias("comp")))
    return (clean.select("id", "label", "dim", "vkey").join(classed, ["label", "dim", "vkey"], "left")
            .select(F.col("id").alias(id_col),
                    F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).alias("n_links"),
                    F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(col(id_col) == F.col("component_id"), F.lit(True))))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
