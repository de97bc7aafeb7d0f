"""Exact k-nearest-neighbour join without an all-pairs product.

Used by the SMOTE family (T2-T4), the k-NN classifier (F5) and its search (F6). Plan:

1. **Duplicate collapse.** Identical points (same group and coordinates) are
   interchangeable except for the key tie-break, so at most ``k + 1`` of each
   (smallest keys) are kept: ``row_number() <= k+1`` which Spark runs as a
   map-side ``WindowGroupLimit`` — a hot duplicated vector (a third of the
   table) shrinks before any shuffle.
2. **Cells.** A k-d tree (``operators.kdtree``) cuts the points at medians of a bounded
   sample, always the widest column, into leaves of about ``target_per_cell`` points:
   columns that go together (a text's characters and words) still give small cells.
3. **Round 1.** A query meets the points of one leaf, the one it falls into if that holds
   enough points. The k-th distance found there bounds its answer.
4. **Round 2.** It meets every other leaf whose cell is not farther than that bound. The
   k best of a union are among the k best of its parts, so the result is exact.

Queries and points of a leaf meet by shuffle; distances are blocked array arithmetic, and
only a query's k best of a leaf leave the task, so no candidate pair is shuffled or sorted. A leaf with
more than ``MOST_VISITORS`` queries is dealt to several tasks.

Distances are squared Euclidean over ``features``; with ``nan_euclidean`` the
library's NaN-aware form is used: ``p / p_present * sum(d^2 over coordinates
present in both)``, NULL when nothing is shared. Points that lack a coordinate then lie in
leaves of their own that every query visits. Ties are broken by
the point key, so results are deterministic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import col
from vitalis.operators.kdtree import BLOCK, Tree
from vitalis.session import materialised

SAMPLE = 400_000  # rows that place the cuts
MOST_VISITORS = 20_000  # of a leaf in one task


def _matrix(table, names: list[str]) -> np.ndarray:
    """The named columns as rows of doubles, null as NaN."""
    return np.stack([table.column(n).to_numpy(zero_copy_only=False).astype(np.float64) if isinstance(table, pa.RecordBatch)
                     else table.column(n).to_numpy().astype(np.float64) for n in names], axis=1)


def _home(tree: Tree, size: np.ndarray, x: np.ndarray, least: int) -> np.ndarray:
    """The leaf of each row; on the way a half with fewer than ``least`` points is left for the other one."""
    node = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(tree.column[node] >= 0)
        if not len(inner):
            return tree.left[node]
        at = node[inner]
        low, high = tree.left[at], tree.right[at]
        up = x[inner, tree.column[at]] > tree.cut[at]
        up = np.where(size[low] < least, size[high] >= size[low], np.where(size[high] < least, False, up))
        node[inner] = np.where(up, high, low)


def _within(tree: Tree, x: np.ndarray, reach: np.ndarray, scale: np.ndarray):
    """(rows, leaf) of every leaf whose cell lies within the rows' squared reach; a missing coordinate has no distance."""
    todo = [(0, np.arange(len(x)), np.zeros_like(x))]
    while todo:
        node, rows, gap = todo.pop()
        c = tree.column[node]
        if c < 0:
            yield rows, int(tree.left[node])
            continue
        beyond = x[rows, c] - tree.cut[node]
        for child, out in ((tree.left[node], beyond), (tree.right[node], -beyond)):
            g = gap.copy()
            g[:, c] = np.fmax(g[:, c], out)
            far = np.zeros(len(rows))
            for i in range(x.shape[1]):
                far += g[:, i] * g[:, i]
            near = ~(far * scale[rows] * (1 - 1e-12) > reach[rows])
            if near.any():
                todo.append((int(child), rows[near], g[near]))


def _deal(tree, ps: list[str], spare: int):
    """Points with their leaf; those that lack a coordinate are dealt to leaves -1 ... -spare."""
    def run(batches):
        for batch in batches:
            x = _matrix(batch, ps)
            leaf = tree.value.leaf_of(x).astype(np.int32)
            if spare:
                leaf = np.where(np.isnan(x).any(axis=1), -1 - np.arange(len(x)) % spare, leaf).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "_leaf"])
    return run


def _first_visits(tree, size, qs: list[str], least: int):
    def run(batches):
        for batch in batches:
            leaf = _home(tree.value, size.value, _matrix(batch, qs), least).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, np.inf)), pa.array(leaf), pa.array(leaf)],
                [*batch.schema.names, "_reach", "_home", "_leaf"])
    return run


def _more_visits(tree, qs: list[str], spare: int, nan_euclidean: bool):
    """A query once for each other leaf within its reach."""
    def run(batches):
        for batch in batches:
            x, reach = _matrix(batch, qs), batch.column("_reach").to_numpy()
            home = batch.column("_home").to_numpy()
            there = np.maximum((~np.isnan(x)).sum(axis=1), 1) if nan_euclidean else np.full(len(x), len(qs))
            who, where = [], []
            for rows, leaf in _within(tree.value, x, reach, len(qs) / there):
                rows = rows[home[rows] != leaf]
                who.append(rows)
                where.append(np.full(len(rows), leaf, np.int32))
            for s in range(spare):
                who.append(np.arange(len(x)))
                where.append(np.full(len(x), -1 - s, np.int32))
            who, where = np.concatenate(who), np.concatenate(where)
            for a in range(0, len(who), BLOCK):
                got = batch.take(pa.array(who[a:a + BLOCK]))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(where[a:a + BLOCK])], [*batch.schema.names, "_leaf"])
    return run


def _distances(x: np.ndarray, p: np.ndarray, nan_euclidean: bool):
    """Squared distances, and where two rows can be compared."""
    total = np.zeros((len(x), len(p)))
    if not nan_euclidean:
        for c in range(x.shape[1]):
            gap = x[:, c][:, None] - p[:, c][None, :]
            total += gap * gap
        return total, np.ones(total.shape, bool)
    both = np.zeros(total.shape)
    for c in range(x.shape[1]):
        gap = x[:, c][:, None] - p[:, c][None, :]
        has = ~np.isnan(gap)
        total += np.where(has, gap * gap, 0.0)
        both += has
    return x.shape[1] / np.maximum(both, 1) * total, both > 0


def _meet(k: int, qs: list[str], ps: list[str], carry: list[str], exclude_self: bool, nan_euclidean: bool, first: bool, schema):
    """A leaf's k nearest points of each visitor within its reach; in the first round with the visitor and its new
    reach, in one row at least."""
    def run(visitors, points):
        if not visitors.num_rows or not (first or points.num_rows):
            return schema.empty_table()
        points = points.take(pc.sort_indices(points, sort_keys=[(c, "ascending") for c in ["_pk", *ps]], null_placement="at_start"))
        keys = points.column("_pk").combine_chunks()
        known = keys.unique()
        code, p = pc.index_in(keys, value_set=known).to_numpy(zero_copy_only=False), _matrix(points, ps)
        if len(p) > 1:  # the same key and place count once
            fresh = np.append(True, (code[1:] != code[:-1]) | (p[1:] != p[:-1]).any(axis=1))
            points, code, p = points.take(pa.array(np.flatnonzero(fresh))), code[fresh], p[fresh]
        x, reach = _matrix(visitors, qs), visitors.column("_reach").to_numpy()
        own = pc.fill_null(pc.index_in(visitors.column("_qk").combine_chunks(), value_set=known), -1).to_numpy(
            zero_copy_only=False) if exclude_self else None
        who, which, dist, place, bound = [], [], [], [], np.full(len(x), np.inf)
        step = max(1, BLOCK // max(1, len(p)))
        for a in range(0, len(x) if len(p) else 0, step):
            b = min(len(x), a + step)
            total, use = _distances(x[a:b], p, nan_euclidean)
            if exclude_self:
                use &= own[a:b, None] != code[None, :]
            total[~use] = np.nan  # sorted behind all others
            dropped = int((~use).sum(axis=1).max())
            order = np.argsort(total, axis=1, kind="stable")[:, :k + dropped]  # equal distances stay in the order of keys
            near, use = np.take_along_axis(total, order, 1), np.take_along_axis(use, order, 1)
            nth = np.cumsum(use, axis=1)
            use &= (nth <= k) & ~(near > reach[a:b, None])
            row, at = np.nonzero(use)
            last = use & (nth == k)
            full = last.any(axis=1)
            bound[a:b][full] = near[np.flatnonzero(full), last[full].argmax(axis=1)]
            who.append(row + a)
            which.append(order[row, at])
            dist.append(near[row, at])
            place.append(nth[row, at])
        none = np.zeros(0, np.int64)
        who, which, place = (np.concatenate(v) if v else none for v in (who, which, place))
        dist = np.concatenate(dist) if dist else np.zeros(0)
        bound[np.isnan(bound)] = np.inf
        missing = np.setdiff1d(np.arange(len(x)), who) if first else none  # found nothing, still to be heard of
        at, blank = pa.array(np.append(who, missing)), pa.array(np.append(np.zeros(len(who), bool), np.ones(len(missing), bool)))
        chosen = pc.if_else(blank, pa.scalar(None, pa.int64()), pa.array(np.append(which, missing)))
        made = {n: visitors.column(n).take(at) for n in schema.names if n in visitors.column_names}
        made |= {n: points.column(n).take(chosen) for n in ["_pk", *carry]}
        made["_d2"] = pa.array(np.append(dist, np.zeros(len(missing))))
        if first:
            made["_reach"] = pa.array(bound).take(at)
            made["_nth"] = pa.array(np.append(place, np.zeros(len(missing))).astype(np.int32))
        return pa.Table.from_arrays([made[n].cast(schema.field(n).type) for n in schema.names], schema=schema)
    return run


def knn_join(queries: DataFrame, points: DataFrame, *, qkey: str, pkey: str, features: list[str], k: int,
             group: str | None = None, exclude_self: bool = False, nan_euclidean: bool = False,
             grid_cols: list[str] | None = None, target_per_cell: int = 256, carry: list[str] | None = None) -> DataFrame:
    """For every query row, its ``k`` nearest points:
    ``(query_key, point_key, d2, rank, carry...)``. ``group`` restricts candidates to
    points of the same group value (both sides must have the column); ``grid_cols``: the columns that are cut."""
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = carry or []
    width, spark = len(features), queries.sparkSession
    qs, ps, cs = [f"_q{i}" for i in range(width)], [f"_p{i}" for i in range(width)], [f"_c_{c}" for c in carry]
    grp = [col(group).alias("_grp")] if group else [F.lit(0).alias("_grp")]

    # 1. points, duplicates collapsed to the k+1 smallest keys per identical vector
    pts = points.select(col(pkey).alias("_pk"), *grp, *[col(f).cast("double").alias(p) for p, f in zip(ps, features, strict=True)],
                        *[col(c).alias(n) for n, c in zip(cs, carry, strict=True)])
    asks = queries.select(col(qkey).alias("_qk"), *grp, *[col(f).cast("double").alias(x) for x, f in zip(qs, features, strict=True)])
    asks = asks.where("_qk IS NOT NULL AND _grp IS NOT NULL")
    if exclude_self:
        pts = pts.where("_pk IS NOT NULL")
    if not nan_euclidean:  # a missing coordinate has no distance to anything
        pts = pts.where(" AND ".join(f"{p} IS NOT NULL" for p in ps))
        asks = asks.where(" AND ".join(f"{x} IS NOT NULL" for x in qs))
    dup_w = Window.partitionBy("_grp", *ps).orderBy("_pk")
    pts = materialised(pts.withColumn("_dr", F.row_number().over(dup_w)).where(F.col("_dr") <= k + 1).drop("_dr"), "knn-points")

    # 2. the cells
    n, bits = pts.count(), 1 << 30
    rows = pts.where(F.pmod(F.xxhash64("_pk", *ps), F.lit(bits)) <= int(min(1.0, SAMPLE / max(n, 1)) * bits)).select(*ps).toArrow()
    x = _matrix(rows, ps)
    cuts_on = [features.index(g) for g in grid_cols] if grid_cols is not None else list(range(width))
    leaves = min(-(-n // max(target_per_cell, 4 * (k + 1))), SAMPLE // 8)
    grown = Tree(x[np.isfinite(x).all(axis=1)], cuts_on, max(1, leaves))
    spare = 0
    if nan_euclidean:
        spare = -(-pts.where(" OR ".join(f"{p} IS NULL OR isnan({p})" for p in ps)).count() // 4096)
    tree = spark.sparkContext.broadcast(grown)
    pts = materialised(pts.mapInArrow(_deal(tree, ps, spare), T.StructType([*pts.schema.fields, T.StructField("_leaf", T.IntegerType())])),
                       "knn-cells")
    held = {r["_leaf"]: r["count"] for r in pts.groupBy("_leaf").count().collect()}  # a number for each leaf
    size = np.zeros(len(grown.column), np.int64)
    for node in range(len(size) - 1, -1, -1):  # children come after their node
        c = grown.column[node]
        size[node] = held.get(int(grown.left[node]), 0) if c < 0 else size[grown.left[node]] + size[grown.right[node]]
    size = spark.sparkContext.broadcast(size)

    # 3. and 4. the two rounds
    visit = [*asks.schema.fields, T.StructField("_reach", T.DoubleType()), T.StructField("_home", T.IntegerType())]
    found = [T.StructField("_qk", asks.schema["_qk"].dataType), *(pts.schema[c] for c in ["_pk", *cs]), T.StructField("_d2", T.DoubleType())]
    found = [T.StructField(f.name, f.dataType) for f in found]

    def met(visits: DataFrame, first: bool, label: str) -> DataFrame:
        visits = materialised(visits, f"knn-visits-{label}")
        at = ["_grp", "_leaf"]
        parts = visits.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / MOST_VISITORS).cast("int").alias("_parts"))
        left = visits.join(parts, at).withColumn("_part", F.pmod(F.xxhash64("_qk"), F.col("_parts")).cast("int")).drop("_parts")
        right = pts.join(parts, at).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        out = T.StructType([*(T.StructField(f.name, f.dataType) for f in visit if f.name != "_qk"), T.StructField("_nth", T.IntegerType()), *found]
                           if first else found)
        meet = _meet(k, qs, ps, cs, exclude_self, nan_euclidean, first, to_arrow_schema(out))
        return materialised(left.groupBy(*at, "_part").cogroup(right.groupBy(*at, "_part")).applyInArrow(meet, out), f"knn-{label}")

    leaf = T.StructField("_leaf", T.IntegerType())
    near = met(asks.mapInArrow(_first_visits(tree, size, qs, 2 * k + 2), T.StructType([*visit, leaf])), True, "first")
    again = near.where("_nth <= 1").select(*[f.name for f in visit])  # one row a visitor
    more = met(again.mapInArrow(_more_visits(tree, qs, spare, nan_euclidean), T.StructType([*visit, leaf])), False, "second")
    names = [f.name for f in found]
    every = near.where("_nth > 0").select(*names).unionByName(more.select(*names))
    # a query key that comes twice has its points twice; they tie, so dense_rank gives the rank among distinct points
    rank_w = Window.partitionBy("_qk").orderBy("_d2", "_pk")
    top = materialised(every.withColumn("rank", F.dense_rank().over(rank_w)).where(F.col("rank") <= k).dropDuplicates(["_qk", "_pk"]), "knn-nearest")
    return top.select(F.col("_qk").alias("query_key"), F.col("_pk").alias("point_key"), F.col("_d2").alias("d2"),
                      F.col("rank").cast("int").alias("rank"), *[F.col(n).alias(c) for n, c in zip(cs, carry, strict=True)])
