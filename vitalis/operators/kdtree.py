"""Nearest donors by k-d trees, one for each pattern of present columns (M2).

Rows that have a value (donors) and rows that lack one (receivers) are compared over
the columns that both have, so a distance bound holds only among rows with the same
present columns. Donors are split by their pattern D. For a receiver pattern R the tree
of (D, S = D and R) is cut on the columns S alone: every receiver of R has a value at
every cut, and its distance to any donor of the tree depends on S alone, so of donors
equal on S only the k smallest keys count.

* **Build.** A bounded sample of each pattern places the cuts: each node cuts its widest
  column at the median until a leaf holds about ``LEAF`` donors, on as many columns as that
  takes. Donors are dealt to leaves; one aggregate measures each leaf's box.
* **Round 1.** A receiver visits one leaf of each tree, one whose box is close. What it finds
  bounds its k-th distance for each missing column.
* **Round 2.** It visits every other leaf whose box is not farther than that bound. Lists
  of all leaves and patterns are merged; the k best of a union are among the k best of its
  parts, so the result is exact.

A leaf is a task's unit: its donors and visitors meet by shuffle, distances come from
blocked array arithmetic. With more than ``MOST_PATTERNS`` patterns a donor pattern has one tree on all of
its columns; a receiver without the column of a cut then has distance zero to it (looser, still exact).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 256
MOST_LEAVES = 16_384  # of a tree
NEAR = 64  # leaves that are looked at together
MOST_PATTERNS = 24  # with a tree for each pair of patterns
SAMPLE = 200_000  # rows in all that place the cuts
BLOCK = 1 << 20  # distances in memory at once


class Tree:
    """Cuts of a k-d tree as arrays: node i has column[i] (-1: leaf number left[i]), cut[i], left[i], right[i]."""

    def __init__(self, rows: np.ndarray, columns: list[int], leaves: int):
        self.column, self.cut, self.left, self.right = [], [], [], []
        self.leaves = 0
        self._grow(rows, columns, leaves)
        self.column, self.cut = np.array(self.column), np.array(self.cut)
        self.left, self.right = np.array(self.left), np.array(self.right)

    def _grow(self, rows, columns, leaves):
        at = len(self.column)
        for part in (self.column, self.left, self.right):
            part.append(-1)
        self.cut.append(0.0)
        best = None
        if leaves > 1 and len(rows) > 1:
            spread = [float(np.ptp(rows[:, c])) for c in columns]
            for s, c in sorted(zip(spread, columns, strict=True), key=lambda x: (-x[0], x[1])):
                if s > 0:
                    middle = np.sort(rows[:, c])[(len(rows) - 1) // 2]
                    if middle == rows[:, c].max():  # the upper half is one value: cut below it
                        middle = rows[rows[:, c] < middle, c].max()
                    best = c, float(middle)
                    break
        if best is None:
            self.left[at] = self.leaves
            self.leaves += 1
            return at
        c, cut = best
        low = rows[:, c] <= cut
        self.column[at], self.cut[at] = c, cut
        share = min(max(1, round(leaves * low.mean())), leaves - 1)
        self.left[at] = self._grow(rows[low], columns, share)
        self.right[at] = self._grow(rows[~low], columns, leaves - share)
        return at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; NaN in the column of a cut goes left."""
        node = np.zeros(len(x), np.int64)
        if not len(x):
            return node
        while True:
            inner = np.flatnonzero(self.column[node] >= 0)
            if not len(inner):
                return self.left[node]
            at = node[inner]
            up = x[inner, self.column[at]] > self.cut[at]
            node[inner] = np.where(up, self.right[at], self.left[at])


def _bits(mask: int, width: int) -> list[int]:
    return [c for c in range(width) if mask >> c & 1]


def _matrix(batch, first: int, width: int) -> np.ndarray:
    """The columns as rows of doubles, null as NaN."""
    return np.stack([batch.column(first + c).to_numpy(zero_copy_only=False).astype(np.float64) for c in range(width)], axis=1)


def _deal(trees, of_donors, width):
    """(tree, leaf, key, x...) of every donor, once for each tree of its pattern."""
    def run(batches):
        book, by_pattern = trees.value, of_donors.value
        for batch in batches:
            x, mask = _matrix(batch, 2, width), batch.column(1).to_numpy()
            for pattern in np.unique(mask).tolist():
                rows = np.flatnonzero(mask == pattern)
                for t in by_pattern.get(pattern, ()):
                    yield _visits(batch, rows, np.full(len(rows), t), book[t].leaf_of(x[rows]), width)
    return run


def _visits(batch, rows, tree, leaf, width):
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), batch.column(0).take(at),
         *(batch.column(2 + c).take(at) for c in range(width))], ["tree", "leaf", "key", *(f"x{c}" for c in range(width))])


def _in_rows(leaves, low, high):
    """A tree's boxes for ``_plan``: leaves in rows of ``NEAR`` neighbours in the tree's order (-1 fills the last row), their
    boxes and the box around each row."""
    order = np.argsort(leaves)
    leaves, low, high = np.array(leaves)[order], np.array(low, float)[order], np.array(high, float)[order]
    starts = np.arange(0, len(leaves), NEAR)
    around = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    gap = -len(leaves) % NEAR
    leaves = np.pad(leaves, (0, gap), constant_values=-1).reshape(-1, NEAR)
    low = np.pad(low, ((0, gap), (0, 0)), constant_values=np.inf).reshape(len(leaves), NEAR, -1)
    high = np.pad(high, ((0, gap), (0, 0)), constant_values=-np.inf).reshape(len(leaves), NEAR, -1)
    return leaves, low, high, *around


def _far(x, low, high, common, width):
    """How far each row is from boxes: the same for all rows, or a list for each."""
    far = 0.0
    for c in common:
        v = x[:, c][:, None]
        gap = np.maximum(np.maximum(low[..., c] - v, v - high[..., c]), 0.0)
        far = far + gap * gap
    return far * (width / len(common))


def _plan(boxes, of_receivers, width, bounded):
    """Where receivers go: a leaf close by in each tree, or, with bounds, every other one within them.

    Leaves are looked at in rows of ``NEAR``: those of a row only if the box around them is close enough."""
    def run(batches):
        book, by_pattern = boxes.value, of_receivers.value
        for batch in batches:
            x, mask = _matrix(batch, 2, width), batch.column(1).to_numpy()
            bounds = _matrix(batch, 2 + width, width) if bounded else None
            for pattern in np.unique(mask).tolist():
                mine = np.flatnonzero(mask == pattern)
                for t, common, wanted in by_pattern.get(pattern, ()):
                    leaves, low, high, row_low, row_high = book[t]
                    step = max(1, BLOCK // max(len(leaves), NEAR))
                    for a in range(0, len(mine), step):
                        rows = mine[a:a + step]
                        around = _far(x[rows], row_low, row_high, common, width)
                        near = around.argmin(axis=1)
                        home = leaves[near, _far(x[rows], low[near], high[near], common, width).argmin(axis=1)]
                        if bounds is None:
                            yield _visits(batch, rows, np.full(len(rows), t), home, width)
                            continue
                        reach = bounds[rows][:, wanted].max(axis=1)  # infinite where fewer than k were found
                        who, where = np.nonzero(around * (1 - 1e-12) <= reach[:, None])
                        for b in range(0, len(who), BLOCK // NEAR):
                            w, r = who[b:b + BLOCK // NEAR], where[b:b + BLOCK // NEAR]
                            go = _far(x[rows[w]], low[r], high[r], common, width) * (1 - 1e-12) <= reach[w][:, None]
                            go &= (leaves[r] >= 0) & (leaves[r] != home[w][:, None])
                            one, leaf = np.nonzero(go)
                            if len(one):
                                yield _visits(batch, rows[w[one]], np.full(len(one), t), leaves[r[one], leaf], width)
    return run


def _keys(column) -> np.ndarray:
    out = column.to_numpy() if not pa.types.is_string(column.type) else np.array(column.to_pylist())
    return out


def _meet(k, width, schema):
    """The k nearest donors of a leaf to each visitor, one row for each column that the visitor lacks and the donor has."""
    def run(visitors, donors):
        if not visitors.num_rows or not donors.num_rows:
            return schema.empty_table()
        v, d = _matrix(visitors, 3, width), _matrix(donors, 3, width)
        dkey = _keys(donors.column("key"))
        order = np.argsort(dkey, kind="stable")  # place among the donors = order of keys
        d = d[order]
        have = ~np.isnan(d[0])  # all donors of a leaf have one pattern
        who, which, dist = [], [], []
        step = max(1, BLOCK // len(d))
        for a in range(0, len(v), step):
            x = v[a:a + step]
            total, common = np.zeros((len(x), len(d))), np.zeros(len(x))
            for c in np.flatnonzero(have):
                gap = x[:, c][:, None] - d[:, c][None, :]
                there = ~np.isnan(x[:, c])
                total += np.where(there[:, None], gap * gap, 0.0)
                common += there
            with np.errstate(divide="ignore"):
                total = (width / common)[:, None] * total
            total[common == 0] = np.inf
            n = min(k, len(d))
            kth = np.partition(total, n - 1, axis=1)[:, n - 1]
            row, at = np.nonzero((total <= kth[:, None]) & np.isfinite(total))
            near = total[row, at]
            best = np.lexsort((at, near, row))
            row, at, near = row[best], at[best], near[best]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            use = nth < k
            who.append(row[use] + a)
            which.append(at[use])
            dist.append(near[use])
        who, which, dist = (np.concatenate(y) for y in (who, which, dist))
        lacks = np.isnan(v[who]) & have[None, :]
        pair, c = np.nonzero(lacks)
        take = pa.array(who[pair])
        return pa.table([visitors.column("key").take(take), pa.array(c, pa.int32()), pa.array(dist[pair]),
                         donors.column("key").take(pa.array(order[which[pair]])), pa.array(d[which[pair], c])],
                        schema=schema)
    return run


def nearest_donors(base: DataFrame, width: int, k: int, leaf: int = LEAF, sample: int = SAMPLE,
                   most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """(key, c, d2, donor, value): for every missing column c of every row of ``base`` (key, x0, x1, ...) its k nearest
    donors by (d2, key), d2 being width / (columns both have) * (sum of squared differences there).

    Rows that share no column with any donor have no rows in the result. No null keys; keys are unique.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from vitalis.session import materialised

    spark = base.sparkSession
    xs = [f"x{c}" for c in range(width)]
    mask = F.lit(0).cast("long")
    for c in range(width):
        mask = mask + F.when(F.col(xs[c]).isNotNull(), F.lit(1 << c).cast("long")).otherwise(F.lit(0).cast("long"))
    base = materialised(base.select("key", mask.alias("mask"), *xs), "impute-rows")
    counts = {r["mask"]: r["n"] for r in base.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()}  # patterns
    full = (1 << width) - 1
    fine = len(counts) <= most_patterns
    trees, of_donors, of_receivers = {}, {}, {}
    for r in counts:
        if r == full:
            continue
        for d in counts:
            common, wanted = d & r, d & ~r
            if common and wanted:
                t = trees.setdefault((d, common if fine else d), len(trees))
                of_receivers.setdefault(r, []).append((t, _bits(common, width), _bits(wanted, width)))
                if t not in of_donors.setdefault(d, []):
                    of_donors[d].append(t)
    out = T.StructType([T.StructField("key", base.schema["key"].dataType), T.StructField("c", T.IntegerType()),
                        T.StructField("d2", T.DoubleType()), T.StructField("donor", base.schema["key"].dataType),
                        T.StructField("value", T.DoubleType())])
    if not trees:
        return spark.createDataFrame([], out)

    # a bounded sample places the cuts
    total = sum(counts[d] for d in of_donors)
    least = max(64, sample // (4 * len(of_donors)))
    share = {d: min(1.0, max(sample * counts[d] / total, least) / counts[d]) for d in of_donors}
    chosen = F.create_map(*[F.lit(x) for d, s in share.items() for x in (d, int(s * (1 << 30)))])
    rows = base.where(F.col("mask").isin(list(of_donors))).where(
        F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.element_at(chosen, F.col("mask"))).select("mask", *xs).toArrow()
    sampled, masks = _matrix(rows, 1, width), rows.column("mask").to_numpy()
    book = {t: Tree(sampled[masks == d], _bits(s, width), min(MOST_LEAVES, max(1, -(-counts[d] // leaf))))
            for (d, s), t in trees.items()}

    context = spark.sparkContext
    placed = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.IntegerType()),
                           base.schema["key"], *(base.schema[x] for x in xs)])
    donors = base.where(F.col("mask").isin(list(of_donors))).mapInArrow(
        _deal(context.broadcast(book), context.broadcast(of_donors), width), placed)
    # of donors equal on the tree's columns only those with the k smallest keys are ever among the nearest
    cuts_on = F.create_map(*[F.lit(x) for (_, s), t in trees.items() for x in (t, s)])
    equal = Window.partitionBy("tree", *[F.when(F.element_at(cuts_on, F.col("tree")).bitwiseAND(F.lit(1 << c)) != 0,
                                                F.col(x)) for c, x in enumerate(xs)]).orderBy("key")
    donors = materialised(donors.withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k).drop("nth"),
                          "impute-donors")
    boxes = {t: ([], [], []) for t in book}
    for r in donors.groupBy("tree", "leaf").agg(*(f(x).alias(f"{n}{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max)))
                                                ).collect():  # leaves x columns numbers
        leaves, low, high = boxes[r["tree"]]
        leaves.append(r["leaf"])
        low.append([np.nan if r[f"lo{x}"] is None else r[f"lo{x}"] for x in xs])
        high.append([np.nan if r[f"hi{x}"] is None else r[f"hi{x}"] for x in xs])
    boxes = context.broadcast({t: _in_rows(*parts) for t, parts in boxes.items()})
    plan = context.broadcast(of_receivers)

    def found(receivers, bounded, label):
        visits = receivers.mapInArrow(_plan(boxes, plan, width, bounded), placed)
        return materialised(visits.groupBy("tree", "leaf").cogroup(donors.groupBy("tree", "leaf"))
                            .applyInArrow(_meet(k, width, to_arrow_schema(out)), out), label)

    receivers = base.where(F.col("mask") != full)
    first = found(receivers, False, "impute-first")
    best = Window.partitionBy("key", "c").orderBy("d2", "donor")
    bounds = (first.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).groupBy("key").agg(
        *(F.max(F.when(F.col("c") == c, F.col("d2"))).alias(f"b{c}") for c in range(width))))
    inf = F.lit(float("inf"))
    receivers = receivers.join(bounds, "key", "left").select(
        "key", "mask", *xs, *(F.coalesce(f"b{c}", inf).alias(f"b{c}") for c in range(width)))
    every = first.unionByName(found(receivers, True, "impute-second"))
    return every.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")
