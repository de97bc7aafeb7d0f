"""Random forests on many rows (F2), grown from rows of equal bins.

A tree sees the bins and the label of a row alone, so rows that share them are one cell with their
number w. A tree's bootstrap takes a row Poisson(1) times, hence a cell Poisson(w) times: the draws
come from a seed of the tree and the cell's block, the same in every pass and every retry.

All trees grow level by level. A task walks its cells down one tree after the other and adds up the classes
in each open node, feature and bin; the sums of a tree (of ``MOST_NODES`` open nodes at once) meet in one task, which
picks the cuts. Only cuts reach the driver. The rules are those of Spark's forests - Gini gain, a random
subset of the features at each node, leaves of equal prediction merged - and so is the result: a
``RandomForestClassificationModel``, written in Spark's own format and loaded.

``decision_table`` is such a forest as the predicted class of every cell of its own cuts, a byte each.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.session import checkpoint_dir

BLOCK = 1 << 15  # cells
MOST_NODES = 4096  # of a tree, open at once in a task
MOST_CELLS = 1 << 26  # of a decision table
PURE = 2.0 ** -52


def packed(width: int):
    """Cells (bins, label, number) as blocks: a row with its own number and arrays as bytes."""
    def run(batches):
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(a, BLOCK)
                bins = np.stack([piece.column(c).to_numpy(zero_copy_only=False) for c in range(width)]).astype(np.uint8)
                label = piece.column(width).to_numpy(zero_copy_only=False)
                if ((label < 0) | (label != np.floor(label)) | (label > 99)).any():
                    raise ValueError("the labels of a forest are 0, 1, ... and at most 99")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | nth], pa.int64()), pa.array([piece.num_rows], pa.int64()),
                     pa.array([int(label.max())], pa.int32()), pa.array([bins.tobytes()], pa.binary()),
                     pa.array([label.astype(np.uint8).tobytes()], pa.binary()),
                     pa.array([piece.column(width + 1).to_numpy().astype(np.int64).tobytes()], pa.binary())],
                    ["block", "n", "label", "bins", "labels", "weights"])
                nth += 1
    return run


PACKED = "block long, n long, label int, bins binary, labels binary, weights binary"


@dataclass
class Tree:
    """Nodes in the order they were made; ``cut``: bins up to it go left."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [-1])
    left: list = field(default_factory=lambda: [-1])  # the right child follows
    gain: list = field(default_factory=lambda: [-1.0])
    stats: list = field(default_factory=lambda: [None])

    def arrays(self):
        """Feature, cut and left child of every node; one without a cut leads to itself."""
        feature, left = np.array(self.feature, np.int64), np.array(self.left, np.int64)
        leaf = feature < 0
        return np.where(leaf, 0, feature), np.where(leaf, 255, self.cut), np.where(leaf, np.arange(len(left)), left)


def _open_sums(held, seed: int, width: int, bins: int, classes: int, depth: int, bootstrap: bool):
    """(unit, bytes): of every unit (tree, its open nodes from a to b) the classes by node, feature and bin."""
    def run(batches):
        trees, units = held.value
        blocks, places = [], []
        for batch in batches:
            for block, n, x, y, w in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True):
                x = np.frombuffer(x, np.uint8).reshape(width, n)
                blocks.append((block, x, np.frombuffer(w, np.int64)))
                places.append(x.astype(np.int16) * classes + np.frombuffer(y, np.uint8))
        if not blocks:
            return
        places = np.concatenate(places, axis=1)
        by_tree: dict[int, list] = {}
        for unit, (t, a, b) in enumerate(units):
            by_tree.setdefault(t, []).append((unit, a, b))
        for t, mine in by_tree.items():
            feature, cut, left = trees[t]
            nodes, draws = [], []
            for block, x, w in blocks:
                if bootstrap:
                    w = np.random.default_rng([seed & 0xFFFFFFFF, t, block >> 32, block & 0xFFFFFFFF]).poisson(w)
                flat, at = x.reshape(-1), np.arange(x.shape[1])
                start, node = feature * x.shape[1], np.zeros(x.shape[1], np.int64)
                for _ in range(depth):  # a node without a cut leads to itself
                    node = left.take(node) + (flat.take(start.take(node) + at) > cut.take(node))
                nodes.append(node)
                draws.append(w)
            node, w = np.concatenate(nodes), np.concatenate(draws)
            for unit, a, b in mine:
                live = np.flatnonzero((w > 0) & (node >= a) & (node < b))
                base, many = (node[live] - a) * (bins * classes), w[live].astype(float)
                total = np.stack([np.bincount(base + places[f].take(live), many, (b - a) * bins * classes) for f in range(width)])
                if total.any():
                    yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                                     ["unit", "sums"])
    return run


def gini(stats: np.ndarray) -> np.ndarray:
    n = stats.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, 1.0 - (stats * stats).sum(axis=-1) / (n * n), 0.0)


def best_cuts(sums: np.ndarray, chosen: np.ndarray, least: int):
    """(feature, cut, gain, classes to the left) of each node, from (node, feature, bin, class); feature -1: no cut."""
    left = sums.cumsum(axis=2)[:, :, :-1]
    every = sums[:, :1].sum(axis=2, keepdims=True)
    right = every - left
    n, a, b = every.sum(axis=-1), left.sum(axis=-1), right.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gini(every) - a / n * gini(left) - b / n * gini(right)
    gain = np.where((a >= least) & (b >= least) & chosen[:, :, None], gain, -np.inf)
    flat = gain.reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    best = flat[np.arange(len(sums)), at]
    f, cut = np.divmod(at, gain.shape[2])
    return np.where(best > 0, f, -1), cut, best, left[np.arange(len(sums)), f, cut]


def _chosen(seed: int, tree: int, a: int, b: int, width: int, subset: int) -> np.ndarray:
    """The features that nodes a ... b - 1 may be cut on."""
    if subset >= width:
        return np.ones((b - a, width), bool)
    draws = np.stack([np.random.default_rng([seed & 0xFFFFFFFF, tree, node, 1 << 31]).random(width) for node in range(a, b)])
    return draws.argsort(axis=1).argsort(axis=1) < subset


def _cuts(units, seed: int, width: int, bins: int, classes: int, subset: int, least: int):
    """The cuts of a unit's nodes, from the sums of all tasks."""
    def run(key, parts):
        unit = key[0].as_py()
        t, a, b = units[unit]
        total = np.zeros(width * (b - a) * bins * classes)
        for x in parts.column("sums").chunks:
            for v in x:
                total += np.frombuffer(v.as_buffer(), np.float64)
        sums = total.reshape(width, b - a, bins, classes).transpose(1, 0, 2, 3)
        f, cut, gain, left = best_cuts(sums, _chosen(seed, t, a, b, width, subset), least)
        every = sums[:, 0].sum(axis=1)
        return pa.table([pa.array([unit], pa.int32()), *(pa.array([np.ascontiguousarray(v, k).tobytes()], pa.binary()) for v, k in (
            (f, np.int64), (cut, np.int64), (gain, float), (left, float), (every, float)))],
            ["unit", "feature", "cut", "gain", "left", "every"])
    return run


def grow(blocks: DataFrame, width: int, bins: int, classes: int, trees: int, depth: int, least: int, subset: int, seed: int,
         bootstrap: bool = True) -> list[Tree]:
    """The trees over ``blocks`` (``packed``); keep them where they are read fast, a pass is made for every level."""
    context = blocks.sparkSession.sparkContext
    made = [Tree() for _ in range(trees)]
    front = {t: (0, 1) for t in range(trees)}  # the nodes of the last level
    for level in range(depth):
        units = [(t, a, min(a + MOST_NODES, end)) for t, (start, end) in front.items() for a in range(start, end, MOST_NODES)]
        if not units:
            break
        held = context.broadcast(({t: made[t].arrays() for t in front}, units))
        found = (blocks.mapInArrow(_open_sums(held, seed, width, bins, classes, level, bootstrap), "unit int, sums binary")
                 .groupBy("unit").applyInArrow(_cuts(units, seed, width, bins, classes, subset, least),
                                               "unit int, feature binary, cut binary, gain binary, left binary, every binary"))
        front = {}
        for r in sorted(found.collect(), key=lambda r: r["unit"]):  # a few numbers for each open node
            t, a, b = units[r["unit"]]
            tree = made[t]
            f, cut = (np.frombuffer(r[c], np.int64) for c in ("feature", "cut"))
            gain, left, every = np.frombuffer(r["gain"]), np.frombuffer(r["left"]).reshape(-1, classes), np.frombuffer(
                r["every"]).reshape(-1, classes)
            begin = len(tree.left)
            for i in range(b - a):
                if tree.stats[a + i] is None:
                    tree.stats[a + i] = every[i]
                if f[i] < 0 or gini(tree.stats[a + i]) < PURE:
                    continue
                tree.feature[a + i], tree.cut[a + i], tree.gain[a + i] = int(f[i]), int(cut[i]), float(gain[i])
                tree.left[a + i] = len(tree.left)
                for part in (left[i], every[i] - left[i]):
                    for values, v in ((tree.feature, -1), (tree.cut, -1), (tree.left, -1), (tree.gain, -1.0), (tree.stats, part)):
                        values.append(v)
            if len(tree.left) > begin:
                front[t] = front.get(t, (begin, 0))[0], len(tree.left)
        held.destroy()
    for tree in made:
        if tree.stats[0] is None:
            tree.stats[0] = np.zeros(classes)
    return made


def node_rows(t: int, tree: Tree, bounds: list[list[float]]) -> list[tuple]:
    """A tree as Spark writes it: nodes in preorder; two leaves of equal prediction are one."""
    merged = [False] * len(tree.left)  # a leaf now
    for i in range(len(tree.left) - 1, -1, -1):  # children come after their parents
        low = tree.left[i]
        merged[i] = low < 0 or (merged[low] and merged[low + 1] and tree.stats[low].argmax() == tree.stats[low + 1].argmax())
    rows: list = []
    todo: list = [(0, None)]
    while todo:
        i, parent = todo.pop()
        at, stats = len(rows), tree.stats[i]
        if parent is not None:  # the right child: its place was open
            rows[parent][1][7] = at
        node = [at, float(stats.argmax()), float(gini(stats)), [float(v) for v in stats], int(stats.sum()), -1.0, -1, -1, (-1, [], -1)]
        rows.append((t, node))
        if not merged[i]:
            # x < bound goes left, as Spark's x <= cut
            cut = math.nextafter(bounds[tree.feature[i]][tree.cut[i]], -math.inf)
            node[5], node[6], node[8] = tree.gain[i], at + 1, (tree.feature[i], [cut], -1)
            todo += [(tree.left[i] + 1, at), (tree.left[i], None)]
    return [(t, tuple(node)) for t, node in rows]


NODES = ("struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, "
         "numCategories: int>>")
KINDS = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.int32(), pa.int32(),
         pa.int32(), pa.list_(pa.float64()), pa.int32()]


def as_model(spark, made: list[Tree], bounds: list[list[float]], classes: int, classifier: RandomForestClassifier
             ) -> RandomForestClassificationModel:
    """The trees as Spark's model: one fitted on a row for each class gives the frame, its nodes are replaced."""
    rows = [(Vectors.dense([float(y)] * len(bounds)), float(y)) for y in range(classes)]
    frame = classifier.fit(spark.createDataFrame(rows, ["features", "label"]))
    path = f"{checkpoint_dir(spark).rstrip('/')}/vitalis-forest-{uuid.uuid4().hex}"
    frame.write().save(f"{path}/frame")
    spark.read.text(f"{path}/frame/metadata").coalesce(1).write.text(f"{path}/model/metadata")
    spark.read.parquet(f"{path}/frame/treesMetadata").write.parquet(f"{path}/model/treesMetadata")
    nodes = [r for t, tree in enumerate(made) for r in node_rows(t, tree, bounds)]
    names = re.findall(r"(\w+): (?:int|double|array<double>|bigint)", NODES)
    flat = [(t, *node[:-1], *node[-1]) for t, node in nodes]
    table = pa.table([pa.array(v, k) for v, k in zip(zip(*flat, strict=True), KINDS, strict=True)], ["treeID", *names])
    whole = F.struct(*names[:8], F.struct(*names[8:]).alias("split"))
    spark.createDataFrame(table).select("treeID", whole.cast(NODES).alias("nodeData")).coalesce(1).write.parquet(f"{path}/model/data")
    return RandomForestClassificationModel.load(f"{path}/model")


def fit_cells(cells: DataFrame, width: int, bounds: list[list[float]], classifier: RandomForestClassifier, seed: int,
              rows_a_task: int) -> RandomForestClassificationModel:
    """A forest with the parameters of ``classifier`` from cells (bins, label, number)."""
    from vitalis.session import materialised

    spark = cells.sparkSession
    blocks = materialised(cells.mapInArrow(packed(width), PACKED), "forest-cells")
    seen = blocks.agg(F.sum("n").alias("n"), F.max("label").alias("label")).first()
    classes = max(2, seen["label"] + 1)
    # every level is a pass: as many tasks as there are cores and cells for
    tasks = max(1, min(spark.sparkContext.defaultParallelism, seen["n"] // 10_000), seen["n"] // rows_a_task)
    trees = classifier.getNumTrees()
    subset = width if trees == 1 else math.ceil(math.sqrt(width))
    blocks = blocks.repartition(tasks).cache()
    try:
        made = grow(blocks, width, max(map(len, bounds)) + 1, classes, trees, classifier.getMaxDepth(),
                    classifier.getMinInstancesPerNode(), subset, seed)
    finally:
        blocks.unpersist()
    return as_model(spark, made, bounds, classes, classifier)


# --- the class of every cell ------------------------------------------------------------
def _shape(nodes_by_tree, width: int) -> list[np.ndarray]:
    """The cuts of each feature, rising."""
    cuts: list[set] = [set() for _ in range(width)]
    for nodes in nodes_by_tree.values():
        for r in nodes.values():
            if r["left"] >= 0:
                cuts[r["feature"]].add(r["cut"][0])
    return [np.array(sorted(c)) for c in cuts]


def _slabs(held, cuts, shape):
    """(slab, bytes): the predicted class where the first feature is in bin ``slab``; votes in the order of the trees, as Spark adds them."""
    def run(batches):
        for batch in batches:
            for slab in batch.column(0).to_pylist():
                votes = np.zeros((2, *shape[1:]))
                for root in held.value:
                    todo = [(root, [(0, n) for n in shape])]
                    while todo:
                        (f, cut, left, right), box = todo.pop()
                        if f < 0:
                            place = tuple(slice(a, b) for a, b in box[1:])
                            for k, v in enumerate(cut):
                                if v:
                                    votes[k][place] += v
                            continue
                        middle = int(np.searchsorted(cuts[f], cut)) + 1
                        a, b = box[f]
                        if f == 0:
                            todo.append((left if slab < middle else right, box))
                            continue
                        for child, side in ((left, (a, min(b, middle))), (right, (max(a, middle), b))):
                            if side[0] < side[1]:
                                todo.append((child, [*box[:f], side, *box[f + 1:]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slab], pa.int64()), pa.array([(votes[1] > votes[0]).astype(np.uint8).tobytes()], pa.binary())],
                    ["slab", "classes"])
    return run


def decision_table(model: RandomForestClassificationModel, width: int) -> tuple[list[np.ndarray], np.ndarray] | None:
    """(cuts of each feature, predicted class of every cell) of a forest of two classes; None if there are too many cells.

    A value is in bin ``searchsorted(cuts, value)``, a missing one in the last, as trees send it right."""
    from vitalis.operators.tree_shapley import forest_nodes
    from pyspark.sql import SparkSession

    if model.numClasses != 2 or model.numFeatures != width:
        return None
    spark = SparkSession.getActiveSession()
    by_tree = forest_nodes(model)
    if any(r["kinds"] != -1 for nodes in by_tree.values() for r in nodes.values() if r["left"] >= 0):
        return None
    cuts = _shape(by_tree, width)
    shape = tuple(len(c) + 1 for c in cuts)
    if math.prod(shape) > MOST_CELLS:
        return None

    def nested(nodes, at):
        r = nodes[at]
        if r["left"] < 0:
            total = sum(r["stats"])
            return -1, [v / total if total else 0.0 for v in r["stats"]], None, None
        return r["feature"], r["cut"][0], nested(nodes, r["left"]), nested(nodes, r["right"])

    held = spark.sparkContext.broadcast([nested(by_tree[t], 0) for t in sorted(by_tree)])
    table = np.zeros((shape[0], math.prod(shape[1:])), np.uint8)
    slabs = spark.range(0, shape[0], 1, min(shape[0], 4 * spark.sparkContext.defaultParallelism))
    for r in slabs.mapInArrow(_slabs(held, cuts, shape), "slab long, classes binary").toLocalIterator():
        table[r["slab"]] = np.frombuffer(r["classes"], np.uint8)
    held.destroy()
    return cuts, table.reshape(-1)


def permuted_right(table, width: int, features: int):
    """Of rows (rep, label, x..., d...) the number, and how many are classed right as they are (feature -1) and
    with the value of one feature replaced by d."""
    cuts, classes = table
    shape = [len(c) + 1 for c in cuts]
    steps = [math.prod(shape[i + 1:]) for i in range(width)]

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        held = classes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, label = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            x, d = ([np.searchsorted(cuts[i], batch.column(k + i).to_numpy(zero_copy_only=False).astype(np.float64))
                     for i in range(width)] for k in (2, 2 + width))
            own = sum(x[i] * steps[i] for i in range(width))
            for f in range(-1, features):
                right = held[own if f < 0 else own + (d[f] - x[f]) * steps[f]] == label
                for r in np.unique(rep).tolist():
                    if f >= 0 or r == 0:
                        mine = rep == r
                        sums[f, r] = sums.get((f, r), 0) + np.array([mine.sum(), (right & mine).sum()])
        if sums:
            at = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in at], pa.int32()), pa.array([r for _, r in at], pa.int32()),
                 *(pa.array([int(sums[k][i]) for k in at], pa.int64()) for i in (0, 1))], ["_f", "_rep", "n", "right"])
    return run
