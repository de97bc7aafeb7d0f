"""Imputation: leaves are looked at in rows of neighbours."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from vitalis.operators import kdtree as K


@pytest.mark.parametrize("n", [1, 64, 1000])
def test_leaves_are_looked_at_in_rows(n, monkeypatch):
    rng = np.random.default_rng(n)
    side = np.sort(rng.uniform(0, 100, n))
    low = np.stack([side, rng.uniform(0, 1, n)], axis=1)
    high = low + rng.uniform(0, 0.2, (n, 2))
    shuffled = rng.permutation(n)
    boxes = SimpleNamespace(value={4: K._in_rows(shuffled.tolist(), low[shuffled].tolist(), high[shuffled].tolist())})
    plan = SimpleNamespace(value={3: [(4, [0, 1], [2])]})
    x = np.stack([rng.uniform(-5, 105, 40), rng.uniform(0, 1, 40)], axis=1)
    bound = rng.uniform(0, 4, 40)
    bound[0] = np.inf
    none, cells = pa.nulls(40, pa.float64()), []
    far_of = K._far
    monkeypatch.setattr(K, "_far", lambda *a: cells.append(far_of(*a).size) or far_of(*a))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(40)), pa.array([3] * 40), pa.array(x[:, 0]), pa.array(x[:, 1]), none, none, none, pa.array(bound)],
        ["key", "mask", "x0", "x1", "x2", "b0", "b1", "b2"])
    first = [r for b in K._plan(boxes, plan, 3, False)(iter([batch])) for r in b.to_pylist()]
    assert sorted(r["key"] for r in first) == list(range(40))
    second = [r for b in K._plan(boxes, plan, 3, True)(iter([batch])) for r in b.to_pylist()]
    got = sorted((r["key"], r["leaf"]) for r in [*first, *second])
    assert len(got) == len(set(got))
    gap = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0.0)
    near = (gap ** 2).sum(axis=2) * 1.5 <= bound[:, None]
    want = set(zip(*(a.tolist() for a in np.nonzero(near)), strict=True))
    assert want | {(r["key"], r["leaf"]) for r in first} == set(got)
    if n == 1000:
        assert sum(cells) < 0.6 * 2 * 40 * n  # not every box for every row, twice
    assert K.MOST_LEAVES * K.LEAF >= 4_000_000
