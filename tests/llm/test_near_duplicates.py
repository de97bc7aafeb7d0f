"""Operators 4 and 6 and the components beneath them, against brute force."""

import random

import numpy as np
from conftest_llm import SF, Groups, clashing, frame, near_groups

from vitalis.llm import minhash
from vitalis.llm.components import connected_components
from vitalis.llm.embeddings import near_duplicate_vectors, op6_embedding_near_dedup
from vitalis.llm.minhash import keep_one_per_group, near_duplicates, op4_minhash_near_dedup


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(300, 200), (None, 5), (7, 7)]
    links += [(400 + rng.randrange(50), 400 + rng.randrange(50)) for _ in range(40)]
    rng.shuffle(links)
    groups = Groups({x for a, b in links if a is not None and a != b for x in (a, b)})
    for a, b in links:
        if a is not None and a != b:
            groups.join(a, b)
    got = {r.id: r.component_id for r in
           connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: groups.find(x) for x in groups.up}


def check(rows, docs):
    sets, groups = near_groups(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        k: (len(sets[k]), groups.find(k), groups.find(k) == k) for k in docs}


def test_op4_query(spark, documents):
    check(op4_minhash_near_dedup(spark, SF).collect(), documents)


def test_op4_dense_group_and_chains(spark):
    """Copies edited so much that most pairs lie near the threshold, on both sides of it."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    docs = {}
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs[i] = " ".join(w)
    chain = list(base[:80])
    for i in range(100, 125):  # each links with the next, the ends do not
        chain = chain[4:] + [f"y{i}a", f"y{i}b", f"y{i}c", f"y{i}d"]
        docs[i] = " ".join(chain)
    check(near_duplicates(frame(spark, list(docs.items()))).collect(), docs)


def test_op4_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b c"), (5, "a B c"), (6, "a b c"), (6, "a b c"), (7, "a b"),
            (8, "a b c d"), (None, "a b c"), (None, None), (9, "x " * 5000), (10, "x " * 5001)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in
           near_duplicates(clashing(frame(spark, rows))).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
                   (6, 1, 4, False), (7, 1, 7, True), (8, 1, 8, True), (None, 1, None, True), (None, 0, None, True),
                   (9, 1, 9, True), (10, 1, 9, False)}
    kept = keep_one_per_group(clashing(frame(spark, rows)))
    assert kept.columns[-1] == "vec"
    assert sorted(kept.collect(), key=str)[0]["lang"] is None
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "7", "8", "9", "None", "None"])
    assert near_duplicates(frame(spark, [])).collect() == []


def test_signature_guarantee():
    """All pairs within the pigeonhole distance share a masked key."""
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 16, (200, minhash.SIGNATURE)).astype(np.uint16)
    other = sig.copy()
    most = minhash.CHUNKS * 2 - 1
    for k in range(len(sig)):
        at = rng.choice(minhash.SIGNATURE, most, replace=False)
        other[k, at] ^= np.uint16(1)
    a, b = minhash.masked_keys(sig), minhash.masked_keys(other)
    assert all(np.intersect1d(x, y).size for x, y in zip(a, b, strict=True))


def vectors_expected(rows, threshold=0.98):
    ids = [r[0] for r in rows]
    links, groups = {i: 0 for i in ids}, Groups(ids)
    for n, (a, va, la) in enumerate(rows):
        for b, vb, lb in rows[n + 1:]:
            if la is None or la != lb or va is None or vb is None or len(va) != len(vb):
                continue
            x, y = (np.array([np.nan if c is None else c for c in v], float) for v in (va, vb))
            if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
                continue
            if (x / np.sqrt((x * x).sum())) @ (y / np.sqrt((y * y).sum())) >= threshold:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {i: (links[i], groups.find(i), groups.find(i) == i) for i in ids}


def test_op6_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op6_embedding_near_dedup(spark, SF).collect()}
    assert got == vectors_expected(rows)


def test_op6_cells_lose_no_link(spark):
    """Many small cells, points on their borders, copies, and every unusable kind of vector."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    rows = []
    for i in range(260):
        v = base[i % 60] + rng.normal(scale=rng.choice([0.0, 0.05, 0.2]), size=8)
        rows.append((i, [float(c) for c in v], "a" if i % 4 else "b"))
    rows += [(300, None, "a"), (301, [0.0] * 8, "a"), (302, [None] + [1.0] * 7, "a"), (303, [float("nan")] * 8, "a"),
             (304, [float("inf")] + [1.0] * 7, "a"), (305, rows[1][1], None), (306, [], "a"), (307, rows[1][1][:7], "a"),
             (308, [c * 1e200 for c in rows[1][1]], "a"), (309, [c * 1e-200 for c in rows[1][1]], "a")]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    expected = vectors_expected([(i, None if v is None else [c if c is None else c / max(
        abs(x or 0) for x in v) if any(v) and all(x is not None and np.isfinite(x) for x in v) else c for c in v], la)
        for i, v, la in rows])
    for size in (10, 10_000):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in
               near_duplicate_vectors(df, cell_rows=size).collect()}
        assert got == expected
    assert near_duplicate_vectors(df.limit(0)).collect() == []


def test_centroid_sample_leaves_small_labels_out(spark):
    """Ids that repeat do not widen the sample of a large label; other labels and dimensions send nothing."""
    from pyspark.sql import functions as F

    from vitalis.llm.embeddings import centroid_sample

    classes = spark.range(24_000).select(
        F.when(F.col("id") < 4000, "large").otherwise(F.concat(F.lit("small"), F.col("id") % 100)).alias("label"),
        (F.lit(8) + F.when(F.col("id") < 1000, 1).otherwise(0)).cast("int").alias("dim"), F.lit(1).cast("long").alias("id"),
        F.unhex(F.md5(F.col("id").cast("string"))).alias("vkey"), F.lit(b"x").alias("vec"))
    got = centroid_sample(classes, [("large", 8, 0.1)]).groupBy("label", "dim").count().collect()
    assert [(r.label, r.dim) for r in got] == [("large", 8)] and 200 < got[0]["count"] < 400


def test_kmeans_products_are_bounded():
    import tracemalloc

    from vitalis.llm.embeddings import spherical_kmeans

    x = np.random.default_rng(1).normal(size=(30_000, 8))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    tracemalloc.start()
    c = spherical_kmeans(x, 1000, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.shape == (1000, 8) and peak < 100e6  # the whole product is 240 MB
    own = (x @ x[np.linspace(0, len(x) - 1, 1000).astype(int)].T).argmax(axis=1)
    total = np.stack([x[own == k].sum(axis=0) for k in range(1000)])
    assert np.allclose(c, total / np.sqrt((total * total).sum(axis=1, keepdims=True)))
