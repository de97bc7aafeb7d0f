"""Exact order statistics without pulling a group into one task.

A window with an empty or low-cardinality ``partitionBy`` (all rows of a label,
all values of a column) sends every row of that group to a single task. The
helpers here keep ranks, cumulative counts and quantiles exact while the work
stays spread out:

1. rows are first collapsed to distinct order values with their weights
   (map-side partial aggregation, so a hot value - even a third of the table -
   becomes one row per map task);
2. they are range-partitioned by (group, order value): a run of a group's values
   lies in one partition, a large group in as many as it needs. Nothing but
   Spark's own range bounds is sampled, nothing is collected or written into the plan;
   the partition's number is kept with the row (fractions known to be uniform
   are cut evenly by arithmetic instead);
3. per-partition totals - a row for each partition and each group in it - give
   every partition's offset in its groups by a small window; inside a (group,
   partition) a window adds the local prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalis.functions.columns import col
from vitalis.session import materialised


def _same(left: DataFrame, right: DataFrame, cols: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with ``cols`` renamed, and the null-safe equality of the columns: a NULL group is a group."""
    renamed, cond = right, F.lit(True)
    for i, c in enumerate(cols):
        renamed = renamed.withColumnRenamed(c, f"_same{i}")
        cond = cond & col(c).eqNullSafe(F.col(f"_same{i}"))
    return renamed, cond


def prefix_sums(df: DataFrame, by: list[str], order: str, weights: list[str],
                descending: bool = False, buckets: int | None = None,
                uniform_unit: bool = False, tie: str | None = None) -> DataFrame:
    """For rows distinct on ``(by, order)`` add ``<w>_before``: the sum of ``w``
    over rows of the same group that come strictly earlier in ``order``.

    ``uniform_unit`` marks an order value known to be uniform on [0, 1) (an md5
    fraction): buckets are then ``floor(v * buckets)`` and need no range partitioning.
    ``tie`` orders rows of equal ``order`` (a row key). A NULL group is kept.
    """
    key = "_ord"
    work = df.withColumn(key, (-col(order) if descending else col(order)).cast("double"))
    if uniform_unit:
        nb = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
        raw = F.least(F.floor(col(order).cast("double") * F.lit(nb)), F.lit(nb - 1)).cast("int")
        work = work.withColumn("_bucket", (F.lit(nb - 1) - raw) if descending else raw)
    else:
        parts = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
        # written, so that both passes below see the same ranges
        work = materialised(work.repartitionByRange(parts, *[col(b) for b in by], F.col(key))
                            .withColumn("_bucket", F.spark_partition_id()), "ranges")
    gcols = [col(b) for b in by]
    totals = work.groupBy(*gcols, "_bucket").agg(*[F.sum(col(w)).alias(f"_t_{i}") for i, w in enumerate(weights)])
    wb = Window.partitionBy(*gcols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*gcols, "_bucket", *[
        F.coalesce(F.sum(f"_t_{i}").over(wb), F.lit(0)).alias(f"_o_{i}") for i in range(len(weights))
    ])
    # without groups as many rows as there are buckets; with groups Catalyst goes by the size
    keys = [*by, "_bucket"]
    offsets, same = _same(work, offsets, keys)
    joined = work.join(offsets if by else F.broadcast(offsets), same).drop(*[f"_same{i}" for i in range(len(keys))])
    wl = Window.partitionBy(*gcols, "_bucket").orderBy(key, *([col(tie)] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    out = joined
    for i, w in enumerate(weights):
        out = out.withColumn(f"{w}_before", F.col(f"_o_{i}") + F.coalesce(F.sum(col(w)).over(wl), F.lit(0)))
    return out.drop(key, "_bucket", *[f"_o_{i}" for i in range(len(weights))])


def _value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    counts = (df.where(col(value).isNotNull())
              .groupBy(*[col(b) for b in by], col(value).alias(value))
              .agg(F.count(F.lit(1)).alias("cnt")))
    # read by the bounds pass and by the prefix pass: materialise it once in the
    # shared checkpoint folder instead of recomputing the input twice
    return counts.checkpoint(eager=True)


def value_counts_prefix(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct ``(by, value)`` with ``cnt`` and ``cnt_before`` (rows strictly
    below in the group). NULL values are excluded."""
    return prefix_sums(_value_counts(df, by, value), by, value, ["cnt"])


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float],
                    name: str = "q") -> DataFrame:
    """Linear-interpolation quantiles (pandas / ``quantile_cont`` definition),
    exact, one row per group with columns ``{name}_0 .. {name}_{len-1}``.

    Work: one aggregation to distinct values, one bucketed prefix pass, and a
    join against a tiny target table (groups x probs x 2 ranks).
    """
    counts = _value_counts(df, by, value)
    pre = prefix_sums(counts, by, value, ["cnt"])
    gcols = [col(b) for b in by]
    # group sizes from the written counts, not from the prefix-summed table
    n = counts.groupBy(*gcols).agg(F.sum("cnt").alias("_n"))
    targets = (n.select(*gcols, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_pi", "_p"))
               .withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
               .withColumn("_lo", F.floor("_pos").cast("long"))
               .withColumn("_frac", F.col("_pos") - F.col("_lo"))
               .withColumn("_k", F.explode(F.array(F.col("_lo"), F.least(F.col("_lo") + 1, F.col("_n") - 1)))))
    # targets: groups x probs x 2 rows, joined by group (Catalyst broadcasts them if they are few)
    hit = (targets if by else F.broadcast(targets)).alias("t").join(
        pre.alias("p"),
        on=[*[F.col(f"t.{b}").eqNullSafe(F.col(f"p.{b}")) for b in by],
            F.col("p.cnt_before") <= F.col("t._k"), F.col("t._k") < F.col("p.cnt_before") + F.col("p.cnt")],
        how="inner")
    picked = hit.select(*[F.col(f"t.{b}").alias(b) for b in by], "t._pi", "t._frac", "t._lo", "t._k",
                        F.col(f"p.{value}").cast("double").alias("_v"))
    per_p = picked.groupBy(*gcols, "_pi", "_frac").agg(
        F.max(F.when(F.col("_k") == F.col("_lo"), F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_k") != F.col("_lo"), F.col("_v"))).alias("_b"))
    per_p = per_p.withColumn("_q", F.when(F.col("_b").isNull(), F.col("_a"))
                             .otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")))
    wide = per_p.groupBy(*gcols).agg(*[
        F.max(F.when(F.col("_pi") == i, F.col("_q"))).alias(f"{name}_{i}") for i in range(len(probs))
    ])
    return wide


def hash_rank(df: DataFrame, by: list[str], u: str, out: str = "hash_rank", tie: str | None = None) -> DataFrame:
    """1-based rank of each row inside its group by an md5 fraction column
    ``u`` (uniform on [0, 1)), equal fractions by the key ``tie``: bucketed
    prefix counts, no group-wide window."""
    counted = df.withColumn("_one", F.lit(1))
    pre = prefix_sums(counted, by, u, ["_one"], uniform_unit=True, tie=tie)
    return pre.withColumn(out, (F.col("_one_before") + 1).cast("long")).drop("_one", "_one_before")


# --- the rows up to a rank, without ranking any --------------------------------------------
CUT_BUCKETS = 1 << 16


@dataclass
class Cut:
    """Where a set's first ``rank`` rows by (u, tie) end; ``rank`` 0: none, ``u`` None: all."""
    rank: int
    u: float | None = None
    tie: object = None

    def holds(self, u: Column, tie: Column) -> Column:
        if self.rank <= 0:
            return F.lit(False)
        if self.u is None:
            return F.lit(True)
        last = F.lit(self.u)
        same = tie.isNull() if self.tie is None else tie.isNull() | (tie <= F.lit(self.tie))  # a null tie comes first
        return (u < last) | ((u == last) & same)


def rank_cuts(df: DataFrame, sets: list[Column], u: str, tie: str, ranks) -> tuple[list[int], list[list[Cut]] | None]:
    """The size of each set of rows, and for each of its ranks the row (u, tie) where that many rows end.

    ``u`` is uniform on [0, 1); ``ranks(sizes)`` gives the ranks of each set. Two aggregates: counts by bucket of ``u``, then
    the rows of the buckets where ranks fall (n / 65536 rows each) in order. No row is shuffled, ranked or kept. None
    instead of the cuts if one falls between rows that share ``u`` and ``tie``: comparing them cannot part such rows."""
    bucket = F.greatest(F.least(F.floor(col(u) * F.lit(CUT_BUCKETS)), F.lit(CUT_BUCKETS - 1)), F.lit(0)).cast("int")
    parts = [F.count_if(s).alias(f"n{i}") for i, s in enumerate(sets)]
    counted = df.groupBy(bucket.alias("b")).agg(*parts).toArrow()  # a few numbers for each bucket
    counts = np.zeros((CUT_BUCKETS, len(sets)), np.int64)
    counts[counted.column("b").to_numpy()] = np.stack([counted.column(f"n{i}").to_numpy() for i in range(len(sets))], axis=1)
    upto = counts.cumsum(axis=0)
    sizes = upto[-1].tolist()
    cuts = [[Cut(int(r)) for r in of] for of in ranks(sizes)]
    inner = [(i, c, int(np.searchsorted(upto[:, i], c.rank))) for i, of in enumerate(cuts) for c in of if 0 < c.rank < sizes[i]]
    if not inner:
        return sizes, cuts
    near: dict[int, list] = {}
    for r in (df.withColumn("_b", bucket).where(F.col("_b").isin(sorted({b for _, _, b in inner})))
              .groupBy("_b", col(u).alias("_u"), col(tie).alias("_t")).agg(*parts).orderBy("_u", "_t").collect()):
        near.setdefault(r["_b"], []).append(r)
    for i, c, b in inner:
        left = c.rank - int(upto[b, i] - counts[b, i])
        for r in near[b]:
            left -= r[f"n{i}"]
            if left <= 0:
                if left < 0:
                    return sizes, None
                c.u, c.tie = r["_u"], r["_t"]
                break
    return sizes, cuts


def smallest_n(df: DataFrame, by: list[str], u: str, n_by_group: DataFrame, n_col: str = "n_take") -> DataFrame:
    """Rows whose hash rank inside the group is <= the group's quota
    (``n_by_group``: one row per group)."""
    ranked = hash_rank(df, by, u, "_hr")
    if by:
        quota, same = _same(ranked, n_by_group.select(*[col(b) for b in by], n_col), by)
        ranked = ranked.join(quota, same).drop(*[f"_same{i}" for i in range(len(by))])
    else:
        ranked = ranked.withColumn("_k0", F.lit(0)).join(
            F.broadcast(n_by_group.select(n_col).withColumn("_k0", F.lit(0))), on="_k0").drop("_k0")
    return ranked.where(F.col("_hr") <= F.col(n_col)).drop("_hr", n_col)
