"""Exact quantiles in two passes: rank brackets from a mergeable sketch, then the few values inside.

The first pass is one aggregate: for every column (and group) a sketch of bounded
rank error gives two values between which the wanted ranks lie. The second
counts exactly what lies below the bracket and on its two ends, and gathers the
values strictly between, whose number the sketch's error bounds. Ranks that
fall on an end (a hot value) need no values at all. While a bracket may still
hold more than ``most_inside`` values, a pass in between counts and sketches the
inside of the bracket alone and narrows it. A bracket that turns out not to hold
its rank is opened and narrowed again, so the result is exact whatever the sketch does.

Rows stay as they are: no long form, no ranks per row, no table in between. What
reaches the driver are a few numbers for each group, column and probability, for
at most ``MOST_GROUPS`` groups; they go back as one broadcast table of that
bound. Beyond that many groups ``functions.ranking.exact_quantiles`` does the work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import as_double, col, long_form
from vitalis.functions.ranking import exact_quantiles

ACCURACY = 10_000
MOST_INSIDE = 4096
MOST_GROUPS = 10_000
MARGIN = 8  # of the sketch's rank error, to both sides
STEPS = 512  # of the narrowing grid


@dataclass
class _Target:
    """One wanted quantile of one column in one group: ranks first <= last, the bracket, how much it may hold."""
    first: int
    last: int
    fraction: float
    low: float
    high: float
    inside: float
    value: float | None = None
    open_to: tuple[float, float] = (0.0, 0.0)


def _local(df: DataFrame, by: list[str], groups: list[Row], extra: list[T.StructField], rows: list[tuple]) -> DataFrame:
    fields = [T.StructField(f"_by{i}", df.schema[b].dataType) for i, b in enumerate(by)] + [T.StructField("_one", T.IntegerType())]
    made = [(*(g[f"_by{i}"] for i in range(len(by))), 1, *r) for g, r in zip(groups, rows, strict=True)]
    return df.sparkSession.createDataFrame(made, T.StructType(fields + extra))


def join_groups(base: DataFrame, by: list[str], table: DataFrame) -> DataFrame:
    """``base`` (with ``by`` as _by0, ...) with its group's row of a table of at most ``MOST_GROUPS`` rows; a NULL group is one."""
    left = base.withColumn("_same", F.lit(1))
    on = F.col("_same") == F.col("_one")
    for i in range(len(by)):
        table = table.withColumnRenamed(f"_by{i}", f"_of{i}")
        on = on & F.col(f"_by{i}").eqNullSafe(F.col(f"_of{i}"))
    return left.join(F.broadcast(table), on).drop("_same", "_one", *[f"_of{i}" for i in range(len(by))])


def _work(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.select(*[col(b).alias(f"_by{i}") for i, b in enumerate(by)], *[as_double(c).alias(f"_x{i}") for i, c in enumerate(cols)])


def _first_pass(base, by, cols, probs, accuracy, extra):
    share = MARGIN / accuracy
    ends = [e for p in probs for e in (max(0.0, p - share), min(1.0, p + share))]
    aggregates = []
    for i in range(len(cols)):
        x = F.col(f"_x{i}")
        aggregates += [F.count(x).alias(f"_n{i}"), F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}"),
                       F.percentile_approx(x, ends, accuracy).alias(f"_sk{i}")]
    grouped = base.groupBy(*[f"_by{i}" for i in range(len(by))]).agg(*aggregates, *[e.alias(n) for n, e in extra.items()])
    return grouped.limit(MOST_GROUPS + 1).collect()


def _targets(group: Row, cols, probs, accuracy, most_inside) -> list[_Target | None]:
    out = []
    for i in range(len(cols)):
        n = group[f"_n{i}"]
        for j, p in enumerate(probs):
            if not n:
                out.append(None)
                continue
            place = p * (n - 1)
            first = math.floor(place)
            lowest, highest = group[f"_lo{i}"], group[f"_hi{i}"]
            low, high = group[f"_sk{i}"][2 * j:2 * j + 2]
            if n <= most_inside:
                low, high, inside = lowest, highest, n
            else:
                inside = n * (2 * MARGIN + 4) / accuracy
            out.append(_Target(first, min(first + 1, n - 1), place - first, low, high, inside, open_to=(lowest, highest)))
    return out


def _pass(df, base, by, groups, targets, width, aggregates):
    """One aggregate over the rows with their group's brackets; ``aggregates(x, t)`` are those of target t."""
    numbers = T.ArrayType(T.DoubleType())
    rows = [([None if t is None else t.low for t in ts], [None if t is None else t.high for t in ts],
             [None if t is None else t.first for t in ts], [None if t is None else t.last for t in ts]) for ts in targets]
    table = _local(df, by, groups, [T.StructField("_lo", numbers), T.StructField("_hi", numbers),
                                    T.StructField("_ka", T.ArrayType(T.LongType())),
                                    T.StructField("_kb", T.ArrayType(T.LongType()))], rows)
    found = join_groups(base, by, table).groupBy(*[f"_by{i}" for i in range(len(by))])
    made = found.agg(*[a for t in range(len(targets[0])) for a in aggregates(F.col(f"_x{t // width}"), t)],
                     *[F.first(c).alias(c) for c in ("_lo", "_hi", "_ka", "_kb")])
    return made


def _by_group(rows, by, groups):
    """The collected rows in the order of ``groups``."""
    def name(r):
        return tuple(repr(r[f"_by{i}"]) for i in range(len(by)))
    at = {name(r): r for r in rows}
    return [at[name(g)] for g in groups]


def _counts(x: Column, t: int) -> list[Column]:
    lo, hi = F.get("_lo", F.lit(t)), F.get("_hi", F.lit(t))
    return [F.count_if(x < lo).alias(f"b{t}"), F.count_if(x == lo).alias(f"l{t}"),
            F.count_if((x > lo) & (x < hi)).alias(f"i{t}"), F.count_if((x == hi) & (hi > lo)).alias(f"h{t}")]


def _narrow(row, t: int, target: _Target):
    """The next bracket from exact counts and a grid over the inside of this one."""
    below, at_low, inside, at_high = (row[f"{k}{t}"] for k in "blih")
    a, b = target.first - below, target.last - below
    if a < 0 or b >= at_low + inside + at_high:
        target.low, target.high = target.open_to
        target.inside = math.inf
        return
    grid = row[f"g{t}"] or []

    def value(k, up):
        if k < at_low:
            return target.low
        if k >= at_low + inside:
            return target.high
        step = (k - at_low) / inside * STEPS
        at = math.ceil(step) + 3 if up else math.floor(step) - 3
        return target.low if at < 0 else target.high if at > STEPS else grid[at]

    held = inside * (8 / STEPS + 4 / ACCURACY) if inside else 0
    low, high = value(a, False), value(b, True)
    if (low, high) == (target.low, target.high):
        held = inside
    target.low, target.high, target.inside = low, high, 0 if low == high else held


def _picked(t: int, k: str) -> Column:
    """The value of rank k of target t from the counts and the sorted values inside; null if it is not in the bracket."""
    r = F.get(k, F.lit(t)) - F.col(f"b{t}")
    inside = F.col(f"l{t}") + F.size(f"v{t}")
    return (F.when(r < 0, F.lit(None)).when(r < F.col(f"l{t}"), F.get("_lo", F.lit(t)))
            .when(r < inside, F.get(f"v{t}", (r - F.col(f"l{t}")).cast("int")))
            .when(r < inside + F.col(f"h{t}"), F.get("_hi", F.lit(t))))


def bracket_quantiles(df: DataFrame, by: list[str], cols: list[str], probs: list[float], accuracy: int = ACCURACY,
                      most_inside: int = MOST_INSIDE, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per group and column: by..., column, n, lo, hi, q_0 ... (linear interpolation, missing values left out).

    ``extra``: aggregates over the columns as _x0, _x1, ..., taken in the first pass, one value per group.
    A column without values has null quantiles. An ungrouped empty table gives one row per column, a grouped one none.
    """
    extra = extra or {}
    base = _work(df, by, cols)
    groups = _first_pass(base, by, cols, probs, accuracy, extra)
    if len(groups) > MOST_GROUPS:
        return _many_groups(df, base, by, cols, probs, extra)
    targets = [_targets(g, cols, probs, accuracy, most_inside) for g in groups]
    flat = [t for ts in targets for t in ts if t is not None]
    while any(t.value is None for t in flat):
        while any(t.value is None and t.inside > most_inside for t in flat):
            grid = [k / STEPS for k in range(STEPS + 1)]
            rows = _pass(df, base, by, groups, targets, len(probs), lambda x, t: [*_counts(x, t), F.percentile_approx(
                F.when((x > F.get("_lo", F.lit(t))) & (x < F.get("_hi", F.lit(t))), x), grid, ACCURACY).alias(f"g{t}")]).collect()
            for row, ts in zip(_by_group(rows, by, groups), targets, strict=True):
                for t, target in enumerate(ts):
                    if target is not None and target.value is None and target.inside > most_inside:
                        _narrow(row, t, target)
        made = _pass(df, base, by, groups, targets, len(probs), lambda x, t: [
            *_counts(x, t), F.sort_array(F.collect_list(F.when(
                (x > F.get("_lo", F.lit(t))) & (x < F.get("_hi", F.lit(t))), x))).alias(f"v{t}")])
        rows = made.select(*[f"_by{i}" for i in range(len(by))], *[
            c for t in range(len(cols) * len(probs)) for c in (_picked(t, "_ka").alias(f"a{t}"), _picked(t, "_kb").alias(f"z{t}"))
        ]).collect()
        for row, ts in zip(_by_group(rows, by, groups), targets, strict=True):
            for t, target in enumerate(ts):
                if target is not None and target.value is None:
                    a, z = row[f"a{t}"], row[f"z{t}"]
                    if a is None or z is None:  # the sketch was off: count again in an open bracket
                        (target.low, target.high), target.inside = target.open_to, math.inf
                    else:
                        target.value = a + (z - a) * target.fraction if z != a else a
    spark, made = df.sparkSession, []
    for g, ts in zip(groups, targets, strict=True):
        for i, c in enumerate(cols):
            values = [None if t is None else t.value for t in ts[i * len(probs):(i + 1) * len(probs)]]
            made.append((*(g[f"_by{k}"] for k in range(len(by))), c, g[f"_n{i}"], g[f"_lo{i}"], g[f"_hi{i}"],
                         *(g[e] for e in extra), *values))
    kinds = base.groupBy(*[f"_by{i}" for i in range(len(by))]).agg(F.lit(0).alias("_none"), *[e.alias(n) for n, e in extra.items()])
    schema = T.StructType(
        [T.StructField(b, df.schema[b].dataType) for b in by] + [T.StructField("column", T.StringType()),
         T.StructField("n", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]
        + [T.StructField(e, kinds.schema[e].dataType) for e in extra]
        + [T.StructField(f"q_{j}", T.DoubleType()) for j in range(len(probs))])
    return spark.createDataFrame(made, schema)


def _many_groups(df, base, by, cols, probs, extra):
    """The same rows by distributed ranks, for more groups than the driver may hold."""
    named = base.select(*[F.col(f"_by{i}").alias(b) for i, b in enumerate(by)], *[F.col(f"_x{i}").alias(c) for i, c in enumerate(cols)])
    ranks = exact_quantiles(long_form(named, cols, by), [*by, "column"], "value", probs)
    sums = base.groupBy(*[F.col(f"_by{i}").alias(b) for i, b in enumerate(by)]).agg(
        *[a for i in range(len(cols)) for a in (F.count(f"_x{i}").alias(f"_n{i}"), F.min(f"_x{i}").alias(f"_lo{i}"),
                                                F.max(f"_x{i}").alias(f"_hi{i}"))], *[e.alias(n) for n, e in extra.items()])
    long = sums.select(*map(col, by), *extra, F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"))
        for i, c in enumerate(cols)])).alias("r")).select(*map(col, by), "r.*", *extra)
    on = F.col("column") == F.col("_column")
    for i, b in enumerate(by):
        ranks = ranks.withColumnRenamed(b, f"_r{i}")
        on = on & col(b).eqNullSafe(F.col(f"_r{i}"))
    return long.join(ranks.withColumnRenamed("column", "_column"), on, "left").select(
        *map(col, by), "column", "n", "lo", "hi", *extra, *[f"q_{j}" for j in range(len(probs))])
