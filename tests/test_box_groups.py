"""Few groups' quartiles are broadcast: no group's rows meet in a task."""

from vitalis.operators import explore as E


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_of_a_box_plot_stay_spread_out(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, float(i)) for i in range(300)], "g int, v double")
    out = E.box_stats(df, "v", "g")
    assert "BroadcastHashJoin" in plan_of(out) and "SortMergeJoin" not in plan_of(out)
    assert {r.grp: (r.n, r.median) for r in out.collect()} == {None: (100, 148.5), 1: (100, 149.5), 2: (100, 150.5)}
