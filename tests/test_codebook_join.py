"""Few labels are broadcast: the rows of a frequent label stay spread out."""

from vitalis.operators import clean as C


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_labels_are_broadcast(spark):
    df = spark.createDataFrame([(i, "n/a" if i % 10 else f"u{i}") for i in range(200)], "id long, code string")
    book = C.fit_codebook(df, ["code"])
    out = C.code_of(df, book, ["code"])
    assert "BroadcastHashJoin" in plan_of(out) and "SortMergeJoin" not in plan_of(out)
    labels = sorted({r.code for r in df.collect()})
    assert {r.id: r.code for r in out.collect()} == {r.id: labels.index(r.code) for r in df.collect()}
