"""The features of labelled documents are made before the join."""

from vitalis.plans import fixtures


def test_no_text_in_the_join_of_documents_and_labels(spark, tmp_path):
    spark.createDataFrame([(1, "a b 1", "en", "s", 5), (2, None, "en", "s", None), (None, "x", "en", "s", 1), (1, "", "en", "s", 0)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1), (2, 1, None), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    out = fixtures.doc_labels(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [(1, 5.0, 3.0, 1.0, 0.2, 1), (1, 0.0, 1.0, 1.0, None, 1), (2, None, None, None, None, None)], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "regexp_replace" not in plan[:join] and "regexp_replace" in plan[join:]
