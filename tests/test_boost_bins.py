"""Boosting on many rows: rows of equal bins together."""

import math
import random

import pytest
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from vitalis.operators import models as ML


def test_bin_bounds(spark):
    rows = [(float(i % 5), 0.0 if i % 10 else float(i), 7.0, None, float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "few double, hot double, same double, none double, wide double")
    few, hot, same, none, wide = ML.bin_bounds(df, df.columns)
    assert few == [0.5, 1.5, 2.5, 3.5] and same == [7.0] and none == [0.0]
    assert math.nextafter(0.0, 1.0) in hot  # zero has a bin of its own
    assert len(wide) == ML.BINS - 1 and all(a < b for a, b in zip(wide, wide[1:]))
    assert all(abs(b - 4000 * (k + 1) / ML.BINS) < 10 for k, b in enumerate(wide))


def test_boosting_on_bins_is_boosting_on_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        a, b = float(rng.randrange(20)), float(rng.randrange(6))
        rows.append((f"k{i}", a, b, int(rng.random() < 0.1 + 0.04 * a - 0.03 * (b - 3) ** 2 / 3)))
    df = spark.createDataFrame(rows, "id string, `a.x` double, b double, y int").repartition(3)
    features, params = ["a.x", "b"], {"trees": 8, "depth": 4, "rate": 0.3}
    plain = ML.fit("boost", df, features, "y", params, key="id")
    monkeypatch.setattr(ML, "MANY_ROWS", 1000)
    written = []
    keep = ML.materialised
    monkeypatch.setattr(ML, "materialised", lambda t, label: written.append(keep(t, label)) or written[-1])
    binned = ML.fit("boost", df, features, "y", params, key="id")
    assert written[0].count() <= 20 * 7 * 2  # no more rows than different bins and labels
    assert written[0].agg(F.sum("_weight")).first()[0] == 3000
    assert isinstance(binned.stages[-1], GBTClassificationModel) and binned.stages[-1].getNumTrees == 8
    one = {r.id: r.prob for r in ML.predict(plain, df, features, key="id").collect()}
    two = {r.id: r.prob for r in ML.predict(binned, df, features, key="id").collect()}
    assert len(two) == 3000 and max(abs(one[k] - two[k]) for k in one) < 1e-6
    torn = df.withColumn("b", F.when(F.col("id") != "k7", F.col("b")))
    for many in (1000, 1_000_000):
        monkeypatch.setattr(ML, "MANY_ROWS", many)
        with pytest.raises(Exception, match="missing or infinite|MUST NOT be NaN"):
            ML.fit("boost", torn, features, "y", params, key="id")
    assert ML.predict(binned, torn, features, key="id").where("prob IS NULL").count() == 0
    monkeypatch.setattr(ML, "MANY_ROWS", 1000)
    written.clear()
    ML.fit("boost", df, features, "y", params | {"subsample": 0.8}, key="id")
    assert not written  # a subsample is drawn row by row
