import random

import numpy as np
import pytest

from basketlens.operators import quantile

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def check(spark, values, monkeypatch=None):
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double").repartition(3)
    _, got = quantile.exact_quantiles(df, "g", "v", SHARES)
    assert set(got) == set(values)
    for g, vs in values.items():
        assert got[g][0] == len(vs)
        assert got[g][1] == pytest.approx(np.quantile(np.array(vs), SHARES).tolist(), rel=1e-12)


def test_values_far_apart_and_close_together(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SUBRANGES", 4)
    r = random.Random(1)
    check(
        spark,
        {
            "powers": [10.0**i for i in range(-300, 300, 7)],
            "near": [1.0 + i * 2**-52 for i in range(50)],
            "tiny": [5e-324 * i for i in range(9)],
            "both ends": [-1.7e308, 1.7e308, 0.0, -0.0, 3.0],
            "one": [7.5],
            "hot": [2.0] * 300 + [r.gauss(0, 1) for _ in range(300)],
        },
    )


def test_no_window_holds_more_than_the_sub_ranges(spark):
    """The only window runs over the counts, of which an interval has a fixed number."""
    rows = spark.range(5000).selectExpr("'a' AS g", "double(id * id) AS v")
    counted = quantile._narrowed(rows, {("a", 7): (0.0, 4999.0**2, 7)})
    low, high, place = counted["a", 7]
    assert low <= 49.0 <= high and high < 4999.0**2 / quantile.SUBRANGES + 1 and place <= 7


def test_nulls_and_nan_do_not_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), (None, 2.0), ("a", float("inf"))], "g string, v double")
    _, got = quantile.exact_quantiles(df, "g", "v", [0.0, 1.0])
    assert got["a"][0] == 2 and got["a"][1][0] == 1.0 and got["a"][1][1] > 1e308
    assert quantile.exact_quantiles(df.limit(0), "g", "v", [0.5])[1] == {}
