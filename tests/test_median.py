"""Exact medians by selection."""

import random
import statistics

import pytest

from vectorlint.plans import runners as RN


@pytest.mark.parametrize("buckets", [2, 4096])
def test_exact_median(spark, monkeypatch, buckets):
    monkeypatch.setattr(RN, "_BUCKETS", buckets)
    r = random.Random(2)
    for values in ([3.0], [1.0, 2.0], [5.0] * 40 + [1.0, 9.0], [r.gauss(0, 1) for _ in range(301)], [1e300, -1e300, 5e-324, 0.0], [r.choice([1.0, 2.0, 1e9]) for _ in range(200)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "lat double")
        assert RN.exact_median(df, "lat") == statistics.median(values)
    assert RN.exact_median(spark.createDataFrame([(None,)], "lat double"), "lat") is None
    points = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "lat double, lon double")
    plan = RN.map_extent(points)._jdf.queryExecution().toString()
    assert "ercentile" not in plan and "median" not in plan
