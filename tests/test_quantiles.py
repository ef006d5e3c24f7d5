import random

import numpy as np
import pytest

from fleetspark.operators.explore import column_summary, correlation_matrix
from fleetspark.operators.quantiles import exact_quantiles, medians


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    return {
        "heavy": [0.0] * 500 + [rng.uniform(-5, 5) for _ in range(301)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) for _ in range(400)],
        "pair": [1.5, 2.5],
        "single": [-7.25],
        "narrow": [1e6 + i * 1e-7 for i in range(51)],
    }


@pytest.mark.parametrize("p", [0.0, 0.1, 0.25, 0.5, 0.75, 1.0])
def test_quantiles_match_numpy(spark, values, p):
    values = {**values, None: values["narrow"]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("pair", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], {"q": ("v", p)}).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12, abs=1e-12)


def test_median_without_groups(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "v double")
    assert medians(df, [], {"m": "v"}).first().m == 2.0


def test_column_summary(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, None), (3.0, 7), (None, 9)], "a double, b int")
    got = {r.column: r for r in column_summary(df, ["a", "b"]).collect()}
    assert (got["a"].min, got["a"].q1, got["a"].median, got["a"].q3, got["a"].max) == (1, 1.5, 2, 2.5, 3)
    assert got["a"].n_null == 1 and got["b"].n_null == 1 and got["b"].mean == 7


def test_constant_column_correlates_as_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (None, 1.0, 7.0)], "a double, b double, c double")
    got = {(r.column_a, r.column_b): r.correlation for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 0], [2, 4, 1])[0, 1])
    assert np.isnan(got["a", "c"]) and len(got) == 9


def test_times_are_summarised_too(spark):
    df = spark.sql("SELECT timestamp_micros(v * 1000000 + 500000)::timestamp_ntz AS t FROM VALUES (1), (2), (9), (NULL) x(v)")
    row = column_summary(df, [], ["t"]).first()
    assert (row.column, row.min, row.median, row.max, row.n_null) == ("t", 1.0, 2.0, 9.0, 1)


def test_only_values_of_picked_ranges_are_shuffled(spark):
    """Of a hundred thousand values spread over many ranges, few come through the second pass."""
    df = spark.range(100_000).selectExpr("id * 1.0D AS v")
    assert medians(df, [], {"m": "v"}).first().m == 49_999.5
    from fleetspark.operators import quantiles

    near = quantiles._value_range("v")
    middle = df.filter(near == df.filter("v = 49999").select(near.alias("r")).first().r)
    assert middle.count() < 100
