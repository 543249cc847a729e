import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from oddline.operators.quantile import exact_percentile


def stored(spark, values, weights=None):
    weights = weights or [1] * len(values)
    return spark.createDataFrame(
        [(float(v), int(w)) for v, w in zip(values, weights)], "x double, w long"
    ).cache()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.floats(-1e6, 1e6), st.integers(1, 5)), min_size=1, max_size=40),
    st.sampled_from([0.0, 0.1, 0.5, 0.95, 1.0]),
)
def test_equals_sorting(spark, rows, fraction):
    values, weights = zip(*rows)
    df = stored(spark, values, list(weights))
    expected = np.percentile(np.repeat(values, weights), fraction * 100)
    assert exact_percentile(df, "x", fraction, "w", bins=5) == pytest.approx(expected, rel=1e-12, abs=1e-9)


def test_hot_value_and_long_tail(spark):
    values = [1.0] * 500 + [10.0**e for e in range(-20, 20)] + list(np.linspace(0, 2, 300))
    df = stored(spark, values)
    for p in (0.01, 0.5, 0.9, 0.999):
        assert exact_percentile(df, "x", p, bins=10) == pytest.approx(np.percentile(values, p * 100))


def test_neighbouring_doubles(spark):
    a = 1.0
    b = np.nextafter(a, 2)
    assert exact_percentile(stored(spark, [a, a, b]), "x", 1.0) == b
    assert exact_percentile(stored(spark, [a, a, b]), "x", 0.5) == a


def test_empty_is_an_error(spark):
    with pytest.raises(ValueError):
        exact_percentile(stored(spark, []) if False else spark.range(0).selectExpr("id * 1.0D AS x"), "x", 0.5)
