import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.functions.special import beta_cdf, beta_quantile, chi2_tail, t_quantile, t_two_sided


def test_against_the_jvm(spark):
    math = spark._jvm.org.apache.commons.math3.distribution
    for df in (1, 4, 30, 500):
        for t in (0.1, 1.0, 2.5, 9.0):
            assert t_two_sided(t, df) == pytest.approx(2 * (1 - math.TDistribution(float(df)).cumulativeProbability(t)), abs=1e-12)
        assert t_quantile(0.975, df) == pytest.approx(math.TDistribution(float(df)).inverseCumulativeProbability(0.975), rel=1e-8)
    for a, b in ((1, 20), (7, 14), (300, 2.5)):
        assert beta_cdf(0.3, a, b) == pytest.approx(math.BetaDistribution(float(a), float(b)).cumulativeProbability(0.3), abs=1e-12)
        assert beta_quantile(0.025, a, b) == pytest.approx(math.BetaDistribution(float(a), float(b)).inverseCumulativeProbability(0.025), abs=1e-7)
    for k in (1, 2, 5, 40):
        for x in (0.3, 3.0, 50.0):
            assert chi2_tail(x, k) == pytest.approx(1 - math.ChiSquaredDistribution(float(k)).cumulativeProbability(x), abs=1e-12)


@settings(max_examples=50, deadline=None)
@given(st.floats(0.01, 0.99), st.integers(1, 200), st.integers(1, 200))
def test_quantile_inverts(q, a, b):
    assert beta_cdf(beta_quantile(q, a, b), a, b) == pytest.approx(q, abs=1e-9)


def test_edges():
    assert t_two_sided(np.inf, 5) == 0 and t_two_sided(0.0, 5) == pytest.approx(1)
    assert chi2_tail(0.0, 3) == 1
