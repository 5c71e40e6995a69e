"""What made queries grow faster than their input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.operators import sequences as S
from glyphloom.operators import views as V
from glyphloom.plans.controls import binomial_two_sided

from .test_pages import plan_of


def test_aligner_table():
    seen = ["", "a", "b", "c", *(x + y for x in "abc" for y in "abc")]
    rng = np.random.default_rng(2)
    table = {s: {u: float(rng.random()) for u in seen if rng.random() < 0.9} for s in "xyz"}
    s, t, n = ["xyz", "zz", "x", "", "xyzzy"], ["abca", "cab", "", "a", "abcab"], np.array([3.0, 1.0, 2.0, 5.0, 1.0])
    got = S.aligner_table(s, t, n, table, seen, 2)
    want = np.zeros((3, len(seen)))
    for x, y, k in zip(s, t, n):
        for (sign, u), v in S.aligner_counts(x, y, table, 2).items():
            want["xyz".index(sign), seen.index(u)] += k * v
    assert np.allclose(got, want, rtol=1e-9, atol=1e-15)


@pytest.mark.parametrize(("a", "b"), [(0, 0), (0, 3), (1, 2), (5, 5), (40, 61), (100_300, 99_900)])
def test_binomial_two_sided(spark, a, b):
    """The largest took arrays of every length up to 200,200."""
    got = spark.range(1).select(binomial_two_sided(F.lit(a), F.lit(b))).first()[0]
    n = a + b
    terms = (math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(a, b) + 1))
    assert got == pytest.approx(min(1.0, 2 * math.fsum(terms)), abs=2e-9)


def test_beside(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "x")], "k int, text string")
    got = sorted(tuple(r) for r in V.beside(df, ("k",), l=-2, r=1).collect())
    assert got == [(1, 0, "a", None, "b"), (1, 1, "b", None, "c"), (1, 2, "c", "a", None), (4, 0, "x", None, None)]


@pytest.mark.parametrize("name", ["lag_repeat_rates", "spaced_alternations", "stem_pair_information", "page_confound", "residual_coupling_test"])
def test_neighbours_meet_in_their_text(spark, name):
    assert "partitionBy" not in (plan := plan_of(spark, name)) and "[doc_id" not in "".join(x for x in plan.splitlines() if "Window" in x)
