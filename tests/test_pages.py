"""Page arrays against plain Python, and the plans of queries that must not deal out every word."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from glyphloom.operators import pages as P
from glyphloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan_of(spark, name, sf=SF):
    return catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_md5():
    heads = [b"%d|%d|" % (r, d) for r in (1, 9, 10, 20) for d in (0, 7, 123456789012, -5)]
    for numbers in ([0, 1, 9, 10, 11, 99, 100, 12345, 700013], [5], [-3, 4]):
        got = ["%016x%016x" % tuple(h) for h in P.md5(*P.numbered_messages(heads, np.array(numbers))).tolist()]
        assert got == [hashlib.md5(h + str(x).encode()).hexdigest() for h in heads for x in numbers]


def test_in_hash_order():
    letters, place = np.array([3, 1, 2, 0]), np.array([4, 9, 11, 30])
    hashes = np.array([[[5, 1], [5, 0], [5 + 32, 0], [0, 0]], [[9, 0], [9, 0], [9, 0], [9, 0]]], np.uint64)
    assert P.in_hash_order(hashes, letters, place).tolist() == [[0, 1, 3, 2], [3, 1, 2, 0]]


def test_edge_letters():
    texts = ["a bc", None, "", "x", "é q-rs tt", "end b", "word", " two words "]
    import re

    want = [[(v[-1], w[0]) for v, w in zip(ws, ws[1:])] for ws in (re.findall("[a-z]+", t or "") for t in texts)]
    whole = pa.array(["skip me", *texts])
    for array in (pa.array(texts), whole.slice(1), whole.slice(1).cast(pa.large_string())):
        a, b, at = P.edge_letters(array)
        assert [[(chr(97 + x), chr(97 + y)) for x, y in zip(a[i:j], b[i:j])] for i, j in zip(at, at[1:])] == want


@pytest.mark.parametrize("letters", [[0, 0, 1, 2], list(range(26)) * 100])
def test_orders(letters):
    got = P.orders(np.random.default_rng(1), np.array(letters), 2000)
    assert (np.sort(got, axis=1) == np.sort(letters)).all()
    assert abs((got[:, 1] == 1).mean() - letters.count(1) / len(letters)) < 0.05


@pytest.mark.parametrize("name", ["edge_coupling_test", "edge_coupling_null", "page_association_null"])
def test_permutations_stay_in_pages(spark, name):
    """Words are not dealt out one by one, and the arrays are made once, not for each margin."""
    plan = plan_of(spark, name)
    assert "Generate" not in plan and plan.count("MapInArrow") == 1
