"""Rank tests, normality and the gate between tests."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.functions import distributions as ds
from attest.operators import stats as st


def frame(spark, *groups):
    return spark.createDataFrame([(name, float(x)) for name, values in groups for x in values], "g string, v double")


@pytest.mark.parametrize("n1,n2", [(1, 1), (1, 5), (2, 3), (3, 3), (4, 6), (6, 2)])
def test_counts_equal_an_enumeration(n1, n2):
    places = list(itertools.combinations(range(n1 + n2), n1))
    wins = [sum(p) - n1 * (n1 - 1) // 2 for p in places]
    assert ds.rank_sum_counts(n1, n2) == [wins.count(u) for u in range(n1 * n2 + 1)]
    for u in range(n1 * n2 + 1):
        far = max(u, n1 * n2 - u)
        assert abs(ds.rank_sum_two_sided(n1, n2, u) - min(1, 2 * sum(w >= far for w in wins) / len(wins))) < 1e-12


def test_exact_form_for_small_groups_without_ties(spark):
    # Published example: 19, 22, 16, 29, 24 against 20, 11, 17, 12 gives U = 17 and an exact p of 1/9.
    row = st.mann_whitney(frame(spark, ("a", [19, 22, 16, 29, 24]), ("b", [20, 11, 17, 12])), "v", "g", "a", "b").first()
    assert row.exact and row.u == 17 and abs(row.p - 1 / 9) < 1e-12
    tied = st.mann_whitney(frame(spark, ("a", [1, 2, 3]), ("b", [3, 4, 5])), "v", "g", "a", "b").first()
    assert not tied.exact and 0 < tied.p <= 1
    many = st.mann_whitney(frame(spark, ("a", range(9)), ("b", [x + 0.5 for x in range(9)])), "v", "g", "a", "b").first()
    assert not many.exact
    none = st.mann_whitney(frame(spark, ("a", [1, 2])), "v", "g", "a", "b").first()
    assert none.p is None and not none.exact


def test_normal_quantile(spark):
    p = [1e-300, 1e-20, 1e-5, 0.02, 0.075, 0.3, 0.5, 0.7, 0.975, 1 - 1e-10]
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", ds.normal_quantile(F.col("p")).alias("z")).collect()
    found = {r.p: r.z for r in rows}
    assert found[0.5] == 0 and abs(found[0.975] - 1.959963984540054) < 1e-14 and abs(found[0.02] + 2.053748910631823) < 1e-14
    assert all(abs(ds.normal_two_sided(z) / 2 / min(q, 1 - q) - 1) < 1e-6 for q, z in found.items() if q != 0.5)


def weights(n):
    """Scores by bisection and the published corrections."""
    def quantile(p):
        low, high = -40.0, 40.0
        for _ in range(200):
            middle = (low + high) / 2
            tail = ds.normal_two_sided(middle) / 2
            low, high = (middle, high) if (tail if middle < 0 else 1 - tail) < p else (low, middle)
        return low
    m = np.array([quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    s, u = (m * m).sum(), n ** -0.5
    a = m / np.sqrt(s)
    outer = sum(c * u ** (i + 1) for i, c in enumerate(st.OUTER_WEIGHT)) + a[-1]
    second = sum(c * u ** (i + 1) for i, c in enumerate(st.SECOND_WEIGHT)) + a[-2]
    if n == 3:
        return np.array([-0.5 ** 0.5, 0, 0.5 ** 0.5])
    k = 2 if n > 5 else 1
    inner = (s - 2 * (m[-k:] ** 2).sum()) / (1 - 2 * outer ** 2 - (2 * second ** 2 if k == 2 else 0))
    a = m / np.sqrt(inner)
    a[-1], a[0] = outer, -outer
    if k == 2:
        a[-2], a[1] = second, -second
    return a


@pytest.mark.parametrize("chunk,bucket", [(4096, 100_000), (3, 4)])
def test_shapiro_wilk(spark, chunk, bucket, monkeypatch):
    monkeypatch.setattr(st, "RANK_CHUNK", chunk)
    monkeypatch.setattr(st.value_places, "__defaults__", ((), bucket))
    draw = np.random.default_rng(4)
    # The published example of eleven weights: W = 0.7888, p = 0.0067.
    groups = {"men": [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], "flat": [2.0] * 9, "two": [1.0, 2.0], "three": [1.0, 2.0, 4.0],
              "four": [1.0, 2.0, 4.0, 4.5], "five": [1.0, 1.0, 4.0, 4.5, 9.0], "six": [1.0, 3.0, 4.0, 4.5, 4.5, 8.0],
              "ties": [1.0] * 40 + [2.0] * 30 + [7.0] * 5, "normal": draw.normal(5, 2, 300).tolist(), "skewed": draw.exponential(1, 300).tolist()}
    rows = {r.g: r for r in st.normality(frame(spark, *groups.items()), "v", "g").collect()}
    assert abs(rows["men"].w - 0.78881) < 1e-4 and abs(rows["men"].p - 0.0067) < 1e-4
    for name, values in groups.items():
        if name not in ("flat", "two"):
            x = np.sort(np.array(values))
            w = (weights(len(x)) @ x) ** 2 / ((x - x.mean()) ** 2).sum()
            assert abs(rows[name].w - w) < 1e-9, name
            assert 0 <= rows[name].p <= 1
    assert (rows["flat"].w, rows["flat"].p, rows["flat"].normal) == (1.0, 1.0, True)
    assert (rows["two"].w, rows["two"].normal) == (None, True)
    assert rows["normal"].normal and not rows["skewed"].normal and not rows["ties"].normal


def test_gate(spark):
    draw = np.random.default_rng(9)
    bell, tail = draw.normal(0, 1, 60), draw.exponential(1, 60) ** 2
    assert st.choose_test(frame(spark, ("a", bell), ("b", bell + 1)), "v", "g", "a", "b").first().test == "t"
    row = st.choose_test(frame(spark, ("a", bell), ("b", tail)), "v", "g", "a", "b").first()
    assert row.test == "mann_whitney" and 0 <= row.p <= 1
    few = st.choose_test(frame(spark, ("a", [1.0, 2.0]), ("b", [3.0, 5.0])), "v", "g", "a", "b").first()
    assert few.test == "t"
