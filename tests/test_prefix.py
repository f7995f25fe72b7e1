import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import prefix
from gaugeflow.operators.prefix import exact_quantiles, prefix_sums
from gaugeflow.session import local_table


def values(spark, n, keys=3):
    rng = random.Random(3)
    rows = [(rng.randrange(keys), rng.choice([float(rng.randrange(40)), rng.gauss(20, 10)]))
            for _ in range(n)]
    rows += [(0, 17.0)] * n          # one value holds a large share
    return rows, local_table(spark, rows, "k int, v double")


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    rows, df = values(spark, 3000)
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    for few in (True, False):
        out = exact_quantiles(df, ["k"], "v", probs, accuracy=accuracy, few_keys=few).collect()
        assert len(out) == 3
        for r in out:
            expected = np.quantile([v for k, v in rows if k == r["k"]], probs)
            assert np.allclose(r["quantiles"], expected, rtol=0, atol=1e-12)


def test_quantiles_of_tiny_groups(spark):
    rows = [(n, float(i * i)) for n in range(1, 12) for i in range(n)] + [(99, None)]
    out = exact_quantiles(local_table(spark, rows, "k int, v double"), ["k"], "v",
                          [0.1, 0.5, 0.9]).collect()
    assert sorted(r["k"] for r in out) == list(range(1, 12))
    for r in out:
        assert np.allclose(r["quantiles"],
                           np.quantile([i * i for i in range(r["k"])], [0.1, 0.5, 0.9]))


def test_prefix_sums_equal_a_running_total(spark):
    rows, df = values(spark, 2000)
    out = prefix_sums(df, ["k"], "v", {"n": F.count("*"), "s": F.sum("k")}, buckets=8).collect()
    for key in range(3):
        mine = sorted((r for r in out if r["k"] == key), key=lambda r: r["v"])
        data = sorted(v for k, v in rows if k == key)
        assert [r["v"] for r in mine] == sorted(set(data))
        assert [r["cum_n"] for r in mine] == list(np.searchsorted(data, [r["v"] for r in mine],
                                                                 side="right"))
        assert {r["total_n"] for r in mine} == {len(data)}


@pytest.mark.parametrize("few_keys", [True, False])
@pytest.mark.parametrize("options", [{}, {"most_rows": 50}, {"most_rows": 50, "slack": 0.2},
                                     {"slack": 1e-9}])
def test_quantiles_by_counting(spark, few_keys, options):
    """Ties, few values, brackets that are cut again and brackets that have to widen."""
    rng = np.random.default_rng(7)
    groups = {"one": [4.0], "two": [1.0, 2.0], "same": [3.0] * 500, "none": [None],
              "spread": rng.normal(size=6000), "ties": rng.integers(0, 4, 3000).astype(float),
              "hot": np.r_[np.zeros(2000), rng.random(1000) - 0.5, [-np.inf, np.inf]]}
    rows = [(k, None if v is None else float(v)) for k, values in groups.items() for v in values]
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    df = local_table(spark, rows, "k string, v double").repartition(3)
    found = {r.k: r.quantiles for r in exact_quantiles(
        df, ["k"], "v", probs, few_keys=few_keys, **options).collect()}
    assert set(found) == set(groups) - {"none"}
    assert (found["hot"][0], found["hot"][-1]) == (-np.inf, np.inf)
    for k, values in found.items():
        part = slice(1, -1) if k == "hot" else slice(None)
        expected = np.quantile(np.array(groups[k], float), probs)
        assert np.allclose(values[part], expected[part], rtol=0, atol=1e-12), (k, values, expected)


def test_quantiles_need_no_window_and_count_a_value_once(spark):
    data = local_table(spark, [("a", float(i)) for i in range(5000)], "k string, _v double")
    probs = [i / 10 for i in range(11)]
    brackets = prefix._brackets(data, ["k"], probs, 10_000, prefix.SLACK)
    plan = prefix._picked(data, brackets, ["k"], probs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Expand" not in plan
