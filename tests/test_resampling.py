"""Resampling by cells against resampling of rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cavitas.operators import stats


def exact(values: np.ndarray, statistic, b: int = 4000) -> tuple[float, float]:
    rng = np.random.default_rng(1)
    found = [statistic(values[rng.integers(0, len(values), len(values))]) for _ in range(b)]
    return tuple(np.quantile(found, [0.025, 0.975]))


@pytest.mark.parametrize(("n", "share"), [(60, 0.2), (400, 0.5), (5000, 0.03)])
def test_intervals_of_a_rate_are_within_a_hundredth_of_exact_ones(spark, n, share):
    values = (np.arange(n) < n * share).astype(float)
    r = stats.bootstrap(spark.createDataFrame([(float(v),) for v in values], "m double"), "m", stats.mean_of("m")).first()
    low, high = exact(values, np.mean)
    assert r["estimate"] == pytest.approx(values.mean(), abs=1e-4) and r["n"] == n
    assert abs(r["low"] - low) <= 0.015 and abs(r["high"] - high) <= 0.015


def test_a_ratio_of_sums_and_any_other_aggregate(spark):
    rng = np.random.default_rng(3)
    values = np.stack([rng.integers(0, 6, 300), rng.integers(8, 20, 300)], axis=1).astype(float)
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(values)], "k int, a double, b double")
    low, high = exact(values, lambda v: v[:, 0].sum() / v[:, 1].sum())
    for statistic in (stats.ratio_of("a", "b"), lambda: F.sum("a") / F.sum("b")):
        r = stats.bootstrap(rows, "k", statistic, b=1500).first()
        assert abs(r["low"] - low) <= 0.01 and abs(r["high"] - high) <= 0.01
    assert tuple(stats.bootstrap(rows.where("false"), "k", stats.mean_of("a")).first()) == (None, None, None, 0)


def test_a_million_rows_cost_their_distinct_values(spark):
    """No stage of one task before the b draws are summed up, and no b x n rows: two cells give b x 2."""
    rows = spark.range(1_000_000, numPartitions=8).select((F.col("id") % 10 == 0).cast("double").alias("m"))
    found = stats.bootstrap(rows, "m", stats.mean_of("m"), b=3000)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    r = found.first()
    half = 1.96 * (0.1 * 0.9 / 1_000_000) ** 0.5
    assert r["n"] == 1_000_000 and abs(r["low"] - (0.1 - half)) < 2e-4 and abs(r["high"] - (0.1 + half)) < 2e-4


def test_weights_have_mean_and_variance_of_their_size(spark):
    cells = spark.createDataFrame([(str(k), k) for k in (1, 3, 11, 12, 400)], "cell string, size long")
    for r in stats.draws(cells, 4000, 9, 7).groupBy("size").agg(F.avg("weight").alias("m"), F.var_samp("weight").alias("v"), F.min("weight").alias("low")).collect():
        assert abs(r["m"] - r["size"]) < 4 * (r["size"] / 4000) ** 0.5 + 0.05 and abs(r["v"] / r["size"] - 1) < 0.15 and r["low"] >= 0


def test_label_swaps_leave_the_total_as_it_is(spark):
    per = spark.createDataFrame([(f"P{k}", 3 + k % 5, 4 + k % 7, k % 4) for k in range(50)], "pdb_id string, n_a int, n_b int, matched int")
    found = stats.permutation(per, b=200)
    want = 2 * sum(k % 4 for k in range(50)) / sum(7 + k % 5 + k % 7 for k in range(50))
    assert tuple(found.first()) == (round(want, 4), 200, 1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
