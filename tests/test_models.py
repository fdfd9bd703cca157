"""Models on a set that one feature separates: floors, direct metrics, equal results in two runs."""

from __future__ import annotations

import random

import pytest

from cavitas.operators import ml

NAMES = ("good", "noise")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    found = [(f"P{k % 40}", k, y, rng.uniform(0.55, 1) if y else rng.uniform(0, 0.5), rng.random()) for k in range(600) for y in [int(rng.random() < 0.3)]]
    df = spark.createDataFrame(found, "pdb_id string, pocket_id long, y_true int, good double, noise double").repartition(4).cache()
    return df.where("pocket_id % 3 <> 0"), df.where("pocket_id % 3 = 0")


def direct_auc(found: list) -> float:
    up, down = [p for y, p in found if y], [p for y, p in found if not y]
    return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))


@pytest.mark.parametrize("kind", ["rf", "gbt", "logistic"])
def test_a_separable_set_is_learned_alike_in_two_runs(rows, kind):
    train, test = rows
    runs = [ml.predict(ml.train(train, NAMES, kind), test, NAMES).select("pocket_id", "y_true", "y_pred", "y_proba").orderBy("pocket_id").collect() for _ in range(2)]
    assert [r["y_pred"] for r in runs[0]] == [r["y_pred"] for r in runs[1]]
    assert all(abs(a["y_proba"] - b["y_proba"]) < 1e-9 for a, b in zip(*runs, strict=True))
    found = test.sparkSession.createDataFrame(runs[0])
    tp, fp, fn, tn = (sum(r["y_true"] == y and r["y_pred"] == p for r in runs[0]) for y, p in ((1, 1), (0, 1), (1, 0), (0, 0)))
    m = ml.metrics(found).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (tp, fp, fn, tn) and m["f1"] == round(2 * tp / (2 * tp + fp + fn), 6)
    ranked = ml.ranking(found).first()
    assert ranked["roc_auc"] == pytest.approx(direct_auc([(r["y_true"], r["y_proba"]) for r in runs[0]]), abs=1e-6) and ranked["roc_auc"] >= 0.97
    assert m["accuracy"] >= 0.95


def test_importances_and_ablation_name_the_feature_that_separates(rows):
    train, test = rows
    weight = {r["feature"]: r["importance"] for r in ml.importances(ml.train(train, NAMES), NAMES, train.sparkSession).collect()}
    assert weight["good"] > 0.8 > weight["noise"]
    found = ml.ablation(train, test, NAMES).collect()
    assert found[0]["without"] == "good" and found[0]["delta"] < -0.3 and abs(found[1]["delta"]) < 0.1


def test_calibration_rises_and_models_are_compared(rows):
    train, test = rows
    model = ml.calibrated(train, NAMES)
    assert list(model.predictions) == sorted(model.predictions) and 0 <= min(model.predictions) and max(model.predictions) <= 1
    assert all(round(b, 4) == b for b in model.boundaries) and len(model.boundaries) <= 10_001
    table = ml.compared(train, test, NAMES).collect()
    assert {r["model"] for r in table} == {"rf", "gbt", "logistic"} and all(r["roc_auc"] >= 0.97 for r in table)
    best = max(r["average_precision"] for r in table)
    assert [r["average_precision"] for r in table if r["best"]] == [best]


def test_a_forest_that_holds_nodes_has_the_same_trees(rows):
    found = [ml.estimator(kind).fit(ml.assembled(ml.balanced(rows[0]), NAMES)).toDebugString.split("\n", 1)[1] for kind in ("rf", "rf_held")]
    assert found[0] == found[1]


def test_two_models_are_trained_at_once_unless_rows_are_many(rows, monkeypatch):
    import threading

    seen, both = [], threading.Barrier(2, timeout=60)

    def work(n):
        seen.append(n)
        if len(seen) <= 2:
            both.wait()
        return n * 2

    assert ml._each(rows[0], work, [1, 2, 3]) == [2, 4, 6]
    monkeypatch.setattr(ml, "HELD_ROWS", 10)
    names = []
    assert ml._each(rows[0], lambda n: names.append(threading.current_thread().name) or n, [1, 2, 3]) == [1, 2, 3] and len(set(names)) == 1


def test_training_rows_are_read_without_a_sort_of_pockets(spark, monkeypatch):
    from cavitas.plans import secondary
    from cavitas.plans.carriers import Carriers

    plans, own = [], ml.dataset
    monkeypatch.setattr(ml, "dataset", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or own(rows, *a))
    secondary._parts(Carriers(spark, "/root/testdata/sf0.001"))
    assert "Window" not in plans[0]


def test_few_bytes_of_much_work_go_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(ml, "WORK_ROWS", 50)
    fitted = []
    monkeypatch.setattr(ml, "estimator", lambda kind, seed: type("E", (), {"fit": lambda self, df: fitted.append(df)})())
    for n in (40, 60):
        ml.train(spark.range(n).coalesce(1).selectExpr("cast(id as double) as a", "cast(id % 2 as int) as y_true"), ("a",))
    assert [df.rdd.getNumPartitions() for df in fitted] == [1, spark.sparkContext.defaultParallelism]
